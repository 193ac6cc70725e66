"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a bag of words (ASCII lower case, separated by ASCII white space), each
weighted by its count.  For sample i and word k the hash of (i, k) gives r and c, both
Gamma(2, 1), and b, uniform; with t = floor(ln w / r + b), the sample is the word with
the least

    ln a = ln c - r (t - b + 1)

over the words.  Two documents draw the same (k, t) with the probability of their
generalised Jaccard similarity, sum min(w) / sum max(w) (Ioffe 2010).  As ln a is a
function of (i, k, t), it stands for the pair itself: a fingerprint holds 32 bits of
it for every sample, and the share of equal places estimates the similarity.

Documents are dealt once, by ranges of ids, together with the document that follows
each range; everything else happens within the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import BROADCAST_ROWS, documents

SAMPLES = 64
#: Characters of text that a range of ids should hold; beyond the first SPREAD ranges they may hold LARGE_CHARS.
RANGE_CHARS = 2_000_000
LARGE_CHARS = 128_000_000
SPREAD = 2000
EMPTY = "-"
#: Samples that one row draws together, and levels of the Gamma quantiles (a power of two, 12 bits).
BLOCK = 16
LEVELS = 4096


def gamma_table(spark: SparkSession) -> tuple[Column, Column]:
    """Quantiles of Gamma(2, 1) at the middles of LEVELS equal shares, and their logarithms, as scalar subqueries.

    Newton's rule from the inflection point 1 of 1 - (1 + x) exp(-x) converges for every share.
    """
    u = (F.col("id") + 0.5) / LEVELS
    step = lambda x, _: x - (1 - (1 + x) * F.exp(-x) - u) / (x * F.exp(-x))
    q = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(1.0), step)
    rows = spark.range(LEVELS).select("id", q.alias("q"))
    table = rows.agg(F.array_sort(F.collect_list("q")).alias("q"))
    return table.select("q").scalar(), table.select(F.transform("q", lambda x: F.ln(x)).alias("q")).scalar()


def sample(seed: str, log_weight: str, j: int, table: tuple[Column, Column]) -> Column:
    """ln a of a term in the block's sample j; null without a term.

    One hash gives the levels of r and c (12 bits each) and b (26 bits).
    """
    h = F.xxhash64(seed, F.lit(j))
    r = F.get(table[0], h.bitwiseAND(F.lit(LEVELS - 1)).cast("int"))
    ln_c = F.get(table[1], F.shiftrightunsigned(h, 52).cast("int"))
    b = (F.shiftrightunsigned(h, 12).bitwiseAND(F.lit((1 << 26) - 1)).cast("double") + 0.5) * (2.0**-26)
    return ln_c - r * (F.floor(F.col(log_weight) / r + b) - b + 1)


def words_of(text: Column) -> Column:
    """The words of a text; none for an empty or blank one."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal places of two fingerprints; 1 for two empty ones, 0 for one."""
    places = [F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8) for i in range(samples)]
    share = sum((p.cast("int") for p in places[1:]), places[0].cast("int")) / F.lit(float(samples))
    return F.when((F.col(a) == EMPTY) | (F.col(b) == EMPTY), (F.col(a) == F.col(b)).cast("double")).otherwise(share)


def _ranges(docs: DataFrame) -> int:
    """How many ranges the texts ask for: as many as may be broadcast (8 bytes each) at most; then they grow."""
    totals = docs.agg(F.count("id").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    chars = totals["chars"] or 0
    return max(1, min(totals["n"], chars // RANGE_CHARS, SPREAD + chars // LARGE_CHARS, BROADCAST_ROWS))


def _range_of(id_col: Column, bounds: Column) -> Column:
    """The last place (from 0) in the ascending array ``bounds`` with a value of at most the id, by halving."""
    steps = 20  # 2 ** 20 exceeds BROADCAST_ROWS
    begin = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.get(bounds, middle) <= id_col
        return F.struct(F.when(up, F.greatest(middle, s["low"])).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step, lambda s: s["low"])


def dealt(docs: DataFrame) -> DataFrame:
    """id, text, range and follows: each document in its range of ids, and each range's first also after the range before.

    The ranges begin at quantiles of the ids: at most BROADCAST_ROWS numbers, which the
    plan holds as one literal.
    """
    n = _ranges(docs)
    inner = F.percentile_approx("id", [k / n for k in range(1, n)], max(10_000, 4 * n)) if n > 1 else F.array().cast("array<bigint>")
    found = docs.agg(F.concat(F.array(F.min("id")), inner).alias("bounds")).first()["bounds"] or []
    # Without any id there is no row to look up: one bound will do.
    bounds = F.split(F.lit(",".join(map(str, sorted({x for x in found if x is not None}) or [0]))), ",").cast("array<bigint>")
    known = docs.filter(F.col("id").isNotNull()).withColumn("range", _range_of(F.col("id"), bounds))
    own = F.struct(F.col("range"), F.lit(False).alias("follows"))
    before = F.struct(F.pmod(F.col("range") - 1, F.size(bounds)).alias("range"), F.lit(True).alias("follows"))
    first = F.get(bounds, F.col("range")) == F.col("id")
    ordered = known.select("id", "text", F.inline(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    alone = docs.filter(F.col("id").isNull()).select("id", "text", F.expr(f"cast(-1 - pmod(xxhash64(text), {n}) as int)").alias("range"), F.lit(False).alias("follows"))
    return ordered.unionByName(alone).repartition(n, "range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text replaces the last floor(n / 2) of the n code points by the first as
    many (or all) of the next document by ascending id (after the last: the first).  Null
    texts count as empty.  Documents without a word have the fingerprint ``-``.  Returns
    the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness to the edited text and to the next document, 0 to 1).  A single
    document is its own next one.  Rows with a null id are left out of the order: they
    get a fingerprint, but null for what concerns another document.  Rows that repeat an
    id follow one another in the order of their texts.  An empty table gives an empty
    result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("range").orderBy("follows", "id", "text")
    rows = dealt(base).withColumn("row", F.row_number().over(order)).withColumn("next", F.when(F.col("range") >= 0, F.lead("text").over(order)))
    half = F.expr("cast(length(text) div 2 as int)")
    edited = F.when(~F.col("follows"), F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.substring(F.col("next"), F.lit(1), half)))
    rows = rows.select("range", "row", "follows", "id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))

    # A row goes through the aggregations as its two sides and, by itself, as a note of its columns: the many terms carry numbers only.
    note = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("n_chars").cast("string"), F.col("follows").cast("string"), F.coalesce(F.sha2("edited", 256), F.lit("")))
    side = lambda k, body, info: F.struct(F.lit(k).alias("side"), body.alias("body"), info.alias("note"))
    none = F.lit(None).cast("string")
    each = rows.select("range", "row", F.inline(F.array(side(0, F.col("text"), none), side(1, F.col("edited"), none), side(2, none, note)))).filter("body is not null or side = 2")
    is_note = F.col("side") == 2
    words = each.select("range", "row", "side", "note", F.explode(F.when(is_note, F.array(F.lit(""))).otherwise(words_of(F.col("body")))).alias("word"))
    terms = words.select("range", "row", "side", "note", F.when(~is_note, F.xxhash64("word")).alias("term"))
    weighted = terms.groupBy("range", "row", "side", "note", "term").agg(F.count(F.lit(1)).alias("n"))
    draws = F.when(is_note, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(-(-samples // BLOCK) - 1)))
    blocks = weighted.select("range", "row", "side", "note", "term", F.ln(F.col("n").cast("double")).alias("lw"), F.explode(draws).alias("block"))
    seeded = blocks.select("range", "row", "side", "note", "block", "lw", F.xxhash64("term", "block").alias("seed"))
    table = gamma_table(spark)
    drawn = seeded.groupBy("range", "row", "side", "note", "block").agg(*[F.min(sample("seed", "lw", j, table)).alias(f"s{j}") for j in range(min(BLOCK, samples))])
    places = F.concat(*[F.lpad(F.hex(F.xxhash64(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for j in range(min(BLOCK, samples))])
    prints = drawn.select("range", "row", "side", "block", F.coalesce("note", places).alias("print"))
    both = prints.groupBy("range", "row").agg(F.array_sort(F.collect_list(F.struct("side", "block", "print"))).alias("all"))

    def joined(k: int) -> Column:
        return F.array_join(F.transform(F.filter("all", lambda x: x["side"] == k), lambda x: x["print"]), "")

    found = lambda k: F.when(joined(k) == "", EMPTY).otherwise(joined(k))
    out = both.select("range", "row", F.split(joined(2), "\\|").alias("noted"), found(0).alias("fingerprint"), found(1).alias("edited_fingerprint"))
    said = lambda k: F.nullif(F.get("noted", F.lit(k)), F.lit(""))
    out = out.select("range", "row", said(0).cast("long").alias("id"), said(1).cast("long").alias("n_chars"), said(2).cast("boolean").alias("follows"), F.lower(said(3)).alias("edited_sha256"), "fingerprint", F.when(said(3).isNotNull(), F.col("edited_fingerprint")).alias("edited_fingerprint"))
    after = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("row"))
    out = out.withColumn("next_fingerprint", F.when(F.col("range") >= 0, after)).filter("not follows")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "next_fingerprint", samples).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(documents(spark, sf_dir))
