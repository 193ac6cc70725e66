"""How far the sources of each language differ in their use of words.

Spark reads and sums; shards of terms, dealt by language and term, are handled by
vectorized DuckDB statements inside the tasks:

1. Tasks count the terms of their documents by language and source and sum them up
   before they are shuffled, so that a word of every document is a row a task.
2. A shard has all counts of its terms: SQL decides which terms are kept, and gives the
   counts of the language.  Spark adds up the totals of groups and languages.
3. A shard with the probabilities of its terms gives partial pair sums, its own best
   ten terms of every group, and how many terms of a group have which probability.
   Spark merges sums and rankings.

A pair of sources is compared over all kept terms, but only terms that both have meet
in a shard.  With f the distance and o the probability of a count of 0, the sum is

    V f(oa, ob) + sum over the terms of a of [f(pa, ob) - f(oa, ob)] + the same for b
    + sum over common terms of [f(pa, pb) - f(pa, ob) - f(oa, pb) + f(oa, ob)]

and the second part needs only the number of terms by probability.  All is in whole
numbers, so that no order of additions changes a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.common import BROADCAST_ROWS, Scratch, arrow_batches, documents
from tessella.llm.terms import pair_counts, summed, term_array

#: Documents of a language that a term must be in, and terms that are listed for a group.
LEAST = 10
TOP = 10
#: Rows of a shard, and memory of its database.
SHARD_ROWS = 400_000
SHARD_MEMORY = "400MB"
#: Probabilities are whole numbers of this fraction of one.
UNIT = 1_000_000_000
#: Bytes of text that are counted at once.
COUNT_BYTES = 2_000_000

_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True

COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        buf, off = K.text_bytes(batch.column(2))
        for a, b in K.slices(off, COUNT_BYTES):
            lang, source = (batch.column(k).slice(a, b - a).dictionary_encode() for k in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            part = K.lower_ascii(buf[off[a] : off[b]])
            terms, doc = term_array(part, _TERM[part], off[a : b + 1] - off[a])
            terms = terms.dictionary_encode()
            # The empty term stands for the group itself, which may have no other.
            names = pa.concat_arrays([terms.dictionary, pa.array([""], pa.large_string())])
            of_doc, term, n = pair_counts(doc, terms.indices.to_numpy().astype(np.int64), len(names))
            there = np.unique(group)
            of_group, term, both = pair_counts(np.concatenate((group[of_doc], there)), np.concatenate((term, np.full(len(there), len(names) - 1))), len(names), np.column_stack((np.concatenate((n, np.zeros(len(there), np.int64))), np.concatenate((np.ones(len(n), np.int64), np.zeros(len(there), np.int64))))))
            at = len(source.dictionary)
            yield pa.table({
                "lang": lang.dictionary.take(pa.array(of_group // at)), "source": source.dictionary.take(pa.array(of_group % at)), "term": names.take(pa.array(term)).cast(pa.string()),
                "n": both[:, 0], "docs": both[:, 1],
            })


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term, by language and source, of the texts of a task."""
    return summed(_counted(batches), ["lang", "source", "term"], ["n", "docs"])


def in_duckdb(batches: Iterator[pa.RecordBatch], columns: dict[str, str], statements: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition as table ``rows`` of an in-memory DuckDB database, and what the statements select from it."""
    import duckdb

    first = next(batches, None)
    if first is None:
        return
    # Nothing is spilled to the machine's disk: a shard is small by the number of shards.
    con = duckdb.connect(config={"threads": "1", "memory_limit": SHARD_MEMORY, "temp_directory": "", "preserve_insertion_order": "false"})
    try:
        con.execute("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q)")
        con.execute(f"CREATE TABLE rows ({', '.join(f'"{k}" {v}' for k, v in columns.items())})")
        for batch in chain((first,), batches):
            con.register("batch", batch)
            con.execute("INSERT INTO rows SELECT * FROM batch")
        for sql in statements:
            yield from con.sql(sql).to_arrow_reader(50_000)
    finally:
        con.close()


KEPT = "lang string, term string, source string, n long, lang_n long, head long"


def _kept(least: int):
    columns = {"lang": "VARCHAR", "source": "VARCHAR", "term": "VARCHAR", "n": "BIGINT", "docs": "BIGINT"}
    sql = f"""
        WITH t AS (SELECT lang, term, sum(n)::BIGINT AS lang_n, min(source) AS least FROM rows GROUP BY lang, term HAVING sum(docs) >= {least})
        SELECT lang, term, source, n, lang_n, (source = least)::BIGINT AS head FROM rows JOIN t USING (lang, term)"""
    return lambda batches: in_duckdb(batches, columns, [sql])


PARTS = "part string, lang string, source string, item string, p long, o long, value long"


def _compared(top: int):
    columns = {"lang": "VARCHAR", "term": "VARCHAR", "source": "VARCHAR", "p": "BIGINT", "o": "BIGINT", "q": "BIGINT"}
    pairs = """
        SELECT 'pair' AS part, lang, a.source AS source, b.source AS item, 0::BIGINT AS p, 0::BIGINT AS o,
          sum(f(a.p, b.p) - f(a.p, b.o) - f(a.o, b.p) + f(a.o, b.o))::BIGINT AS value
        FROM rows a JOIN rows b USING (lang, term) WHERE a.source < b.source GROUP BY ALL"""
    terms = f"""
        SELECT 'term' AS part, lang, source, term AS item, 0::BIGINT AS p, 0::BIGINT AS o, f(p, q)::BIGINT AS value
        FROM rows WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {top}"""
    levels = "SELECT 'level' AS part, lang, source, '' AS item, p, o, count(*) AS value FROM rows GROUP BY ALL"
    return lambda batches: in_duckdb(batches, columns, [pairs, terms, levels])


def _p(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(UNIT (n + 2) / (total + 2 terms)), in decimals: counts of a large corpus overflow a long here."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({total} + 2 * {terms} as decimal(20,0))")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _meet(rows: DataFrame, groups: DataFrame, on: list[str], n_groups: int) -> DataFrame:
    """rows joined with the groups: sent to every task if a count has shown that they are few; else rows of a language are dealt to parts."""
    if n_groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), on)
    parts = math.isqrt(n_groups)
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    return dealt.join(groups.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), [*on, "deal"]).drop("deal")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Distances between the sources of every language, and the terms that are typical of a source.

    Terms are runs of letters (A-Z, a-z and whatever is not ASCII), with A-Z lower-cased; a
    language keeps those in at least ``least`` of its documents.  Returns lang, source, part,
    item, value and rank: part ``pair`` has the distance to each other source of the
    language, part ``term`` the ``top`` kept terms that the group uses more than its
    language.  Nulls in text, language and source count as empty; rows that repeat an id
    are documents of their own; a group without kept terms has pairs, and a language
    without kept terms gives 0 for each; ties are ranked by item; an empty table gives an
    empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    empty = F.lit("")
    base = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counts = base.mapInArrow(term_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.save(counts, "counts")
    terms = counts.filter("term <> ''")
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(terms.count() / SHARD_ROWS))
    kept = scratch.save(terms.repartition(shards, "lang", "term").mapInArrow(_kept(least), KEPT), "kept")

    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "lang_total", "terms"]).withColumn("o", F.when(F.col("terms") > 0, _p("0L", "total", "terms")))
    groups = scratch.save(groups, "groups")
    n_groups = groups.count()

    rows = _meet(kept, groups.filter("terms > 0"), ["lang", "source"], n_groups)
    rows = rows.select("lang", "term", "source", _p("n", "total", "terms").alias("p"), "o", _p("lang_n", "lang_total", "terms").alias("q"))
    parts = scratch.save(rows.repartition(shards, "lang", "term").mapInArrow(_compared(top), PARTS), "parts")

    other = groups.select("lang", F.col("source").alias("item"), F.col("o").alias("u"))
    apart = F.col("source") != F.col("item")
    bare = _meet(groups.select("lang", "source", "terms", "o"), other, ["lang"], n_groups).filter(apart)
    bare = bare.select("lang", "source", "item", F.expr(f"coalesce(terms * ({_f('o', 'u')}), 0L)").alias("value"))
    levels = parts.filter("part = 'level'").groupBy("lang", "source", "p", "o").agg(F.sum("value").alias("n"))
    own = _meet(levels, other, ["lang"], n_groups).filter(apart).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"n * ({_f('p', 'u')} - {_f('o', 'u')})")).alias("value"))
    common = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = own.unionByName(common).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = bare.unionByName(own).unionByName(common).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    found = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(parts.filter("part = 'term'").select("lang", "source", "part", "item", "value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and their typical terms, over all documents."""
    return source_divergence(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
l AS (SELECT lang, sum(n) AS total, count(*) AS terms FROM t GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source)),
a AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.terms) AS p, 1 + ({UNIT}::HUGEINT * (t.n + 2)) // (l.total + 2 * l.terms) AS q
  FROM g JOIN l USING (lang) JOIN t USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pairs.value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM a WHERE n > 0 AND p > q
),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
