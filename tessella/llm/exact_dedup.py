"""Exact duplicates by deterministic block naming (Karp, Miller and Rosenberg).

The normalised text is cut into blocks of a fixed number of bytes.  Distinct blocks
are sorted within hash partitions and numbered: a block's name is its integer.  Pairs
of adjacent names are named the same way, again and again, until a document has one
name; together with its number of blocks that name is the document's identity.  Two
documents have the same identity if and only if their texts are equal: names are
given to block contents and to pairs of names, not to hashes.

Blocks are found again by a 64-bit hash, which is cheap to shuffle.  Hashes that
several contents share are detected when the blocks are named, and those blocks are
named and matched by content instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import BROADCAST_ROWS, Scratch, documents, salted_join

BLOCK_BYTES = 4096


def normalised(text):
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _blocks(size: int):
    """The blocks of the binary column ``body``; an empty text has one empty block."""
    return F.expr(f"transform(sequence(0, greatest(0, (octet_length(body) - 1) div {size})), i -> substring(body, i * {size} + 1, {size}))")


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names for distinct rows: sorted within their hash partitions, then numbered."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64, scratch: Scratch | None = None) -> DataFrame:
    """row (a number for each row), id, sha (of the normalised text), blocks and name."""
    scratch = scratch or Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col).cast("string")).cast("binary").alias("body"))
    hashed = base.select("id", F.sha2("body", 256).alias("sha"), F.transform(_blocks(block_bytes), lambda b: block_hash(b)).alias("hashes"))
    rows = scratch.save(hashed.withColumn("row", F.monotonically_increasing_id()), "rows")

    each = base.select(F.explode(_blocks(block_bytes)).alias("block")).select(block_hash("block").alias("hash"), "block")
    held = each.groupBy("hash", "block").agg(F.count(F.lit(1)).alias("held"))
    named = scratch.save(_named(held, ["hash", "block"]).select("hash", "name", "held"), "blocks")
    total = rows.agg(F.sum(F.size("hashes"))).first()[0] or 0
    shared = named.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")

    placed = rows.select("row", F.size("hashes").alias("blocks"), F.posexplode("hashes").alias("at", "hash"))
    if (clashes := shared.count()) == 0:
        level = salted_join(placed, named, ["hash"], "held", total).select("row", "blocks", "at", "name")
    else:
        few = F.broadcast(shared) if clashes <= BROADCAST_ROWS else shared
        # Row numbers are matched by hashes and sha: the same row is read again for its contents.
        again = base.select(F.sha2("body", 256).alias("sha"), F.posexplode(_blocks(block_bytes)).alias("at", "block")).withColumn("hash", block_hash("block"))
        contents = again.join(few, "hash").select("sha", "at", "hash", "block").distinct()
        by_block = _named(contents.select("hash", "block").distinct(), ["hash", "block"]).select("hash", "block", (-1 - F.col("name")).alias("name"))
        own = contents.join(scratch.save(by_block, "shared"), ["hash", "block"]).select("sha", "at", "name")
        sure = salted_join(placed, named.join(shared, "hash", "left_anti"), ["hash"], "held", total).select("row", "blocks", "at", "name")
        rest = placed.join(shared, "hash").join(rows.select("row", "sha"), "row").join(own, ["sha", "at"]).select("row", "blocks", "at", "name")
        level = sure.unionByName(rest)

    level = scratch.save(level, "level-0")
    done = level.filter("blocks = 1").select("row", "name")
    longest = rows.agg(F.max(F.size("hashes"))).first()[0] or 0
    live = level.filter("blocks > 1").select("row", F.col("blocks").alias("left"), "at", "name")
    step = 0
    while longest > 1:
        step += 1
        longest = (longest + 1) // 2
        half = F.expr("at div 2").alias("at")
        pairs = live.groupBy("row", "left", half).agg(F.max(F.expr("if(at % 2 = 0, name, null)")).alias("a"), F.max(F.expr("if(at % 2 = 1, name, null)")).alias("b"))
        pairs = scratch.save(pairs.select("row", F.expr("(left + 1) div 2").alias("left"), "at", "a", F.coalesce("b", F.lit(-1 << 62)).alias("b")), f"pairs-{step}")
        held = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("held"))
        names = scratch.save(_named(held, ["a", "b"]), f"names-{step}")
        level = scratch.save(salted_join(pairs, names, ["a", "b"], "held", total).select("row", "left", "at", "name"), f"level-{step}")
        done = done.unionByName(level.filter("left = 1").select("row", "name"))
        live = level.filter("left > 1")
    return rows.select("row", "id", "sha", F.size("hashes").alias("blocks")).join(done, "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64) -> DataFrame:
    """Groups of documents whose normalised texts are equal.

    Null counts as empty, and white space as in ``normalised``; empty texts are equal
    to each other.  Returns, per row: the id, keep_id (least id of the group),
    group_size, kept and text_sha256 (of the normalised text, lower-case hex).  One row
    of each group is kept: the one with keep_id and, if rows repeat that id, the first
    of them.  Null ids come after all others.  An empty table gives an empty result;
    other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    of = scratch.save(identities(docs, id_col, text_col, block_bytes, block_hash, scratch), "identities")
    of = of.withColumn("rank", F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = of.groupBy("blocks", "name").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("group_size"))
    out = salted_join(of, groups, ["blocks", "name"], "group_size", of.count())
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return exact_duplicates(documents(spark, sf_dir))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""
