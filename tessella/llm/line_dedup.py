"""Boilerplate lines: lines that many different sites share.

The spread of a line, its number of distinct sites, is estimated by a HyperLogLog
sketch for each line hash; sketches are built before the shuffle and merged by the
aggregation, so that a line that is on every page costs one sketch a task.  Lines
whose estimate is too near the threshold to tell get exact distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import BROADCAST_ROWS, Scratch, documents, pick

SITES = 10
LOG_K = 11
#: Estimates within this share of the threshold are counted exactly (over six standard errors of the sketch).
NEAR = 0.2
NONE = "(none)"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _name(line: Column) -> Column:
    """Hash of a line without surrounding spaces, tabs and carriage returns; null for a blank one."""
    bare = F.trim(F.translate(line, "\t\r", "  "))
    return F.when(bare != "", F.xxhash64(bare))


def widespread(rows: DataFrame, sites: int = SITES, log_k: int = LOG_K) -> DataFrame:
    """The line hashes (column line) that at least ``sites`` distinct values of column site share."""
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", log_k).alias("sketch"))
    spread = sketches.select("line", F.hll_sketch_estimate("sketch").alias("spread")).filter(F.col("spread") >= sites * (1 - NEAR))
    return spread


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """Remove from every text the lines that at least ``sites`` distinct sites share.

    Lines are compared without surrounding spaces, tabs and carriage returns; blank
    lines are never removed, and a null site counts as one site.  Returns, per row: the
    id, n_lines, n_removed and text (the lines that stay, in order; null for a null text,
    which has no lines).  Rows that repeat an id, or have a null id, get a row each; an empty table gives an
    empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    # A null id meets no other in a join: the key stands for it.
    name, none = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(id_col).isNull().alias("none")
    on = ["name", "none", "tag"]
    base = docs.select(F.col(id_col).alias("id"), name, none, F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(site_col).cast("string"), F.lit(NONE)).alias("site"))
    each = base.select(*on, "site", F.posexplode(F.transform(lines_of(F.col("text")), _name)).alias("at", "line")).filter("line is not null")
    each = scratch.save(each, "lines")
    spread = scratch.save(widespread(each.select("line", "site"), sites), "spread")
    sure = spread.filter(F.col("spread") > sites * (1 + NEAR)).select("line")
    near = spread.filter(F.col("spread") <= sites * (1 + NEAR)).select("line")
    small = near.count() <= BROADCAST_ROWS
    exact = each.join(F.broadcast(near) if small else near, "line").select("line", "site").distinct().groupBy("line").count().filter(F.col("count") >= sites).select("line")
    common = scratch.save(sure.unionByName(exact), "common")
    few = F.broadcast(common) if common.count() <= BROADCAST_ROWS else common
    hits = each.join(few, "line").groupBy(*on).agg(F.collect_set("at").alias("gone"))
    hits = scratch.save(hits, "hits")
    keys = hits.select(*on)
    lines = lines_of(F.col("text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines")
    cut = pick(base, keys, on).join(hits, on)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    cut = cut.select("id", n, F.size("gone").alias("n_removed"), kept.alias("text"))
    few = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    rest = base.join(few, on, "left_anti").select("id", n, F.lit(0).alias("n_removed"), "text")
    return cut.unionByName(rest).withColumnRenamed("id", id_col)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least ten sources share."""
    return remove_boilerplate(documents(spark, sf_dir))


OP4_SQL = rf"""
WITH l AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), n AS (SELECT *, trim(translate(line, chr(9) || chr(13), '  ')) AS bare FROM l),
common AS (SELECT bare FROM n WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {SITES}),
k AS (
  SELECT doc_id, count(*)::INTEGER AS n_lines, (count(*) FILTER (WHERE c.bare IS NOT NULL))::INTEGER AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.bare IS NULL), '') AS text
  FROM n LEFT JOIN common c ON n.bare = c.bare GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_removed, 0)::INTEGER AS n_removed, k.text AS text
FROM documents d LEFT JOIN k USING (doc_id)
"""
