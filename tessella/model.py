"""The memory model: enums, fixed weights, and the adapter from plain tables to memory rows.

A memory is one typed, scoped, bi-temporal text record.  Times are epoch seconds as
doubles; null means unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MTYPES = ("working", "episodic", "semantic", "procedural")
SCOPES = ("session", "repo", "workspace", "user")
LAYERS = ("temporal", "entity", "causal", "semantic")

BASE = 1704067200.0
DAY = 86400.0
#: The present of the adapted tables; no query reads a clock.
NOW = BASE + 365 * DAY

# Ranking weights by memory type, and reinforcement by interaction.
WEIGHTS = {
    "working": {"r": 0.6, "s": 1.0, "l": 0.6, "g": 0.4, "i": 0.3, "c": 1.0, "x": 0.5},
    "episodic": {"r": 0.9, "s": 1.0, "l": 0.6, "g": 0.7, "i": 0.6, "c": 0.6, "x": 0.8},
    "semantic": {"r": 1.0, "s": 1.0, "l": 0.5, "g": 0.7, "i": 0.7, "c": 0.3, "x": 0.9},
    "procedural": {"r": 1.0, "s": 0.9, "l": 0.5, "g": 0.8, "i": 0.9, "c": 0.2, "x": 0.7},
}
BOOSTS = {"view": 0.05, "read": 0.05, "recall": 0.15, "react": 0.20, "engage": 0.30, "reply": 0.50, "create": 1.00}
EVENT_KINDS = {"view": "view", "click": "read", "signup": "engage", "purchase": "create"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weight(name: str, mtype: str = "mtype") -> Column:
    """The ranking weight of a row's memory type."""
    out = None
    for kind, values in WEIGHTS.items():
        test = F.col(mtype) == kind
        out = F.when(test, F.lit(values[name])) if out is None else out.when(test, F.lit(values[name]))
    return out


def memories(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    """documents and labels as memory rows; all else is derived from the id.

    Labels cover some documents; they are looked up by a join that leaves the texts in
    place when the labels are small enough to be broadcast.
    """
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    born = BASE + d * 3600.0
    closes = F.when(d % 5 == 0, born + 30 * DAY)
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("mem_"), F.lpad(d.cast("string"), 8, "0")).alias("id"),
        *([F.col("text").alias("content")] if content else []),
        F.col("lang").alias("workspace_id"),
        F.col("source").alias("repo_id"),
        F.element_at(F.array(*map(F.lit, MTYPES)), (d % 4 + 1).cast("int")).alias("mtype"),
        F.element_at(F.array(*map(F.lit, SCOPES)), (F.expr("(doc_id div 4) % 4 + 1")).cast("int")).alias("scope"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("importance"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("trusted"),
        ((d % 10) * 0.1 + 0.05).alias("surprise"),
        (1.0 + d % 30).alias("stability"),
        (0.5 + (d % 6) * 0.1).alias("confidence"),
        (d % 17 == 0).alias("pinned"),
        (d % 13).alias("access_count"),
        F.when(d % 7 != 0, born + (d % 300) * DAY).alias("last_access"),
        born.alias("valid_from"),
        closes.alias("valid_to"),
        (closes + DAY).alias("valid_to_recorded_at"),
        (born + 60.0).alias("ingested_at"),
        F.when(d % 11 == 0, born + 200 * DAY).alias("expired_at"),
        F.concat(F.lit("subject_"), (d % 97).cast("string")).alias("subject_key"),
    )


#: The same adapter for DuckDB: a CTE named mem.
MEM_SQL = f"""
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
mem AS (
  SELECT d.doc_id, 'mem_' || lpad(d.doc_id::VARCHAR, 8, '0') AS id, text AS content, lang AS workspace_id, source AS repo_id,
    ['working', 'episodic', 'semantic', 'procedural'][(d.doc_id % 4 + 1)::INT] AS mtype,
    ['session', 'repo', 'workspace', 'user'][((d.doc_id // 4) % 4 + 1)::INT] AS scope,
    coalesce(quality::DOUBLE, 0.5::DOUBLE) AS importance, coalesce(toxic, 0) = 0 AS trusted,
    (d.doc_id % 10)::DOUBLE * 0.1::DOUBLE + 0.05::DOUBLE AS surprise, (1 + d.doc_id % 30)::DOUBLE AS stability,
    0.5::DOUBLE + (d.doc_id % 6)::DOUBLE * 0.1::DOUBLE AS confidence, d.doc_id % 17 = 0 AS pinned, d.doc_id % 13 AS access_count,
    {BASE}::DOUBLE + d.doc_id::DOUBLE * 3600 AS valid_from,
    CASE WHEN d.doc_id % 7 <> 0 THEN {BASE}::DOUBLE + d.doc_id::DOUBLE * 3600 + (d.doc_id % 300)::DOUBLE * 86400 END AS last_access,
    CASE WHEN d.doc_id % 5 = 0 THEN {BASE}::DOUBLE + d.doc_id::DOUBLE * 3600 + 30 * 86400 END AS valid_to,
    CASE WHEN d.doc_id % 5 = 0 THEN {BASE}::DOUBLE + d.doc_id::DOUBLE * 3600 + 31 * 86400 END AS valid_to_recorded_at,
    {BASE}::DOUBLE + d.doc_id::DOUBLE * 3600 + 60 AS ingested_at,
    CASE WHEN d.doc_id % 11 = 0 THEN {BASE}::DOUBLE + d.doc_id::DOUBLE * 3600 + 200 * 86400 END AS expired_at,
    'subject_' || (d.doc_id % 97)::VARCHAR AS subject_key
  FROM documents d LEFT JOIN lab l ON d.doc_id = l.doc_id
)"""
