"""Pipeline stages: each takes (spark, docs, sf_dir) and works on all of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tessella.llm.common import BROADCAST_ROWS, Scratch, fresh


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose decision (id, kept) is to stay, with all their columns.

    Only the ids of dropped documents are sent around.  Where rows repeat an id and some
    of them stay, one row of each normalised text stays.  Rows with a null id stay.
    """
    scratch = Scratch(docs.sparkSession)
    key, some, body = fresh("id"), fresh("some"), fresh("text")
    marks = decisions.select(F.col(id_col).alias(key), "kept").filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("kept").alias(some), F.min("kept").alias("every"))
    marks = scratch.save(marks, "decisions")
    gone = marks.filter("not every").select(key, some)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    mixed = docs.join(gone, F.col(id_col) == F.col(key), "left")
    out = mixed.filter(F.col(key).isNull()).select(*docs.columns)
    if not marks.filter(F.col(some) & ~F.col("every")).isEmpty():
        part = mixed.filter(F.col(key).isNotNull() & F.col(some)).withColumn(body, exact_dedup.normalised(F.col(text_col)))
        out = out.unionByName(part.dropDuplicates([key, body]).select(*docs.columns))
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, labels, keep=tuple(c for c in docs.columns if c not in ("doc_id", "score", "predicted")))
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of equal texts."""
    return keep_rows(docs, exact_dedup.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group (five words, 0.8)."""
    return keep_rows(docs, near_dedup.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents with the target weights of source, language and topic."""
    return mixing.mix(docs).filter("sampled").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences of 2048."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
