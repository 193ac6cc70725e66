"""From raw documents to packed sequences, in five stages.

Toxic documents go, then exact copies, then near copies; the rest is sampled to target
weights and packed.  Each stage takes (spark, docs, sf_dir), where docs is what its
predecessor kept, with the columns of documents; the last returns placed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import stages
from tessella.llm.common import Scratch

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_exact_copies),
    ("near_dedup", stages.drop_near_copies),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: Learned models, signatures and packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
