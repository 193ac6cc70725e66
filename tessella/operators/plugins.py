"""Plug points: what a user may supply, and what takes its place when it fails."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import chunking
from tessella.operators import retrieval as R


class Reranker(Protocol):
    """(id, content) of a pool to (id, score)."""

    def __call__(self, pool: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    """(doc_id, text) to (doc_id, embedding)."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def fail_open(supplied: Callable[..., DataFrame] | None, fallback: Callable[..., DataFrame], columns: tuple[str, ...]) -> Callable[..., DataFrame]:
    """``supplied``, or ``fallback`` if there is none, it raises while it makes its plan, or its result lacks a column.

    What fails later, in a task, fails the query: rows are never replaced in silence.
    """

    def call(*args: DataFrame) -> DataFrame:
        if supplied is not None:
            try:
                out = supplied(*args)
                if set(columns) <= set(out.columns):
                    return out.select(*columns)
                warnings.warn(f"the supplied operator lacks {sorted(set(columns) - set(out.columns))}", stacklevel=2)
            except Exception as e:  # noqa: BLE001  a plug-in may raise anything
                warnings.warn(f"the supplied operator failed: {e}", stacklevel=2)
        return fallback(*args).select(*columns)

    return call


def embedded(docs: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """doc_id, embedding by the supplied embedder, or by feature hashing."""
    return fail_open(embedder, chunking.embed, ("doc_id", "embedding"))(docs)


def reranked(pool: DataFrame, reranker: Reranker | None = None, share: float = 0.3) -> DataFrame:
    """id, score of a pool (id, content, score): its normalised score blended with the reranker's; the former alone without one.

    Rows that the reranker leaves out keep their own score.
    """
    own = R.normalised(pool, "score").withColumnRenamed("norm", "own").select("id", "own")
    scores = fail_open(reranker, lambda p: p.select("id", F.lit(None).cast("double").alias("score")).filter("false"), ("id", "score"))(pool.select("id", "content"))
    theirs = R.normalised(scores, "score").select("id", "norm")
    blended = F.when(F.col("norm").isNull(), F.col("own")).otherwise((1 - share) * F.col("own") + share * F.col("norm"))
    return own.join(theirs, "id", "left").select("id", blended.alias("score"))
