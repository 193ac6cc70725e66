"""Retrieval quality over ranked results (query_id, id, position) and gold: pairs (query_id, id), or groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked rows with hit, and the number of relevant rows of their query."""
    n = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = gold.select("query_id", "id", F.lit(1).alias("hit"))
    return ranked.join(hits, ["query_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0))).join(n, "query_id")


def marked_by_group(ranked: DataFrame, queries: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """The same where all other rows (id, group) of a query's group are gold, without making those pairs:
    the relevant rows are counted by group, and only ranked rows are looked up."""
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("held"))
    own = queries.select(F.col("query_id").alias("id"), F.col(group).alias("wanted"))
    itself = own.join(rows.select("id", group), "id").filter(F.col("wanted") == F.col(group)).select(F.col("id").alias("query_id"), F.lit(1).alias("itself"))
    n = queries.join(size, group).join(itself, "query_id", "left").select("query_id", F.col(group).alias("wanted"), (F.col("held") - F.coalesce("itself", F.lit(0))).alias("relevant")).filter("relevant > 0")
    hits = ranked.join(rows.select("id", group), "id").join(n, "query_id")
    return hits.withColumn("hit", (F.col(group) == F.col("wanted")).cast("int"))


def at_k(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """recall, hit, MRR, nDCG, precision and F1 at k for each query with gold; one shuffle for all."""
    return summed(marked(ranked.filter(F.col("position") <= k), gold), k)


def summed(m: DataFrame, k: int) -> DataFrame:
    gain = F.sum(F.col("hit") / F.log2(F.col("position") + 1.0))
    g = m.groupBy("query_id", "relevant").agg(F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("position"))).alias("first"), gain.alias("dcg"), F.count(F.lit(1)).alias("shown"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    r, p = F.col("hits") / F.col("relevant"), F.col("hits") / F.col("shown")
    f1 = F.when(F.col("hits") == 0, 0.0).otherwise(2 * r * p / (r + p))
    return g.select("query_id", r.alias("recall"), (F.col("hits") > 0).cast("int").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"), p.alias("precision"), f1.alias("f1"))


# The cumulative chances of 0 to 5 draws of a Poisson distribution with mean 1.
DRAWS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
#: Multipliers of the hash that draws, and rows whose draws are made at once.
MIX = (2654435761, 40503, 73244475)
ROWS_AT_ONCE = 5000


def bootstrap_sums(rows: DataFrame, id_col: str, stratum: str, value: str, replicates: int) -> DataFrame:
    """stratum, replicate (from 1), n and total: the sums of drawn weights, and of weights times values, of every bootstrap replicate.

    A row's weight in a replicate is a Poisson draw from a hash of its id (a long) and the
    replicate's number, so that every run draws the same.  Each task adds up the weights of
    its own rows by stratum, all replicates at once: a row is never copied, and what is
    shuffled is one number per task, stratum and replicate.  Null values count as no row.
    """
    mask, number = np.uint64(0xFFFFFFFF), np.arange(1, replicates + 1, dtype=np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for k in range(0, len(frame), ROWS_AT_ONCE):
                part = frame.iloc[k : k + ROWS_AT_ONCE]
                x = (part["id"].to_numpy(np.int64).astype(np.uint64)[:, None] * np.uint64(MIX[0]) + number * np.uint64(MIX[1])) & mask
                for _ in range(2):
                    x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX[2])) & mask
                u = (x ^ (x >> np.uint64(16))) / 2.0**32
                weight = np.searchsorted(np.array(DRAWS), u, "right")
                for key, at in part.reset_index(drop=True).groupby("stratum", dropna=False).indices.items():
                    sums = np.stack((weight[at].sum(axis=0), part["value"].to_numpy(float)[at] @ weight[at]))
                    held[key] = held[key] + sums if key in held else sums
        for key, (n, total) in held.items():
            yield pd.DataFrame({"stratum": pd.Series([None if pd.isna(key) else key] * replicates, dtype=object), "replicate": number.astype(np.int32), "n": n, "total": total})

    kind = rows.schema[stratum].dataType.simpleString()
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(stratum).alias("stratum"), F.col(value).cast("double").alias("value")).filter("id is not null and value is not null")
    sums = base.mapInPandas(run, f"stratum {kind}, replicate int, n double, total double")
    return sums.groupBy("stratum", "replicate").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
