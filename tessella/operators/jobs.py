"""Long jobs over a table in batches of a key, which go on where they were stopped."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLAN = "plan long, batch long, low long, high long"
_MARK = "plan long, batch long, high long, rows long"


class Progress(NamedTuple):
    done: int
    left: int
    watermark: int | None


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was written to a folder; empty while nothing was."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _planned(rows: DataFrame, key: str, after: int | None, size: int, plan: int) -> list[tuple[int, int, int, int]]:
    """Ranges of the keys beyond ``after``, of about ``size`` rows each; at most 10,000 of them, as their bounds are held on the driver."""
    new = rows.filter(F.col(key).isNotNull()) if after is None else rows.filter(F.col(key) > after)
    n, low, high = new.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    if not n:
        return []
    parts = min(max(1, -(-n // size)), 10_000)
    cuts = new.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = sorted({c for c in cuts if c < high} | {high})
    return [(plan, k, a, b) for k, (a, b) in enumerate(zip((low, *(b + 1 for b in bounds[:-1])), bounds, strict=True))]


def run(rows: DataFrame, key: str, job: Callable[[DataFrame], DataFrame], folder: str, size: int = 1_000_000, stop_after: int | None = None) -> Progress:
    """Runs a job over all rows that it has not seen, in batches by key (a long), and notes each batch that is whole.

    A run first finishes the plan that an earlier one left, then plans the keys beyond the
    last.  A batch is written to a place of its own and noted only then: one that was stopped
    half-way is written anew, and none is counted twice.  Keys must not arrive below the
    watermark; rows without a key are refused.  ``stop_after`` ends the run after so
    many batches.  ``results`` reads what all whole batches gave.
    """
    spark = rows.sparkSession
    if not rows.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"rows without {key} have no place in the order of batches")
    marks = {(r["plan"], r["batch"]): r["high"] for r in _table(spark, f"{folder}/marks", _MARK).collect()}
    plans = [tuple(r) for r in _table(spark, f"{folder}/plan", _PLAN).orderBy("plan", "batch").collect()]
    if all(p[:2] in marks for p in plans):
        more = _planned(rows, key, max((p[3] for p in plans), default=None), size, plans[-1][0] + 1 if plans else 0)
        if more:
            spark.createDataFrame(more, _PLAN).coalesce(1).write.mode("append").parquet(f"{folder}/plan")
        plans += more
    left = [p for p in plans if p[:2] not in marks]
    for plan, batch, low, high in left[:stop_after]:
        place = f"{folder}/out/plan={plan}/batch={batch}"
        job(rows.filter(F.col(key).between(low, high))).write.mode("overwrite").parquet(place)
        n = spark.read.parquet(place).count()
        spark.createDataFrame([(plan, batch, high, n)], _MARK).coalesce(1).write.mode("append").parquet(f"{folder}/marks")
        marks[plan, batch] = high
    return Progress(len(marks), len(plans) - len(marks), max(marks.values(), default=None))


def results(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all whole batches; None before there is one."""
    whole = _table(spark, f"{folder}/marks", _MARK).select("plan", "batch").distinct()
    if whole.isEmpty():
        return None
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return out.join(F.broadcast(whole), ["plan", "batch"], "left_semi").drop("plan", "batch")  # at most as many rows as batches
