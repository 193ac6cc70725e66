"""Scratch tables, session settings and id handling shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows of a few longs (some 16 MB) may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows of one key that may meet in a task of a join.
HOT_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep the Arrow batches handed to Python small: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


class Scratch:
    """Intermediate tables written to the shared folder.

    A written table cuts lineage and is read again by whichever executor needs it,
    so a lost executor costs only the tasks it was running.  ``drop`` removes a
    table that is no longer needed; the rest goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            pass


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def pick(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is in ``keys`` (distinct), with the columns of keys.

    The keys are broadcast only if a count shows that they are few; beyond that the
    join shuffles, so that the size of what is sent everywhere is bounded.
    """
    small = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, on)


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], held: str, total: int) -> DataFrame:
    """rows joined with ``table`` (one row a key), whose column ``held`` counts the rows of its key, of ``total``.

    A key of more than HOT_ROWS rows is dealt to parts of so many (by a hash of
    the row, which a repeated task finds again), and its row of the table goes to each.  Of such keys there are few: more than total / BROADCAST_ROWS
    rows are asked of them, so that the list that tells them apart can be broadcast.
    """
    part, parts = fresh("part"), fresh("parts")
    least = max(HOT_ROWS, total // BROADCAST_ROWS)
    split = table.withColumn(parts, F.expr(f"1 + ({held} - 1) div {least}"))
    hot = F.broadcast(split.filter(F.col(parts) > 1).select(*on, parts))
    dealt = rows.join(hot, on, "left").withColumn(part, F.when(F.col(parts).isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col(parts))).otherwise(F.lit(0).cast("long"))).drop(parts)
    each = split.withColumn(part, F.explode(F.expr(f"sequence(0L, {parts} - 1)"))).drop(parts)
    return dealt.join(each, [*on, part]).drop(part)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
