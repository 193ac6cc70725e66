"""Hash-chained receipts and savings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS, SEPARATOR = "genesis", "\u001f"


def payload_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def link_hash(prev: Column, own: Column, sequence: Column) -> Column:
    """The hash of a receipt: of the receipt before it, its own payload's hash, and its number."""
    return F.sha2(F.concat_ws(SEPARATOR, F.coalesce(prev, F.lit(GENESIS)), own, sequence.cast("string")), 256)


def chain(rows: DataFrame, keys: list[str], order: list[str], payload: Column) -> DataFrame:
    """The rows with own (the hash of the payload), sequence, prev_hash and receipt_hash.

    Every receipt's hash goes into the next one, so that the last of a chain, its head,
    depends on all of them.  That is sequential within a chain: chains are dealt over
    the cluster, and each task walks through its sorted rows holding one hash, however
    long a chain is.
    """
    own = rows.withColumn("own", payload)
    names = own.columns
    at, mine = [names.index(k) for k in keys], names.index("own")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sequence, head = None, 0, None
        for batch in batches:
            numbers, before, hashes = [], [], []
            chains = zip(*(batch.column(i).to_pylist() for i in at), strict=True) if at else iter([()] * len(batch))
            for key, own_hash in zip(chains, batch.column(mine).to_pylist(), strict=True):
                if now is None or key != now:
                    now, sequence, head = key, 0, None
                sequence += 1
                before.append(head)
                head = hashlib.sha256(SEPARATOR.join((head or GENESIS, own_hash, str(sequence))).encode()).hexdigest()
                numbers.append(sequence)
                hashes.append(head)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(before, pa.string()), pa.array(hashes, pa.string())], [*names, "sequence", "prev_hash", "receipt_hash"])

    dealt = own.repartition(*keys) if keys else own.repartition(1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(walk, f"{fields}, sequence long, prev_hash string, receipt_hash string")


def links(receipts: DataFrame, keys: list[str], payload: Column | None = None) -> DataFrame:
    """The receipts with gap (the number before is missing) and broken: the hash does not follow from the row
    (with ``payload``: from its contents, not from what it says of them) or from the receipt before it."""
    w = Window.partitionBy(*keys).orderBy("sequence")
    r = receipts.withColumn("was", F.lag("receipt_hash").over(w)).withColumn("last", F.lag("sequence").over(w))
    own = F.col("own") if payload is None else payload
    broken = ~F.col("was").eqNullSafe(F.col("prev_hash")) | ~link_hash(F.col("prev_hash"), own, F.col("sequence")).eqNullSafe(F.col("receipt_hash"))
    return r.withColumn("gap", F.col("sequence") != F.coalesce("last", F.lit(0)) + 1).withColumn("broken", broken).drop("was", "last")


def verify(receipts: DataFrame, keys: list[str], payload: Column | None = None) -> DataFrame:
    """Per chain: receipts, gaps in the sequence, and links that do not match; every row is checked in parallel."""
    r = links(receipts, keys, payload)
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("receipts"), F.count_if("gap").alias("gaps"), F.count_if("broken").alias("broken"))


def heads(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Per chain its head and how many receipts it has: what an anchor keeps elsewhere."""
    return receipts.groupBy(*keys).agg(F.max_by("receipt_hash", "sequence").alias("head"), F.count(F.lit(1)).alias("receipts"))


def check_anchors(receipts: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Per chain, against anchors (keys, head, receipts): ok, extended, truncated, forked, missing or unanchored.

    The anchored receipt must still be there with its hash: a chain that ends before it is
    truncated, one with another hash in its place is forked.
    """
    now = heads(receipts, keys).select(*keys, F.col("receipts").alias("held"))
    kept = anchors.select(*keys, F.col("head").alias("anchor"), F.col("receipts").alias("expected"))
    there = receipts.join(kept, keys).filter(F.col("sequence") == F.col("expected")).select(*keys, F.col("receipt_hash").alias("found"))
    both = kept.join(now, keys, "full").join(there, keys, "left")
    status = (
        F.when(F.col("expected").isNull(), "unanchored").when(F.col("held").isNull(), "missing").when(F.col("held") < F.col("expected"), "truncated")
        .when(~F.col("found").eqNullSafe(F.col("anchor")), "forked").when(F.col("held") > F.col("expected"), "extended").otherwise("ok")
    )
    return both.select(*keys, status.alias("status"), F.coalesce("held", F.lit(0)).alias("receipts"))


def savings(rows: DataFrame, *groups: str) -> DataFrame:
    """Sums over deliveries (baseline, emitted; null or negative numbers and failed ones are invalid) by groups.

    Invalid deliveries are counted by their reason and add nothing; the ratio is 0 without a baseline.
    """
    bad = F.when(F.col("failed"), "failed").when(F.col("baseline").isNull() | F.col("emitted").isNull(), "missing").when((F.col("baseline") < 0) | (F.col("emitted") < 0), "negative")
    r = rows.withColumn("bad", bad)
    good = F.col("bad").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, c)), F.lit(0))
    g = r.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("receipts"), F.count_if(good).alias("valid"), *[F.count_if(F.col("bad") == k).alias(f"invalid_{k}") for k in ("failed", "missing", "negative")],
        total(F.col("baseline")).alias("baseline"), total(F.col("emitted")).alias("emitted"), total(F.greatest(F.col("baseline") - F.col("emitted"), F.lit(0))).alias("saved"), F.count_if(good & (F.col("emitted") > F.col("baseline"))).alias("grown"),
    )
    return g.withColumn("ratio", F.round(F.when(F.col("baseline") == 0, 0.0).otherwise(F.col("saved") / F.col("baseline")), 9))


def classify(operation: Column, intent: Column, mode: Column) -> dict[str, Column]:
    """basis, confidence and eligible of a delivery."""
    packed = ((operation == "recall") & (intent == "recall_context")) | operation.isin("grounded_recall", "proactive_context")
    adaptive = operation == "adaptive_context"
    basis = F.when(adaptive & mode.isin("retrieval"), "history_retrieval").when(adaptive & mode.isin("history_fallback", "history_bypass", "low_confidence_abstain"), mode).when(packed, "packed_context").otherwise("unclassified")
    confidence = F.when(basis == "history_retrieval", "high").when(basis.isin("history_fallback", "packed_context"), "medium").when(basis.isin("history_bypass", "low_confidence_abstain"), "none").otherwise("unknown")
    return {"basis": basis, "confidence": confidence, "eligible": basis.isin("history_retrieval", "history_fallback", "packed_context")}
