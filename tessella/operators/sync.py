"""Merge of replicas: a commutative, associative and idempotent aggregate over ids."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that the last writer sets, by (has clock, clock, time of ingestion, hash of the payload).
DESCRIPTIVE = ("title", "content", "importance")
#: Columns of a row that never change, where replicas have them.
KEPT = ("supersedes", "review_state")


def _hash() -> Column:
    return F.sha2(F.concat_ws("\u001f", *DESCRIPTIVE), 256)


def fold(*replicas: DataFrame) -> DataFrame:
    """One row for each id, with the columns of the replicas, so that it can be folded again; every field has its own rule, and one shuffle does them all.

    Descriptive fields: last writer wins.  valid_to: the earliest, with its earliest
    time of recording (null wins).  expired_at: the earliest.  stability, access_count,
    last_access, pinned_at, unpinned_at: the greatest.
    """
    rows = reduce(DataFrame.unionByName, replicas)
    version = F.struct(F.col("hlc").isNotNull().alias("has"), F.coalesce("hlc", F.lit("")).alias("hlc"), F.coalesce("ingested_at", F.lit(0.0)).alias("at"), _hash().alias("hash"))
    end = F.struct("valid_to", F.col("valid_to_recorded_at").isNotNull().alias("k"), "valid_to_recorded_at")
    g = rows.groupBy("id").agg(
        F.max_by(F.struct(*DESCRIPTIVE, "hlc", "ingested_at"), version).alias("d"),
        F.min(F.when(F.col("valid_to").isNotNull(), end)).alias("e"),
        F.min("expired_at").alias("expired_at"), F.max("stability").alias("stability"), F.max("access_count").alias("access_count"), F.max("last_access").alias("last_access"),
        F.max("pinned_at").alias("pinned_at"), F.max("unpinned_at").alias("unpinned_at"), *[F.max(c).alias(c) for c in KEPT if c in rows.columns],
    )
    return g.select(
        "id", "d.*", F.col("e.valid_to").alias("valid_to"), F.col("e.valid_to_recorded_at").alias("valid_to_recorded_at"), "expired_at", "stability", "access_count", "last_access", "pinned_at", "unpinned_at", *[c for c in KEPT if c in rows.columns]
    )


def merge(*replicas: DataFrame) -> DataFrame:
    """The rows as they are read: ``fold`` with pinned, the later of the last pinning and unpinning."""
    pinned = F.col("pinned_at").isNotNull() & (F.col("unpinned_at").isNull() | (F.col("pinned_at") > F.col("unpinned_at")))
    return fold(*replicas).select("id", *DESCRIPTIVE, "valid_to", "valid_to_recorded_at", "expired_at", "stability", "access_count", "last_access", pinned.alias("pinned"))


def without_tombstones(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows that no tombstone of their repository, or of all (null repo_id), names."""
    wide = tombstones.filter("repo_id is null").select("id").distinct()
    own = tombstones.filter("repo_id is not null").select("id", "repo_id").distinct()
    return rows.join(wide, "id", "left_anti").join(own, ["id", "repo_id"], "left_anti")


#: Seconds by which another device's clock may be ahead.
SKEW = 2 * 86400


def admitted(rows: DataFrame, now: float) -> DataFrame:
    """Rows of a peer with rejected (the reason, or null) and their properties within bounds (null where rejected).

    A row needs an id and content.  A version clock beyond the skew is rejected, as it
    would win for ever; times of record are clamped to it instead.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(empty("id"), "id").when(empty("content"), "content").when(F.col("clock_ms") > (now + SKEW) * 1000, "clock")
    r = rows.withColumn("rejected", reason)
    ok = F.col("rejected").isNull()
    known = F.when(F.col("sensitivity").isin("normal", "sensitive", "secret"), F.col("sensitivity")).otherwise("normal")
    return r.withColumns({
        "sensitivity": F.when(ok, known), "importance": F.when(ok, F.least(F.greatest("importance", F.lit(0.0)), F.lit(1.0))),
        "ingested_at": F.when(ok, F.least("ingested_at", F.lit(now + SKEW))),
    })


def same_clock(versions: DataFrame) -> DataFrame:
    """Versions (id, clock, state) of one clock with several states: live for the greatest state, pending for the others."""
    held = versions.groupBy("id", "clock").agg(F.max("state").alias("winner"), F.min("state").alias("other")).filter("winner <> other").drop("other")
    v = versions.join(held, ["id", "clock"])
    return v.select("id", "clock", "state", (F.col("state") == F.col("winner")).alias("live"), (F.col("state") != F.col("winner")).alias("pending"))


class Applied(NamedTuple):
    """A replica after it has taken in a bundle, how far it has read each peer, and the rows that it did not take."""

    state: DataFrame
    cursors: DataFrame
    rejected: DataFrame


def successors(*replicas: DataFrame) -> DataFrame:
    """A row for every version that loses to another of the same id and clock: a pending successor of that id.

    Its own id is made of the id, the clock and what it says, so that every device that
    sees the conflict, at any time, makes the same row.
    """
    v = reduce(DataFrame.unionByName, replicas).filter("hlc is not null").withColumn("hash", _hash())
    both = v.groupBy("id", "hlc").agg(F.max("hash").alias("winner"), F.min("hash").alias("least")).filter("winner <> least")
    lost = v.join(both.select("id", "hlc", "winner"), ["id", "hlc"]).filter("hash <> winner").dropDuplicates(["id", "hlc", "hash"])
    name = F.concat(F.lit("conflict_"), F.substring(F.sha2(F.concat_ws("\u001f", "id", "hlc", "hash"), 256), 1, 24))
    nothing = {c: F.lit(None).cast(v.schema[c].dataType) for c in ("valid_to", "valid_to_recorded_at", "expired_at", "last_access", "pinned_at", "unpinned_at")}
    rest = {"supersedes": F.col("id"), "review_state": F.lit("pending"), "id": name, "ingested_at": F.lit(0.0), "stability": F.lit(1.0), "access_count": F.lit(0).cast(v.schema["access_count"].dataType)}
    return lost.withColumns(nothing).select(*[rest.get(c, F.col(c)).alias(c) for c in v.columns if c != "hash"])


def apply_bundle(state: DataFrame, bundle: DataFrame, cursors: DataFrame, tombstones: DataFrame, now: float) -> Applied:
    """Takes in the rows of a bundle that its peers' cursors (peer, seq) have not passed; to apply it again changes nothing.

    state: the columns that ``fold`` takes, with supersedes and review_state; bundle: these
    and peer, seq, repo_id, sensitivity and clock_ms; tombstones: id, repo_id.  Rows that
    ``admitted`` rejects are given back with the reason, and are passed by the cursor too.  A row that a
    tombstone names stays out.  Of two versions with the same clock the greater stands and the other
    becomes a pending successor.  Nothing depends on what was applied before in which
    order: without its cursors a replica comes to the same state.
    """
    seen = bundle.join(cursors.select("peer", F.col("seq").alias("passed")), "peer", "left").filter(F.col("passed").isNull() | (F.col("seq") > F.col("passed")))
    told = admitted(seen, now)
    good = without_tombstones(told.filter("rejected is null").withColumn("repo_id", F.col("repo_id").cast("string")), tombstones).select(*state.columns)
    out = fold(state, good, successors(state, good)).select(*state.columns)
    upto = cursors.select("peer", "seq").unionByName(seen.select("peer", "seq")).groupBy("peer").agg(F.max("seq").alias("seq"))
    return Applied(out, upto, told.filter("rejected is not null").select("peer", "seq", "id", "rejected"))
