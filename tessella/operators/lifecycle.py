"""Sessions that are closed once, and workspaces that are made once, for tables of requests."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Closed(NamedTuple):
    sessions: DataFrame
    results: DataFrame


def _handoff(prefix: str = "") -> Column:
    """What a session leaves behind; nulls count as empty, so that a retry that leaves out a field is the same."""
    return F.struct(
        F.coalesce(f"{prefix}summary", F.lit("")).alias("summary"), F.coalesce(f"{prefix}open_threads", F.array().cast("array<string>")).alias("open_threads"), F.coalesce(f"{prefix}outcome", F.lit("")).alias("outcome")
    )


def close_sessions(sessions: DataFrame, requests: DataFrame) -> Closed:
    """Sessions (id, status, ended_at, summary, open_threads, outcome) after requests (request, id, at, summary, open_threads, outcome) to close them.

    The first request (by at, then request) for an active session ends it: ``ended``.
    Another one, or one for a session that was ended before, is ``unchanged`` if it leaves
    the same behind, else ``conflict``, which overwrites nothing; so is one for a session
    of any other status.  Without such a session it is ``missing``.  Requests and session ids are distinct.
    A session with very many requests is one aggregate: requests are not sorted.
    """
    first = requests.groupBy("id").agg(F.min_by(F.struct(F.col("request"), F.col("at"), _handoff().alias("left")), F.struct("at", "request")).alias("first"))
    now = sessions.join(first, "id", "left")
    ends = (F.col("status") == "active") & F.col("first").isNotNull()
    known = now.select("id", F.lit(True).alias("there"), ends.alias("ends"), F.col("first.request").alias("winner"), F.when(ends, F.col("first.left")).when(F.col("status") == "summarized", _handoff()).alias("stands"))
    each = requests.select("request", "id", _handoff().alias("left")).join(known, "id", "left")
    result = F.when(F.col("there").isNull(), "missing").when(F.col("ends") & (F.col("winner") == F.col("request")), "ended").when(F.col("stands").isNotNull() & (F.col("stands") == F.col("left")), "unchanged").otherwise("conflict")
    pick = lambda c: F.when(ends, F.col(f"first.left.{c}")).otherwise(F.col(c)).alias(c)
    after = now.select("id", F.when(ends, "summarized").otherwise(F.col("status")).alias("status"), F.when(ends, F.col("first.at")).otherwise(F.col("ended_at")).alias("ended_at"), *map(pick, ("summary", "open_threads", "outcome")))
    return Closed(after, each.select("request", "id", result.alias("result")))


def get_or_create(existing: DataFrame, asked: DataFrame, prefix: str = "ws_") -> DataFrame:
    """The table of (name, id, created_at, settings) with a row for every name that was asked for (request, name, at, settings).

    A name that is there stays as it is; of several requests for a new one the first (by
    at, then request) makes it.  Its id is made of its name, so that a repeated run, or another device, makes
    the same row.  Null names are asked for by nobody.
    """
    first = asked.filter("name is not null").groupBy("name").agg(F.min_by(F.struct("at", "settings"), F.struct("at", "request")).alias("first"))
    new = first.join(existing.select("name"), "name", "left_anti")
    key = F.concat(F.lit(prefix), F.substring(F.sha2(F.col("name"), 256), 1, 20))
    return existing.select("name", "id", "created_at", "settings").unionByName(new.select("name", key.alias("id"), F.col("first.at").alias("created_at"), F.col("first.settings").alias("settings")))
