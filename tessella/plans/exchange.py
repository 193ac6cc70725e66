"""What a replica takes in, keeps apart, and gives out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.model import DAY, MEM_SQL, NOW, memories, table
from tessella.operators import sync as Y
from tessella.operators.graph import cut
from tessella.plans.base import query
from tessella.plans.ledger import _MERGED, _side_sql, replicas

_BAD = f"""b AS (SELECT doc_id, CASE WHEN doc_id % 23 <> 5 THEN 'mem_' || doc_id::VARCHAR END AS id, CASE WHEN doc_id % 29 = 3 THEN '' ELSE text END AS content, CASE doc_id % 4 WHEN 0 THEN 'secret' WHEN 1 THEN 'odd' WHEN 2 THEN 'sensitive' END AS sensitivity, (doc_id % 9 - 2) * 0.25::DOUBLE AS importance,
  {NOW}::DOUBLE + (doc_id % 8 - 3) * 86400 AS ingested_at, CASE WHEN doc_id % 3 = 0 THEN ({NOW}::DOUBLE + (doc_id % 8 - 3) * 86400) * 1000 END AS clock_ms FROM documents)"""


def incoming(spark, sf_dir):
    """Rows as a peer may send them: without id or content, with odd kinds, numbers out of range, and clocks ahead."""
    d = F.col("doc_id")
    at = F.lit(NOW) + (d % 8 - 3) * DAY
    return table(spark, sf_dir, "documents").select(
        d, F.when(d % 23 != 5, F.concat(F.lit("mem_"), d.cast("string"))).alias("id"), F.when(d % 29 == 3, "").otherwise(F.col("text")).alias("content"),
        F.when(d % 4 == 0, "secret").when(d % 4 == 1, "odd").when(d % 4 == 2, "sensitive").alias("sensitivity"), ((d % 9 - 2) * 0.25).alias("importance"), at.alias("ingested_at"), F.when(d % 3 == 0, at * 1000).alias("clock_ms"),
    )


@query(f"WITH {_BAD}, r AS (SELECT *, CASE WHEN coalesce(id, '') = '' THEN 'id' WHEN coalesce(content, '') = '' THEN 'content' WHEN clock_ms > ({NOW}::DOUBLE + 172800) * 1000 THEN 'clock' END AS rejected FROM b) SELECT doc_id, rejected, CASE WHEN rejected IS NULL THEN CASE WHEN sensitivity IN ('normal', 'sensitive', 'secret') THEN sensitivity ELSE 'normal' END END AS sensitivity, CASE WHEN rejected IS NULL THEN least(greatest(importance, 0), 1) END AS importance, CASE WHEN rejected IS NULL THEN least(ingested_at, {NOW}::DOUBLE + 172800) END AS ingested_at FROM r")
def sync_clamps(spark, sf_dir):
    """Every incoming row with the reason for its rejection, or what it is clamped to: two days of clock skew at most."""
    r = Y.admitted(incoming(spark, sf_dir), NOW)
    return r.select("doc_id", "rejected", "sensitivity", "importance", "ingested_at")


@query(f"WITH u AS ({_side_sql(False)} UNION ALL {_side_sql(True)}), k AS (SELECT id, lpad((id % 50)::VARCHAR, 6, '0') AS clock, sha256(title || chr(31) || content || chr(31) || importance::VARCHAR) AS state FROM u), w AS (SELECT *, max(state) OVER (PARTITION BY id, clock) AS winner, count(DISTINCT state) OVER (PARTITION BY id, clock) AS states FROM k) SELECT id, clock, state, state = winner AS live, state <> winner AS pending FROM w WHERE states > 1")
def sync_conflicts(spark, sf_dir):
    """Versions with the same clock and different contents: the greatest digest stands, the others wait as its successors."""
    a, b = replicas(spark, sf_dir)
    u = a.unionByName(b).select("id", F.lpad((F.col("id") % 50).cast("string"), 6, "0").alias("clock"), F.sha2(F.concat_ws("\u001f", "title", "content", F.col("importance").cast("string")), 256).alias("state"))
    return Y.same_clock(u)


@query(f"WITH {_MERGED}, t AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1) SELECT 'row' AS kind, id, sha256(title || chr(31) || content) AS state FROM mg WHERE id > 50 AND id NOT IN (SELECT id FROM t) UNION ALL SELECT 'tombstone', id, NULL FROM t WHERE id > 50")
def sync_export(spark, sf_dir):
    """What changed since a cursor (ids after 50 here): live rows with their digest, and tombstones."""
    m = Y.merge(*replicas(spark, sf_dir))
    t = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    live = m.filter("id > 50").join(t, "id", "left_anti").select(F.lit("row").alias("kind"), "id", F.sha2(F.concat_ws("\u001f", "title", "content"), 256).alias("state"))
    return live.unionByName(t.filter("id > 50").select(F.lit("tombstone").alias("kind"), "id", F.lit(None).cast("string").alias("state")))


@query(f"WITH {_BAD}, r AS (SELECT doc_id % 5 AS peer, doc_id, CASE WHEN coalesce(id, '') = '' THEN 'id' WHEN coalesce(content, '') = '' THEN 'content' WHEN clock_ms > ({NOW}::DOUBLE + 172800) * 1000 THEN 'clock' END AS rejected FROM b) SELECT peer, count(*) AS seen, count(*) FILTER (WHERE rejected IS NULL) AS applied, count(*) FILTER (WHERE rejected IS NOT NULL) AS rejected, max(doc_id) AS cursor FROM r GROUP BY peer")
def sync_counters(spark, sf_dir):
    """Per peer: rows seen, applied and rejected, and the cursor to go on from."""
    r = Y.admitted(incoming(spark, sf_dir), NOW).withColumn("peer", F.col("doc_id") % 5)
    return r.groupBy("peer").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("rejected").isNull()).alias("applied"), F.count_if(F.col("rejected").isNotNull()).alias("rejected"), F.max("doc_id").alias("cursor"))


_PEER = f"""x AS (SELECT * REPLACE (CASE WHEN id % 12 = 1 THEN lpad((id * 2)::VARCHAR, 12, '0') ELSE hlc END AS hlc, least(importance, 1)::DOUBLE AS importance) FROM ({_side_sql(True)})), y AS (SELECT * REPLACE (importance::DOUBLE AS importance) FROM ({_side_sql(False)})),
t AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1), ok AS (SELECT * FROM x WHERE id % 7 <> 2 AND id NOT IN (SELECT id FROM t)), all_ AS (SELECT *, sha256(title || chr(31) || content || chr(31) || importance::VARCHAR) AS h FROM (SELECT * FROM y UNION ALL SELECT * FROM ok)),
v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hlc IS NOT NULL DESC, coalesce(hlc, '') DESC, ingested_at DESC, h DESC) AS n FROM all_), w AS (SELECT *, max(h) OVER (PARTITION BY id, hlc) AS top FROM all_ WHERE hlc IS NOT NULL)"""


def bundle_and_state(spark, sf_dir):
    """One side as a replica; the other as rows of three peers, every twelfth with the clock of the first side's version, and a seventh without content."""
    a, b = replicas(spark, sf_dir)
    text = lambda df: df.withColumns({"id": F.col("id").cast("string"), "importance": F.col("importance").cast("double"), "supersedes": F.lit(None).cast("string"), "review_state": F.lit(None).cast("string")})
    n = F.col("id").cast("long")
    clock = F.when(n % 12 == 1, F.lpad((n * 2).cast("string"), 12, "0")).otherwise(F.col("hlc"))
    b = text(b).withColumns({"hlc": clock, "content": F.when(n % 7 == 2, "").otherwise(F.col("content")), "peer": (n % 3).cast("string"), "seq": n, "repo_id": F.lit("1"), "sensitivity": F.lit("normal"), "clock_ms": F.lit(0.0)})
    return text(a), b


@query(f"WITH {_PEER} SELECT id::VARCHAR AS id, title, content, NULL::VARCHAR AS supersedes, NULL::VARCHAR AS review_state FROM v WHERE n = 1 UNION ALL SELECT DISTINCT 'conflict_' || substr(sha256(id::VARCHAR || chr(31) || hlc || chr(31) || h), 1, 24), title, content, id::VARCHAR, 'pending' FROM w WHERE h <> top")
def sync_apply(spark, sf_dir):
    """A bundle taken in, and then once more without its cursors, which changes nothing: equal clocks leave a pending successor."""
    state, bundle = bundle_and_state(spark, sf_dir)
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("repo_id")).distinct()
    none = bundle.select("peer", "seq").filter("false")
    first = Y.apply_bundle(state, bundle, none, gone, NOW)
    return Y.apply_bundle(cut(first.state), bundle, none, gone, NOW).state.select("id", "title", "content", "supersedes", "review_state")


# Governed changes of memory rows.

_SENS = "['normal', 'sensitive', 'secret'][(doc_id % 3 + 1)::INT]"


@query(f"WITH {MEM_SQL}, s AS (SELECT *, doc_id % 3 AS rank FROM mem WHERE {{live}}) SELECT subject_key, count(*) AS members, bool_and(trusted) AS trusted, bool_or(pinned) AS pinned, max(stability) AS stability, round(min(confidence), 9) AS confidence, ['normal', 'sensitive', 'secret'][max(rank)::INT + 1] AS sensitivity, max(access_count) AS access_count, min(valid_from) AS valid_from FROM s GROUP BY subject_key HAVING count(*) > 1".replace("{live}", "expired_at IS NULL"))
def merge_rows(spark, sf_dir):
    """What each subject's live rows become when they are merged: the strictest of each property."""
    m = memories(spark, sf_dir, content=False).filter("expired_at is null").withColumn("rank", F.col("doc_id") % 3)
    g = m.groupBy("subject_key").agg(
        F.count(F.lit(1)).alias("members"), F.bool_and("trusted").alias("trusted"), F.bool_or("pinned").alias("pinned"), F.max("stability").alias("stability"), F.round(F.min("confidence"), 9).alias("confidence"),
        F.max("rank").alias("rank"), F.max("access_count").alias("access_count"), F.min("valid_from").alias("valid_from"),
    )
    names = F.array(*map(F.lit, ("normal", "sensitive", "secret")))
    return g.filter("members > 1").select("subject_key", "members", "trusted", "pinned", "stability", "confidence", F.element_at(names, (F.col("rank") + 1).cast("int")).alias("sensitivity"), "access_count", "valid_from")


@query(f"WITH {MEM_SQL}, c AS (SELECT * FROM mem WHERE doc_id % 10 = 4 AND trusted AND valid_to IS NULL) SELECT id, valid_from, CASE WHEN id IN (SELECT id FROM c) THEN {NOW}::DOUBLE ELSE valid_to END AS valid_to, NULL AS supersedes, CASE WHEN id IN (SELECT id FROM c) THEN 'closed' ELSE 'kept' END AS state FROM mem UNION ALL SELECT id || '_v2', {NOW}::DOUBLE, NULL, id, 'successor' FROM c")
def correct_rows(spark, sf_dir):
    """A correction: each source row is closed as of now, and a successor that names it takes over."""
    m = memories(spark, sf_dir, content=False)
    hit = (F.col("doc_id") % 10 == 4) & F.col("trusted") & F.col("valid_to").isNull()
    old = m.select("id", "valid_from", F.when(hit, F.lit(NOW)).otherwise(F.col("valid_to")).alias("valid_to"), F.lit(None).cast("string").alias("supersedes"), F.when(hit, "closed").otherwise("kept").alias("state"))
    new = m.filter(hit).select(F.concat("id", F.lit("_v2")).alias("id"), F.lit(NOW).alias("valid_from"), F.lit(None).cast("double").alias("valid_to"), F.col("id").alias("supersedes"), F.lit("successor").alias("state"))
    return old.unionByName(new)


@query(f"WITH {MEM_SQL}, g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND quality = 0) SELECT 'row' AS kind, id, repo_id, NULL::DOUBLE AS erased_at FROM mem WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'tombstone', id, repo_id, {NOW}::DOUBLE FROM mem WHERE doc_id IN (SELECT doc_id FROM g)")
def erase_with_tombstones(spark, sf_dir):
    """What stays after erasing, and a tombstone, without content, for each row that went."""
    m = memories(spark, sf_dir, content=False).select("doc_id", "id", "repo_id")
    gone = table(spark, sf_dir, "labels").filter("toxic = 1 and quality = 0").select("doc_id").distinct().withColumn("gone", F.lit(True))
    j = m.join(gone, "doc_id", "left")
    return j.select(F.when(F.col("gone"), "tombstone").otherwise("row").alias("kind"), "id", "repo_id", F.when(F.col("gone"), F.lit(NOW)).alias("erased_at"))


# What evidence of a source counts for by default.
SOURCES = {"manual": 1.0, "schema": 1.0, "structured": 0.80, "regex_proximity": 0.55, "legacy_unknown": 0.50, "co_occurrence": 0.25}
_SRC = "['manual', 'schema', 'structured', 'regex_proximity', 'co_occurrence', 'other'][(event_id % 6 + 1)::INT]"


@query(f"WITH e AS (SELECT user_id AS edge, {_SRC} AS source, CASE WHEN event_id % 3 = 0 THEN value / 1000 END AS given, event_type = 'error' AS closed FROM events), c AS (SELECT edge, source, closed, coalesce(given, CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SOURCES.items()) + " ELSE 0.5::DOUBLE END) AS confidence FROM e) SELECT edge, count(*) FILTER (WHERE NOT closed) AS supports, count(*) FILTER (WHERE NOT closed) = 0 AS closed, round(coalesce(max(confidence) FILTER (WHERE NOT closed), 0), 9) AS confidence FROM c GROUP BY edge")
def edge_supports(spark, sf_dir):
    """Edges with the supports that are left, their best confidence (given, or by source), and whether the last one went."""
    source = F.element_at(F.array(*map(F.lit, ("manual", "schema", "structured", "regex_proximity", "co_occurrence", "other"))), (F.col("event_id") % 6 + 1).cast("int"))
    usual = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[source], F.lit(SOURCES["legacy_unknown"]))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("edge"), F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("value") / 1000), usual).alias("confidence"), (F.col("event_type") == "error").alias("closed"))
    n = F.count_if(~F.col("closed"))
    return e.groupBy("edge").agg(n.alias("supports"), (n == 0).alias("closed"), F.round(F.coalesce(F.max(F.when(~F.col("closed"), F.col("confidence"))), F.lit(0.0)), 9).alias("confidence"))
