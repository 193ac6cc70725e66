"""Sync, receipts, savings, statistics and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scoring as S
from tessella.model import DAY, MEM_SQL, NOW, memories, table
from tessella.operators import receipts as R
from tessella.operators import sync as Y
from tessella.plans.base import query
from tessella.plans.recall import RET_SQL


def replicas(spark, sf_dir):
    """Two states of the documents; the second has later clocks for some and other intervals."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def side(second: bool):
        title = F.concat(F.lit("b" if second else "a"), d.cast("string"))
        late = d % 3 == (0 if second else 1)
        return docs.filter((d % 10 != 1) if second else (d % 10 != 2)).select(
            d.alias("id"), title.alias("title"), F.sha2("text", 256).alias("content"), (d % 7 + (1 if second else 0)).alias("importance"),
            F.when(late, F.lpad((d * 2 + (1 if second else 0)).cast("string"), 12, "0")).alias("hlc"), d.cast("double").alias("ingested_at"),
            F.when(d % 4 == 0, d + (5.0 if second else 9.0)).alias("valid_to"), F.when(d % 8 == 0, d + (50.0 if second else 40.0)).alias("valid_to_recorded_at"),
            F.when(d % 6 == 0, d + (1.0 if second else 2.0)).alias("expired_at"), (d % 20 + (1.5 if second else 1.0)).alias("stability"), (d % 9 + (0 if second else 2)).alias("access_count"),
            (d * 10.0 + (3 if second else 1)).alias("last_access"), F.when(d % 5 == 0, d + (7.0 if second else 1.0)).alias("pinned_at"), F.when(d % 10 == 0, d + (2.0 if second else 9.0)).alias("unpinned_at"),
        )

    return side(False), side(True)


def _side_sql(b: bool) -> str:
    x = lambda p, q: q if b else p
    return f"""SELECT doc_id AS id, '{x('a', 'b')}' || doc_id::VARCHAR AS title, sha256(text) AS content, doc_id % 7 + {x(0, 1)} AS importance, CASE WHEN doc_id % 3 = {x(1, 0)} THEN lpad((doc_id * 2 + {x(0, 1)})::VARCHAR, 12, '0') END AS hlc, doc_id::DOUBLE AS ingested_at,
    CASE WHEN doc_id % 4 = 0 THEN doc_id + {x(9.0, 5.0)}::DOUBLE END AS valid_to, CASE WHEN doc_id % 8 = 0 THEN doc_id + {x(40.0, 50.0)}::DOUBLE END AS rec, CASE WHEN doc_id % 6 = 0 THEN doc_id + {x(2.0, 1.0)}::DOUBLE END AS expired_at, doc_id % 20 + {x(1.0, 1.5)}::DOUBLE AS stability,
    doc_id % 9 + {x(2, 0)} AS access_count, doc_id * 10.0::DOUBLE + {x(1, 3)} AS last_access, CASE WHEN doc_id % 5 = 0 THEN doc_id + {x(1.0, 7.0)}::DOUBLE END AS pinned_at, CASE WHEN doc_id % 10 = 0 THEN doc_id + {x(9.0, 2.0)}::DOUBLE END AS unpinned_at FROM documents WHERE doc_id % 10 <> {x(2, 1)}"""


_MERGED = f"""u AS ({_side_sql(False)} UNION ALL {_side_sql(True)}), v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hlc IS NOT NULL DESC, coalesce(hlc, '') DESC, ingested_at DESC, sha256(title || chr(31) || content || chr(31) || importance::VARCHAR) DESC) AS n FROM u),
e AS (SELECT id, valid_to, rec, row_number() OVER (PARTITION BY id ORDER BY valid_to, rec NULLS FIRST) AS n FROM u WHERE valid_to IS NOT NULL),
g AS (SELECT id, min(expired_at) AS expired_at, max(stability) AS stability, max(access_count) AS access_count, max(last_access) AS last_access, max(pinned_at) AS p, max(unpinned_at) AS un FROM u GROUP BY id),
mg AS (SELECT g.id, v.title, v.content, v.importance, e.valid_to, e.rec AS valid_to_recorded_at, g.expired_at, g.stability, g.access_count, g.last_access, p IS NOT NULL AND (un IS NULL OR p > un) AS pinned FROM g JOIN v ON g.id = v.id AND v.n = 1 LEFT JOIN e ON g.id = e.id AND e.n = 1)"""


@query(f"WITH {_MERGED} SELECT * FROM mg")
def crdt_merge(spark, sf_dir):
    return Y.merge(*replicas(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT id, title FROM mg WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0) AND NOT (id % 5 = 3 AND id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def tombstone_antijoin(spark, sf_dir):
    """Merged rows without those that a tombstone names, for all repositories or for their own."""
    m = Y.merge(*replicas(spark, sf_dir)).withColumn("repo_id", (F.col("id") % 5).cast("string"))
    t = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, None).otherwise(F.lit("3")).alias("repo_id"))
    return Y.without_tombstones(m, t).select("id", "title")


_CHAIN = "p AS (SELECT event_id, user_id, sha256(event_id::VARCHAR || chr(31) || event_type || chr(31) || props) AS own, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events), h AS (SELECT event_id, user_id, own, sequence, NULL::VARCHAR AS prev_hash, sha256('genesis' || chr(31) || own || chr(31) || '1') AS receipt_hash FROM p WHERE sequence = 1 UNION ALL SELECT p.event_id, p.user_id, p.own, p.sequence, h.receipt_hash, sha256(h.receipt_hash || chr(31) || p.own || chr(31) || p.sequence::VARCHAR) FROM h JOIN p ON p.user_id = h.user_id AND p.sequence = h.sequence + 1)"


def _payload():
    return R.payload_hash(F.col("event_id").cast("string"), F.col("event_type"), F.col("props"))


def _chain(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props")
    return R.chain(ev, ["user_id"], ["event_id"], _payload())


@query(f"WITH RECURSIVE {_CHAIN} SELECT event_id, sequence, receipt_hash, prev_hash FROM h")
def receipt_chain(spark, sf_dir):
    """Every event's receipt in the chain of its user: each hash holds the one before."""
    return _chain(spark, sf_dir).select("event_id", "sequence", "receipt_hash", "prev_hash")


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, max_by(receipt_hash, sequence) AS head, count(*) AS receipts FROM h GROUP BY user_id")
def receipt_heads(spark, sf_dir):
    """Anchors: the head and the length of every chain."""
    return R.heads(_chain(spark, sf_dir), ["user_id"])


@query("SELECT user_id, CASE WHEN user_id % 5 = 0 AND count(*) = 1 THEN 'missing' WHEN user_id % 5 = 0 THEN 'truncated' WHEN user_id % 7 = 0 THEN 'forked' WHEN user_id % 11 = 0 AND count(*) > 1 THEN 'extended' WHEN user_id % 11 = 0 THEN 'unanchored' ELSE 'ok' END AS status, count(*) - (user_id % 5 = 0)::INT AS receipts FROM events GROUP BY user_id")
def receipt_anchor_check(spark, sf_dir):
    """Chains that were tampered with after they were anchored: the last receipt taken away, the first one's contents changed and
    all hashes made anew, or receipts added."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    first = ev.groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    ev = ev.join(first, "user_id")
    u, last = F.col("user_id"), F.col("event_id") == F.col("last")
    chain = lambda rows: R.chain(rows, ["user_id"], ["event_id"], _payload())
    anchors = R.heads(chain(ev.filter(~((u % 11 == 0) & (u % 5 != 0) & (u % 7 != 0) & last))), ["user_id"])
    forged = F.when((u % 7 == 0) & (F.col("event_id") == F.col("first")), F.concat("props", F.lit("!"))).otherwise(F.col("props"))
    now = chain(ev.filter(~((u % 5 == 0) & last)).withColumn("props", forged))
    return R.check_anchors(now, anchors, ["user_id"])


@query("SELECT event_id, user_id, sequence, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE own END AS own FROM (SELECT event_id, user_id, event_type, sha256(event_id::VARCHAR || chr(31) || event_type || chr(31) || props) AS own, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events) WHERE n <= 5")
def receipt_list(spark, sf_dir):
    """The five newest receipts of every chain as the public sees them: no payload, and no digest of what failed."""
    from pyspark.sql import Window

    r = _chain(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("sequence")))).filter("n <= 5")
    return r.select("event_id", "user_id", "sequence", "event_type", F.when(F.col("event_type") != "error", F.col("own")).alias("own"))


@query("WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_id % 500 = 7) AS lost FROM events GROUP BY 1), k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events), r AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM k WHERE event_id % 500 <> 7) SELECT user_id, count(*) AS receipts, count(*) FILTER (WHERE s <> coalesce(last, 0) + 1) AS gaps, count(*) FILTER (WHERE s <> coalesce(last, 0) + 1) AS broken FROM r GROUP BY user_id")
def receipt_chain_verify(spark, sf_dir):
    """Chains from which some receipts were taken: the gaps and the links that they break."""
    return R.verify(_chain(spark, sf_dir).filter("event_id % 500 <> 7"), ["user_id"])


_SAV = """t AS (SELECT event_id, user_id, ts, event_type AS operation, ['estimate', 'regex', 'model'][(event_id % 3 + 1)::INT] AS token_counter, 'agent_' || (user_id % 4)::VARCHAR AS agent, event_type = 'error' AS failed,
  floor(value)::BIGINT - CASE WHEN event_id % 50 = 3 THEN 1000000 ELSE 0 END AS emitted, CASE WHEN event_id % 20 <> 7 THEN coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 10 END AS baseline FROM events),
v AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN baseline IS NULL OR emitted IS NULL THEN 'missing' WHEN baseline < 0 OR emitted < 0 THEN 'negative' ELSE '' END AS bad FROM t)"""
_SUMS = "count(*) AS receipts, count(*) FILTER (WHERE bad = '') AS valid, count(*) FILTER (WHERE bad = 'failed') AS invalid_failed, count(*) FILTER (WHERE bad = 'missing') AS invalid_missing, count(*) FILTER (WHERE bad = 'negative') AS invalid_negative, coalesce(sum(baseline) FILTER (WHERE bad = ''), 0)::BIGINT AS baseline, coalesce(sum(emitted) FILTER (WHERE bad = ''), 0)::BIGINT AS emitted, coalesce(sum(greatest(baseline - emitted, 0)) FILTER (WHERE bad = ''), 0)::BIGINT AS saved, count(*) FILTER (WHERE bad = '' AND emitted > baseline) AS grown, round(CASE WHEN coalesce(sum(baseline) FILTER (WHERE bad = ''), 0) = 0 THEN 0 ELSE sum(greatest(baseline - emitted, 0)) FILTER (WHERE bad = '')::DOUBLE / sum(baseline) FILTER (WHERE bad = '') END, 9) AS ratio"


def _usage(spark, sf_dir):
    """Deliveries, made from the events: some lack a baseline, some have a negative count, errors failed."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        "event_id", "user_id", "ts", F.col("event_type").alias("operation"), F.element_at(F.array(*map(F.lit, ("estimate", "regex", "model"))), (i % 3 + 1).cast("int")).alias("token_counter"),
        F.concat(F.lit("agent_"), (F.col("user_id") % 4).cast("string")).alias("agent"), (F.col("event_type") == "error").alias("failed"),
        (F.floor("value") - F.when(i % 50 == 3, 1000000).otherwise(0)).alias("emitted"), F.when(i % 20 != 7, F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) * 10).alias("baseline"),
    )


@query(f"WITH {_SAV} SELECT token_counter, operation, {_SUMS} FROM v GROUP BY ALL")
def context_savings(spark, sf_dir):
    """Savings by token counter and operation; what cannot count is counted by its reason."""
    return R.savings(_usage(spark, sf_dir), "token_counter", "operation")


@query(f"WITH {_SAV} SELECT CAST(ts AS DATE)::VARCHAR AS day, token_counter, {_SUMS} FROM v GROUP BY ALL")
def savings_by_day(spark, sf_dir):
    return R.savings(_usage(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "token_counter")


@query(f"WITH {_SAV} SELECT agent, token_counter, {_SUMS} FROM v GROUP BY ALL")
def savings_by_agent(spark, sf_dir):
    return R.savings(_usage(spark, sf_dir), "agent", "token_counter")


@query(f"WITH {_SAV}, w AS (SELECT v.*, n_name AS workspace, 'repo_' || (user_id % 3)::VARCHAR AS repo FROM v JOIN nation ON n_nationkey = user_id % 25) SELECT workspace, repo, token_counter, {_SUMS} FROM w GROUP BY ALL")
def savings_by_workspace(spark, sf_dir):
    """By workspace and repository, which are looked up by the user."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("workspace"))
    u = _usage(spark, sf_dir).withColumn("key", F.col("user_id") % 25).join(names, "key").withColumn("repo", F.concat(F.lit("repo_"), (F.col("user_id") % 3).cast("string")))
    return R.savings(u, "workspace", "repo", "token_counter")


@query("WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'adaptive_context' WHEN 1 THEN 'recall' WHEN 2 THEN 'grounded_recall' WHEN 3 THEN 'proactive_context' ELSE 'remember' END AS op, CASE WHEN event_id % 2 = 0 THEN 'recall_context' ELSE '' END AS intent, CASE event_id % 4 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'history_fallback' WHEN 2 THEN 'history_bypass' ELSE 'low_confidence_abstain' END AS mode FROM events), b AS (SELECT *, CASE WHEN op = 'adaptive_context' AND mode = 'retrieval' THEN 'history_retrieval' WHEN op = 'adaptive_context' THEN mode WHEN (op = 'recall' AND intent = 'recall_context') OR op IN ('grounded_recall', 'proactive_context') THEN 'packed_context' ELSE 'unclassified' END AS basis FROM c) SELECT basis, CASE WHEN basis = 'history_retrieval' THEN 'high' WHEN basis IN ('history_fallback', 'packed_context') THEN 'medium' WHEN basis IN ('history_bypass', 'low_confidence_abstain') THEN 'none' ELSE 'unknown' END AS confidence, basis IN ('history_retrieval', 'history_fallback', 'packed_context') AS eligible, count(*) AS n FROM b GROUP BY ALL")
def savings_classify(spark, sf_dir):
    pick = lambda i, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % i + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(pick(5, "adaptive_context", "recall", "grounded_recall", "proactive_context", "remember").alias("op"), pick(2, "recall_context", "").alias("intent"), pick(4, "retrieval", "history_fallback", "history_bypass", "low_confidence_abstain").alias("mode"))
    return e.withColumns(R.classify(F.col("op"), F.col("intent"), F.col("mode"))).groupBy("basis", "confidence", "eligible").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MEM_SQL} SELECT workspace_id, count(*) AS n, round(exp(-avg(greatest({NOW}::DOUBLE - coalesce(last_access, valid_from), 0) / 86400) / avg(stability)), 9) AS retention FROM mem GROUP BY workspace_id")
def workspace_stats(spark, sf_dir):
    """Counts and the retention of the average row (not the average retention: see health_overview)."""
    age = F.greatest(F.lit(NOW) - F.coalesce("last_access", "valid_from"), F.lit(0.0)) / DAY
    return memories(spark, sf_dir, content=False).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.exp(-F.avg(age) / F.avg("stability")), 9).alias("retention"))


@query(f"WITH {MEM_SQL}, r AS (SELECT *, {RET_SQL} AS r FROM mem) SELECT count(*) AS n, count(*) FILTER (WHERE r > 0.5) AS strong, count(*) FILTER (WHERE r > 0.2 AND r <= 0.5) AS fading, count(*) FILTER (WHERE r <= 0.2) AS weak, round(avg(r), 9) AS retention, count(*) FILTER (WHERE last_access IS NULL) AS never FROM r")
def health_overview(spark, sf_dir):
    m = memories(spark, sf_dir, content=False).withColumn("r", S.retention(F.col("last_access"), F.col("stability")))
    r = F.col("r")
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_if(r > 0.5).alias("strong"), F.count_if((r > 0.2) & (r <= 0.5)).alias("fading"), F.count_if(r <= 0.2).alias("weak"), F.round(F.avg(r), 9).alias("retention"), F.count_if(F.col("last_access").isNull()).alias("never"))


@query(f"WITH {MEM_SQL}, r AS (SELECT id, round({RET_SQL}, 9) AS retention, ({NOW}::DOUBLE - last_access) / 86400 AS age FROM mem) SELECT id, retention FROM r WHERE age >= 30 AND retention <= 0.1")
def stale_finder(spark, sf_dir):
    m = memories(spark, sf_dir, content=False).filter((F.lit(NOW) - F.col("last_access")) / DAY >= 30)
    return m.select("id", F.round(S.retention(F.col("last_access"), F.col("stability")), 9).alias("retention")).filter("retention <= 0.1")


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL")
def interactions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
