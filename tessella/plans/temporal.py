"""Scans, bi-temporal reads and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.model import BASE, DAY, MEM_SQL, NOW, memories, table
from tessella.operators.temporal import SearchFilter, supersession, visible, visible_sql
from tessella.operators import lifecycle as L
from tessella.plans.base import query

PAST = BASE + 20 * DAY
KNOWN = BASE + 40 * DAY


def _scan(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return memories(spark, sf_dir, content=False).filter(SearchFilter(**kw).predicate())


@query(f"WITH {MEM_SQL} SELECT id, mtype, scope FROM mem WHERE {visible_sql()}")
def bitemporal_current(spark, sf_dir):
    return _scan(spark, sf_dir).select("id", "mtype", "scope")


@query(f"WITH {MEM_SQL} SELECT id, mtype FROM mem WHERE {visible_sql(PAST, NOW)}")
def bitemporal_asof(spark, sf_dir):
    return _scan(spark, sf_dir, as_of=PAST).select("id", "mtype")


@query(f"WITH {MEM_SQL} SELECT id, valid_to FROM mem WHERE {visible_sql(KNOWN, BASE + 30.5 * DAY)}")
def bitemporal_known_at(spark, sf_dir):
    """What held at one time as it was known at another: an end is unseen before it was recorded."""
    return _scan(spark, sf_dir, valid_at=KNOWN, known_at=BASE + 30.5 * DAY).select("id", "valid_to")


@query(f"WITH {MEM_SQL} SELECT id, scope, repo_id FROM mem WHERE workspace_id = 'en' AND ((scope = 'repo' AND repo_id = 'src3') OR scope IN ('workspace', 'user')) AND {visible_sql()}")
def scope_ancestors(spark, sf_dir):
    return _scan(spark, sf_dir, workspace_id="en", repo_id="src3").select("id", "scope", "repo_id")


@query(f"WITH {MEM_SQL} SELECT id, scope FROM mem WHERE workspace_id = 'en' AND scope <> 'session' AND mtype IN ('semantic', 'procedural') AND {visible_sql()}")
def scope_types(spark, sf_dir):
    return _scan(spark, sf_dir, workspace_id="en", mtypes=("semantic", "procedural")).select("id", "scope")


@query(f"WITH {MEM_SQL} SELECT id, ingested_at FROM mem WHERE {visible_sql()} AND trusted ORDER BY ingested_at DESC, id LIMIT 100")
def scan_newest(spark, sf_dir):
    """Prompt-eligible rows, newest first."""
    return _scan(spark, sf_dir).filter("trusted").select("id", "ingested_at").orderBy(F.desc("ingested_at"), "id").limit(100)


@query(f"WITH {MEM_SQL} SELECT id FROM mem WHERE id > 'mem_00000100' AND {visible_sql()} ORDER BY id LIMIT 50")
def scan_keyset_page(spark, sf_dir):
    return _scan(spark, sf_dir).filter("id > 'mem_00000100'").select("id").orderBy("id").limit(50)


@query(f"WITH {MEM_SQL} SELECT workspace_id, count(*) AS n, count(*) FILTER (WHERE {visible_sql()}) AS live, count(*) FILTER (WHERE trusted) AS eligible FROM mem GROUP BY workspace_id")
def count_eligible(spark, sf_dir):
    return memories(spark, sf_dir, content=False).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(visible()).alias("live"), F.count_if(F.col("trusted")).alias("eligible"))


@query(f"WITH {MEM_SQL} SELECT DISTINCT id FROM mem JOIN events ON event_id = doc_id WHERE {visible_sql()}")
def visible_ids(spark, sf_dir):
    """Which of the given ids are visible: a semi-join."""
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"))
    return _scan(spark, sf_dir).join(ids, "doc_id", "left_semi").select("id")


@query(f"WITH {MEM_SQL} SELECT subject_key, count(*) AS versions, max(valid_from) AS latest, arg_max(id, valid_from) AS id FROM mem WHERE {visible_sql()} GROUP BY subject_key")
def live_claims(spark, sf_dir):
    m = _scan(spark, sf_dir)
    return m.groupBy("subject_key").agg(F.count(F.lit(1)).alias("versions"), F.max("valid_from").alias("latest"), F.max_by("id", "valid_from").alias("id"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority, lead(o_orderdate) OVER w AS valid_to, (row_number() OVER w)::INTEGER AS version FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)")
def supersession_chain(spark, sf_dir):
    """Each claim ends where its successor begins."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return supersession(o, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01') SELECT o_custkey, o_orderpriority, o_orderkey FROM v WHERE n = 1")
def claims_asof(spark, sf_dir):
    """The state of every claim at a time: the latest row up to it, without a window."""
    o = table(spark, sf_dir, "orders").filter("o_orderdate <= timestamp '1997-06-01'")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "o_orderpriority", F.col("m.o_orderkey").alias("o_orderkey"))


@query("WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') SELECT e.event_id, max(v.ts) AS viewed FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts GROUP BY e.event_id")
def asof_join(spark, sf_dir):
    """The last view before each purchase: one pass over both, by a running maximum."""
    ev = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w)
    return ev.withColumn("viewed", last).filter("event_type = 'purchase'").select("event_id", "viewed")


@query("SELECT r_name AS workspace, n_name AS repo, count(*) AS sessions FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL")
def scope_hierarchy(spark, sf_dir):
    """Sessions below repos below workspaces."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("workspace"), F.col("n_name").alias("repo")).agg(F.sum("k").alias("sessions"))


@query("WITH s AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS n FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, text FROM s WHERE n = 1")
def sessions_last(spark, sf_dir):
    """The last assistant turn of every session."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.min(F.struct((-F.col("turn")).alias("t"), "text")).alias("m")).select("conv_id", (-F.col("m.t")).alias("turn"), F.col("m.text").alias("text"))


@query("WITH s AS (SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, max_by(role, turn) AS last_role FROM (SELECT conv_id, turn, max(role) AS role FROM conversations GROUP BY ALL) GROUP BY conv_id) SELECT conv_id, turns, CASE WHEN last_role = 'assistant' THEN 'ended' WHEN turns = 1 THEN 'started' ELSE 'open' END AS state FROM s")
def session_lifecycle(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"))
    s = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last"))
    return s.select("conv_id", "turns", F.when(F.col("last") == "assistant", "ended").when(F.col("turns") == 1, "started").otherwise("open").alias("state"))


@query("WITH n AS (SELECT nation.*, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) SELECT n_regionkey, n_name FROM n WHERE r = 1")
def get_or_create(spark, sf_dir):
    """The live row of each key: what an upsert keeps."""
    n = table(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("n_name"))


_CALLS = """s AS (SELECT DISTINCT conv_id AS id, CASE conv_id % 5 WHEN 0 THEN 'summarized' WHEN 1 THEN 'archived' ELSE 'active' END AS status, CASE WHEN conv_id % 5 = 0 THEN 'kept 0' END AS summary FROM conversations),
r AS (SELECT conv_id * 1000 + turn AS request, CASE WHEN conv_id % 7 = 3 THEN -conv_id - 1 ELSE conv_id END AS id, turn::DOUBLE AS at_, 'kept ' || (turn // 4)::VARCHAR AS summary FROM conversations WHERE role = 'assistant'),
f AS (SELECT id, min(at_) AS at_, min_by(summary, at_) AS summary, min_by(request, at_) AS request FROM r GROUP BY id)"""


@query(f"WITH {_CALLS} SELECT r.request, r.id, CASE WHEN s.id IS NULL THEN 'missing' WHEN s.status = 'active' AND f.request = r.request THEN 'ended' WHEN s.status = 'active' AND f.summary = r.summary THEN 'unchanged' WHEN s.status = 'summarized' AND s.summary = r.summary THEN 'unchanged' ELSE 'conflict' END AS result FROM r JOIN f USING (id) LEFT JOIN s ON s.id = r.id")
def session_close(spark, sf_dir):
    """What comes of every assistant turn as a request to close its conversation."""
    c = table(spark, sf_dir, "conversations")
    k, none = F.col("conv_id"), F.lit(None).cast("array<string>")
    status = F.when(k % 5 == 0, "summarized").when(k % 5 == 1, "archived").otherwise("active")
    s = c.select("conv_id").distinct().select(k.alias("id"), status.alias("status"), F.lit(None).cast("double").alias("ended_at"), F.when(k % 5 == 0, "kept 0").alias("summary"), none.alias("open_threads"), F.lit(None).cast("string").alias("outcome"))
    said = F.concat(F.lit("kept "), F.expr("turn div 4").cast("string"))
    r = c.filter("role = 'assistant'").select((k * 1000 + F.col("turn")).alias("request"), F.when(k % 7 == 3, -k - 1).otherwise(k).alias("id"), F.col("turn").cast("double").alias("at"), said.alias("summary"), none.alias("open_threads"), F.lit(None).cast("string").alias("outcome"))
    return L.close_sessions(s, r).results


@query("WITH e AS (SELECT n_name AS name, 'old_' || n_nationkey::VARCHAR AS id, 0.0::DOUBLE AS created_at, 'kept' AS settings FROM nation WHERE n_nationkey % 2 = 0), a AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 3 = 0 THEN 'city ' || (c_custkey % 100)::VARCHAR ELSE n_name END AS name, (c_custkey % 17)::DOUBLE AS tm FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT name, min((tm, request)) AS m FROM a GROUP BY name) SELECT * FROM e UNION ALL SELECT f.name, 'ws_' || substr(sha256(f.name), 1, 20), a.tm, 'by ' || a.request::VARCHAR FROM f JOIN a ON a.request = f.m[2] WHERE f.name NOT IN (SELECT name FROM e)")
def workspace_upsert(spark, sf_dir):
    """Half of the nations as workspaces, and what customers ask for: a name that is there stays, of several requests the first makes it."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    e = n.filter("n_nationkey % 2 = 0").select("name", F.concat(F.lit("old_"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(0.0).alias("created_at"), F.lit("kept").alias("settings"))
    c = F.col("c_custkey")
    a = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    a = a.select(c.alias("request"), F.when(c % 3 == 0, F.concat(F.lit("city "), (c % 100).cast("string"))).otherwise(F.col("name")).alias("name"), (c % 17).cast("double").alias("at"), F.concat(F.lit("by "), c.cast("string")).alias("settings"))
    return L.get_or_create(e, a)
