"""Projections, presets, approvals, clocks, versions and health of stored rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.model import MEM_SQL, NOW, memories, table
from tessella.operators import grounding as GR
from tessella.operators.temporal import visible, visible_sql
from tessella.plans.base import query


@query("WITH e AS (SELECT p_partkey AS id, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 5 <> 0 THEN min(p_partkey) OVER (PARTITION BY p_name)::VARCHAR END AS canonical_id FROM part) SELECT e.id, c.p_name AS name FROM e JOIN part c ON c.p_partkey = coalesce(nullif(e.canonical_id, ''), e.id::VARCHAR)::BIGINT")
def canonical_join(spark, sf_dir):
    """Every entity with the name of the one that stands for it; an empty or null reference is to itself."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    least = p.groupBy("p_name").agg(F.min("id").alias("least"))
    e = p.join(least, "p_name").select("id", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 5 != 0, F.col("least").cast("string")).alias("canonical_id"))
    e = e.withColumn("to", F.coalesce(F.nullif("canonical_id", F.lit("")), F.col("id").cast("string")).cast("long"))
    return e.join(p.select(F.col("id").alias("to"), F.col("p_name").alias("name")), "to").select("id", "name")


@query(f"WITH {MEM_SQL} SELECT id, mtype, substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 160) AS excerpt, {T.estimate_tokens_sql('content')} AS tokens, round(confidence, 3) AS confidence FROM mem WHERE trusted AND {visible_sql()} ORDER BY valid_from DESC, id LIMIT 40")
def compact_recall(spark, sf_dir):
    """What a list of results shows of a memory: a line of text and its cost; the newest 40."""
    m = memories(spark, sf_dir).filter(F.col("trusted") & visible()).orderBy(F.desc("valid_from"), "id").limit(40)
    line = F.substring(F.trim(F.regexp_replace("content", "\\s+", " ")), 1, 160)
    return m.select("id", "mtype", line.alias("excerpt"), T.estimate_tokens(F.col("content")).alias("tokens"), F.round("confidence", 3).alias("confidence"))


# Stability in days and importance of a retention label.
PRESETS = {"ephemeral": (0.25, 0.1), "normal": (1.0, 0.5), "critical": (8.0, 0.9)}
_LABEL = "CASE WHEN doc_id % 7 = 1 THEN 'ephemeral' ELSE ['ephemeral', 'normal', 'critical', 'odd'][(doc_id % 4 + 1)::INT] END"
_KNOWN = f"CASE WHEN {_LABEL} IN ('ephemeral', 'normal', 'critical') THEN {_LABEL} ELSE 'normal' END"


@query(f"WITH {MEM_SQL}, l AS (SELECT id, importance, {_KNOWN} AS label FROM mem) SELECT id, label, CASE label " + " ".join(f"WHEN '{k}' THEN {s}::DOUBLE" for k, (s, _) in PRESETS.items()) + " END AS stability, greatest(importance, CASE label " + " ".join(f"WHEN '{k}' THEN {i}::DOUBLE" for k, (_, i) in PRESETS.items()) + " END) AS importance FROM l")
def retention_presets(spark, sf_dir):
    """Stability and importance by a supervisor's label; unknown labels are normal, what is not to be retained is ephemeral,
    and the caller's importance is a floor."""
    said = F.element_at(F.array(*map(F.lit, ("ephemeral", "normal", "critical", "odd"))), (F.col("doc_id") % 4 + 1).cast("int"))
    label = F.when(F.col("doc_id") % 7 == 1, "ephemeral").when(said.isin(*PRESETS), said).otherwise("normal")
    m = memories(spark, sf_dir, content=False).select("id", "importance", label.alias("label"))
    preset = lambda k: F.create_map(*[F.lit(x) for name, v in PRESETS.items() for x in (name, v[k])])[F.col("label")]
    return m.select("id", "label", preset(0).alias("stability"), F.greatest("importance", preset(1)).alias("importance"))


@query(f"WITH {MEM_SQL}, a AS (SELECT id FROM mem WHERE NOT trusted AND doc_id % 2 = 0 AND valid_to IS NULL) SELECT id, trusted, CASE WHEN id IN (SELECT id FROM a) THEN {NOW}::DOUBLE ELSE valid_to END AS valid_to, NULL::VARCHAR AS approved_from FROM mem UNION ALL SELECT id || '_approved', true, NULL, id FROM a")
def approve_for_prompt(spark, sf_dir):
    """Approved rows: the untrusted source is closed, and a trusted successor that names it takes its place."""
    m = memories(spark, sf_dir, content=False)
    hit = ~F.col("trusted") & (F.col("doc_id") % 2 == 0) & F.col("valid_to").isNull()
    old = m.select("id", "trusted", F.when(hit, F.lit(NOW)).otherwise(F.col("valid_to")).alias("valid_to"), F.lit(None).cast("string").alias("approved_from"))
    return old.unionByName(m.filter(hit).select(F.concat("id", F.lit("_approved")).alias("id"), F.lit(True).alias("trusted"), F.lit(None).cast("double").alias("valid_to"), F.col("id").alias("approved_from")))


@query(f"WITH {MEM_SQL} SELECT subject_key, id, round(importance * confidence, 9) AS score FROM mem WHERE {visible_sql()} QUALIFY row_number() OVER (PARTITION BY subject_key ORDER BY round(importance * confidence, 9) DESC, id) = 1")
def family_representatives(spark, sf_dir):
    """The best live row of every family of claims; one aggregation, without sorting a family."""
    m = memories(spark, sf_dir, content=False).filter(visible()).withColumn("score", F.round(F.col("importance") * F.col("confidence"), 9))
    g = m.groupBy("subject_key").agg(F.min(F.struct((-F.col("score")).alias("less"), "id")).alias("b"))
    return g.select("subject_key", "b.id", (-F.col("b.less")).alias("score"))


@query("WITH e AS (SELECT event_id, user_id, epoch_ms(ts) // 3600000 * 3600000 AS ms FROM events), h AS (SELECT *, max(ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS l FROM e) SELECT event_id, l AS physical, row_number() OVER (PARTITION BY user_id, l ORDER BY event_id) - 1 AS counter FROM h")
def clock_advance(spark, sf_dir):
    """Hybrid clocks of every user's events in order: the latest physical time so far, and how many before it had the same.

    Advancing one clock at a time is a running maximum and a running number, so that it needs no loop.
    """
    # In whole milliseconds first, as epoch_ms gives them: half a millisecond before an hour is that hour.  Zones play no part.
    since = "ts - TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    hours = F.expr(f"cast(cast({since} + if({since} < INTERVAL '0' SECOND, INTERVAL '-0.0005' SECOND, INTERVAL '0.0005' SECOND) as interval hour) as long)")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (hours * 3600000).alias("ms"))
    last = F.asc_nulls_last("event_id")
    # Events of one number are taken by time, so that the result does not depend on how rows arrive.
    h = e.withColumn("physical", F.max("ms").over(Window.partitionBy("user_id").orderBy(last, F.asc_nulls_last("ms")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return h.select("event_id", "physical", (F.row_number().over(Window.partitionBy("user_id", "physical").orderBy(last)) - 1).cast("long").alias("counter"))


@query(f"WITH {MEM_SQL}, h AS (SELECT id, stability FROM mem WHERE contains(lower(content), 'licensed') ORDER BY id LIMIT 100) SELECT id, round(least(100, stability + (least(stability, 1) + 0.3::DOUBLE) * ln(2)), 9) AS stability FROM h")
def entity_boost(spark, sf_dir):
    """Reinforcement of the (at most 100) memories that mention an entity."""
    m = memories(spark, sf_dir).filter(F.contains(F.lower("content"), F.lit("licensed"))).orderBy("id").limit(100)
    s = F.col("stability")
    return m.select("id", F.round(F.least(F.lit(100.0), s + (F.least(s, F.lit(1.0)) + 0.3) * F.ln(F.lit(2.0))), 9).alias("stability"))


@query("SELECT event_id, 'user_' || user_id::VARCHAR AS actor, event_type AS action, sha256(props) AS detail, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS entry FROM events")
def audit_log(spark, sf_dir):
    """Entries of an audit log: who did what, a digest of the details, and the number of the entry in the actor's log."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select("event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.sha2("props", 256).alias("detail"), n.alias("entry"))


@query("WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL) SELECT src, dst, weight, (SELECT count(*) FROM e) > 500 AS truncated FROM e ORDER BY weight DESC, src, dst LIMIT 500")
def bounded_graph_load(spark, sf_dir):
    """At most 500 edges, the strongest, and whether there are more: one more is read, not all counted."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    top = e.orderBy(F.desc("weight"), "src", "dst").limit(501)
    n = top.withColumn("n", F.row_number().over(Window.orderBy(F.desc("weight"), "src", "dst"))).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy()))  # 501 rows
    return n.filter("n <= 500").select("src", "dst", "weight", (F.col("held") > 500).alias("truncated"))


@query(f"WITH {MEM_SQL}, j AS (SELECT m.workspace_id, e.vec_id, e.label FROM mem m LEFT JOIN embeddings e ON m.doc_id = e.vec_id) SELECT workspace_id, count(*) AS memories, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing, CASE WHEN count(vec_id) = 0 THEN 'empty' WHEN count(vec_id) = count(*) THEN 'ready' ELSE 'building' END AS state FROM j GROUP BY workspace_id")
def embedding_health(spark, sf_dir):
    """Per workspace: how many memories have a vector, and the state of the embedding space."""
    m = memories(spark, sf_dir, content=False).select("doc_id", "workspace_id")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    g = m.join(v, "doc_id", "left").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("memories"), F.count("has").alias("embedded"))
    state = F.when(F.col("embedded") == 0, "empty").when(F.col("embedded") == F.col("memories"), "ready").otherwise("building")
    return g.select("workspace_id", "memories", "embedded", (F.col("memories") - F.col("embedded")).alias("missing"), state.alias("state"))


@query("SELECT event_id, user_id, event_type, row_number() OVER w AS version, ts AS valid_from, lead(ts) OVER w AS valid_to FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def link_versions(spark, sf_dir):
    """Versions of every link (user to kind of event): each one ends where the next begins."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(w).cast("long").alias("version"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


_SETS = "a AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS members FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS digest, list_sort(list_distinct(list(CASE l_returnflag WHEN 'A' THEN '1-URGENT' WHEN 'N' THEN '5-LOW' ELSE '2-HIGH' END))) AS members FROM lineitem GROUP BY 1)"


@query(f"WITH {_SETS}, d AS (SELECT members, min(digest) AS digest FROM b GROUP BY members) SELECT o_custkey, coalesce(digest, -1) AS digest FROM a LEFT JOIN d USING (members)")
def derived_lookup(spark, sf_dir):
    """The (first) digest that was made of exactly the same members, for every group; -1 where none was."""
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("members"))
    kind = F.when(F.col("l_returnflag") == "A", "1-URGENT").when(F.col("l_returnflag") == "N", "5-LOW").otherwise("2-HIGH")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("digest")).agg(F.array_sort(F.collect_set(kind)).alias("members"))
    d = b.groupBy("members").agg(F.min("digest").alias("digest"))
    return a.join(d, "members", "left").select("o_custkey", F.coalesce("digest", F.lit(-1)).alias("digest"))


# Answers to items, each with its own text as source [1] and the next item's as [2]: a run of words as it stands; two words
# the other way round; a word too many; a source that is not there; no source; a second clause; and another source's words.
_RUN = "array_to_string(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 3, 9), ' ')"
_TURNED = "array_to_string(list_reverse(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 3, 9)), ' ')"


@query(f"""WITH a AS (SELECT item_id, {_RUN} AS r, {_TURNED} AS t, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS s1 FROM benchmark), b AS (SELECT a.*, n.s1 AS s2 FROM a LEFT JOIN a n ON n.item_id = a.item_id + 1),
c AS (SELECT *, contains(s1, ' ' || r || ' ') AS h1, coalesce(contains(s2, ' ' || r || ' '), false) AS h2, contains(s1, ' ' || t || ' ') AS ht, contains(s1, ' ' || r || ' unproven ') AS hu FROM b)
SELECT item_id, CASE item_id % 7 WHEN 0 THEN h1 WHEN 1 THEN ht WHEN 2 THEN hu WHEN 5 THEN h1 AND h2 WHEN 6 THEN h2 ELSE false END AS supported, CASE WHEN item_id % 7 = 5 THEN 2 ELSE 1 END::BIGINT AS clauses,
(CASE item_id % 7 WHEN 0 THEN h1::INT WHEN 1 THEN ht::INT WHEN 2 THEN hu::INT WHEN 5 THEN h1::INT + h2::INT WHEN 6 THEN h2::INT ELSE 0 END)::BIGINT AS supported_clauses FROM c""")
def claims_supported(spark, sf_dir):
    """Whether the clauses of answers are runs of words of the sources that they cite."""
    b = table(spark, sf_dir, "benchmark")
    words = F.slice(GR.ordered(F.col("text")), 3, 7)
    run, turned = F.array_join(words, " "), F.array_join(F.reverse(words), " ")
    k = F.col("item_id") % 7
    says = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = F.when(k == 0, says("According source states: ", run, " [1].")).when(k == 1, says(turned, " [1]")).when(k == 2, says(run, " unproven [1].")).when(k == 3, says(run, " [9].")).when(k == 4, says(run, "."))
    text = text.when(k == 5, says("Evidence says ", F.upper(run), " [1]! ", run, " [2].")).otherwise(says(run, " [2]."))
    answers = b.select(F.col("item_id").alias("id"), text.alias("text"))
    cited = b.select(F.col("item_id").alias("id"), F.lit(1).alias("n"), F.col("text").alias("content")).unionByName(b.select((F.col("item_id") - 1).alias("id"), F.lit(2).alias("n"), F.col("text").alias("content")))
    return GR.bounded(answers, cited).withColumnRenamed("id", "item_id")


@query(f"WITH {MEM_SQL} SELECT workspace_id, id, sha256(id || chr(31) || mtype || chr(31) || scope || chr(31) || coalesce(content, '')) AS record FROM mem WHERE workspace_id = 'en'")
def compliance_export(spark, sf_dir):
    """Every row of a workspace, closed ones too, with a digest of its record."""
    m = memories(spark, sf_dir).filter("workspace_id = 'en'")
    return m.select("workspace_id", "id", F.sha2(F.concat_ws("\u001f", "id", "mtype", "scope", F.coalesce("content", F.lit(""))), 256).alias("record"))
