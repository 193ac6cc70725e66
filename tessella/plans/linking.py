"""Joins between texts, entities, links and code, and the choice of routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.model import MEM_SQL, memories, table
from tessella.operators import maintain as M
from tessella.operators import planning as P
from tessella.operators import retrieval as R
from tessella.operators.temporal import visible, visible_sql
from tessella.plans.base import query

_NAMES = "nm AS (SELECT DISTINCT t AS name FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM benchmark) WHERE length(t) >= 3)"


def _names(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")).alias("name"))
    return t.filter(F.length("name") >= 3).distinct()


@query(f"WITH {_NAMES}, w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS name FROM documents) SELECT doc_id, name FROM w JOIN nm USING (name)")
def mention_join(spark, sf_dir):
    """Which text mentions which name as a whole token: an equi-join on tokens instead of a search for every pair.  Names of under three characters say nothing."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"))).alias("name"))
    return w.filter(F.length("name") >= 3).join(_names(spark, sf_dir), "name")


_PART = f"nm2 AS (SELECT min(p_partkey) AS id, p_name FROM part GROUP BY p_name), pt AS (SELECT id, {T.tokens_sql('p_name')} AS t FROM nm2)"


@query(f"WITH {_PART} SELECT x.id AS new_id, y.id AS old_id, round({T.jaccard_sql('x.t', 'y.t')}, 9) AS overlap FROM pt x JOIN pt y ON x.id < y.id WHERE {T.jaccard_sql('x.t', 'y.t')} >= 0.3")
def entity_blocking(spark, sf_dir):
    """Entities whose names overlap by 0.3 or more, blocked by shared tokens; equal names count once, by their least id."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", T.tokens(F.col("p_name")).alias("tokens"))
    return M.similar(p, p, 0.3).filter("new_id < old_id").withColumn("overlap", F.round("overlap", 9))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(' find the parts named ' || (SELECT min(p_name) FROM part) || ' please', '\\b' || regexp_replace(p_name, '([^\\w\\s])', '\\\\\\1', 'g') || '\\b')")
def seed_entities(spark, sf_dir):
    """Entities that a query names as a whole phrase."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = p.agg(F.concat(F.lit(" find the parts named "), F.coalesce(F.min("p_name"), F.lit("")), F.lit(" please")).alias("q")).select("q").scalar()
    return p.filter(F.contains(asked, F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))))


@query(f"WITH {MEM_SQL} SELECT m.repo_id AS entity, count(*) AS memories, round(sum(confidence), 6) AS score FROM mem m WHERE {visible_sql()} GROUP BY 1")
def graph_arm_incidence(spark, sf_dir):
    """What a graph arm of one hop scores: the confidence that reaches each entity."""
    m = memories(spark, sf_dir, content=False).filter(visible())
    return m.groupBy(F.col("repo_id").alias("entity")).agg(F.count(F.lit(1)).alias("memories"), F.round(F.sum("confidence"), 6).alias("score"))


@query("WITH n AS (SELECT l_suppkey AS symbol, l_orderkey AS caller, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT symbol, caller, n::INTEGER AS position FROM n WHERE n <= 10")
def code_search_callers(spark, sf_dir):
    """Symbols with at most ten callers each, the strongest first."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return li.select(F.col("l_suppkey").alias("symbol"), F.col("l_orderkey").alias("caller"), F.row_number().over(w).alias("position")).filter("position <= 10")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def edge_support_visible(spark, sf_dir):
    """Edges without any support, or with a visible one: one aggregation of supports and one join."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("seen"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left").filter("l_orderkey is null or seen").select("o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def links_among(spark, sf_dir):
    """Links whose both ends are in the given sets: two semi-joins."""
    a = table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(a, "l_partkey", "left_semi").join(b, "l_suppkey", "left_semi")


@query(f"WITH {MEM_SQL}, ev AS (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT event_id FROM events WHERE event_type = 'purchase') SELECT id FROM mem JOIN ev USING (doc_id) WHERE {visible_sql()}")
def consolidation_evidence(spark, sf_dir):
    """Evidence from links and from provenance, each checked for visibility again."""
    a = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    b = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("doc_id"))
    return memories(spark, sf_dir, content=False).filter(visible()).join(a.union(b).distinct(), "doc_id", "left_semi").select("id")


_A, _B = ["licensed", "version"], ["pathetic", "worthless", "then"]


@query(f"WITH {R.bm25_sql(_A, 100).replace('bm AS', 'bma AS').replace('w AS (', 'wa AS (', 1).replace('FROM w)', 'FROM wa)').replace('f AS (SELECT', 'fa AS (SELECT', 1).replace('FROM f)', 'FROM fa)').replace(', s AS (', ', sa AS (').replace('FROM f, s', 'FROM fa, sa')}, {R.bm25_sql(_B, 100)}, u AS (SELECT doc_id, 1 AS priority, round(score, 9) AS score FROM bma UNION ALL SELECT doc_id, 2, round(score, 9) FROM bm), n AS (SELECT *, min(score) OVER (PARTITION BY priority) AS lo, max(score) OVER (PARTITION BY priority) AS hi, row_number() OVER (PARTITION BY priority ORDER BY score DESC, doc_id) AS rank FROM u) SELECT doc_id, round(max((CASE WHEN hi - lo < 1e-12 THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END * CASE priority WHEN 2 THEN 3 ELSE 1 END + CASE priority WHEN 2 THEN 1.5::DOUBLE ELSE 0 END) / priority), 6) AS best, round(sum(1.0::DOUBLE / priority / (60 + rank)), 9) AS rrf FROM n GROUP BY doc_id")
def multi_query_fusion(spark, sf_dir):
    """Two sub-queries fused with weights 1 / priority: the best normalised score, after the second's scale and bonus, and the rank fusion."""
    second = F.col("priority") == 2
    scale, bonus = F.when(second, 3.0).otherwise(1.0), F.when(second, 1.5).otherwise(0.0)
    docs = table(spark, sf_dir, "documents")
    u = None
    for priority, terms in ((1, _A), (2, _B)):
        x = R.bm25(docs, terms, "doc_id", "text", 100).select("doc_id", F.lit(priority).alias("priority"), F.round("score", 9).alias("score"))
        u = x if u is None else u.unionByName(x)
    n = R.normalised(u, "score", "priority").withColumn("rank", F.row_number().over(Window.partitionBy("priority").orderBy(F.desc("score"), "doc_id")))
    return n.groupBy("doc_id").agg(F.round(F.max((F.col("norm") * scale + bonus) / F.col("priority")), 6).alias("best"), F.round(F.sum(1.0 / F.col("priority") / (60 + F.col("rank"))), 9).alias("rrf"))


@query("WITH m AS (SELECT doc_id, ['working', 'episodic', 'semantic', 'procedural'][(doc_id % 4 + 1)::INT] AS mtype, source, contains(lower(text), 'licensed') AS topic, least(1.0::DOUBLE, length(text) / 2000.0::DOUBLE) AS detail FROM documents) SELECT doc_id, round(0.2::DOUBLE * (0.62::DOUBLE * topic::INT * 0.8::DOUBLE + 0.18::DOUBLE * CASE mtype WHEN 'semantic' THEN 0.5::DOUBLE WHEN 'working' THEN -0.25::DOUBLE ELSE 0 END + 0.12::DOUBLE * CASE source WHEN 'src1' THEN 0.4::DOUBLE ELSE 0 END + 0.08::DOUBLE * (1 - 2 * abs(0.5::DOUBLE - detail))), 9) AS preference FROM m")
def user_preferences(spark, sf_dir):
    """The preference of a profile for every row: topic, type, source and detail by map lookups."""
    d = table(spark, sf_dir, "documents")
    mtype = F.element_at(F.array(*map(F.lit, ("working", "episodic", "semantic", "procedural"))), (F.col("doc_id") % 4 + 1).cast("int"))
    look = lambda pairs, key: F.coalesce(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])[key], F.lit(0.0))
    topic = F.contains(F.lower("text"), F.lit("licensed")).cast("int") * 0.8
    detail = F.least(F.lit(1.0), F.length("text") / 2000.0)
    pref = 0.62 * topic + 0.18 * look({"semantic": 0.5, "working": -0.25}, mtype) + 0.12 * look({"src1": 0.4}, F.col("source")) + 0.08 * (1 - 2 * F.abs(0.5 - detail))
    return d.select("doc_id", F.round(0.2 * pref, 9).alias("preference"))


# Queries with cues, made from the turns of conversations.
_Q = "CASE turn % 6 WHEN 0 THEN 'why does ' || role || ' depend on it' WHEN 1 THEN 'how to run the steps of \"' || role || '\"' WHEN 2 THEN 'when was it changed before ' || role WHEN 3 THEN 'who owns ' || role || '.method()' WHEN 4 THEN 'show MAX_SIZE of this session' ELSE text END"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_Q).alias("q"))


def _re(x: str) -> str:
    return x.replace("'", "''")


_PROF = f"CASE WHEN regexp_matches(q, '{_re(P.CODE)}') THEN 'code' WHEN regexp_matches(q, '{_re(P.GRAPH)}') THEN 'graph' WHEN regexp_matches(q, '{_re(P.LEXICAL)}') THEN 'lexical' ELSE 'balanced' END"


@query(f"WITH c AS (SELECT conv_id, turn, role, {_Q} AS q FROM conversations), p AS (SELECT conv_id, turn, role, {_PROF} AS profile FROM c) SELECT *, least(50, CASE profile WHEN 'lexical' THEN 20 WHEN 'graph' THEN 60 WHEN 'code' THEN 60 ELSE 30 END)::INTEGER AS depth FROM p")
def candidate_depth(spark, sf_dir):
    """Profile and candidate depth of every query."""
    q = _queries(spark, sf_dir).withColumn("profile", P.profile(F.col("q")))
    return q.select("conv_id", "turn", "role", "profile", P.depth(F.col("profile"), 10, 50).alias("depth"))


_HAS = lambda words: "list_has_any(t, [" + ", ".join(f"'{w}'" for w in words) + "])"


@query(f"WITH c AS (SELECT conv_id, turn, role, string_split_regex(lower({_Q}), '[^\\p{{L}}\\p{{N}}_]+') AS t FROM conversations), l AS (SELECT conv_id, turn, role, CASE WHEN {_HAS(['why'])} THEN 'causal' WHEN {_HAS(['when'])} THEN 'temporal' WHEN {_HAS(['who', 'whose'])} THEN 'entity' WHEN {_HAS(P.TEMPORAL_TERMS)} THEN 'temporal' WHEN {_HAS(P.CAUSAL_TERMS)} THEN 'causal' WHEN {_HAS(P.ENTITY_TERMS)} THEN 'entity' END AS layer FROM c) SELECT *, CASE WHEN layer IS NULL THEN 1.0::DOUBLE WHEN layer = 'causal' THEN 4.0::DOUBLE ELSE 0.25::DOUBLE END AS causal_weight FROM l")
def layer_routing(spark, sf_dir):
    """The graph layer that each query prefers, and what the causal layer weighs for it."""
    q = _queries(spark, sf_dir).withColumn("layer", P.preferred_layer(F.col("q")))
    return q.select("conv_id", "turn", "role", "layer", F.when(F.col("layer").isNull(), 1.0).when(F.col("layer") == "causal", P.PREFERRED).otherwise(P.FALLBACK).alias("causal_weight"))


@query(f"WITH c AS (SELECT conv_id, turn, role, {_Q} AS q FROM conversations) SELECT conv_id, turn, role, least(3, 1 + (len(regexp_extract_all(q, '{_re(P.QUOTED)}', 0)) + len(regexp_extract_all(q, '{_re(P.IDENTIFIER)}', 0)) > 0)::INT + regexp_matches(q, '{_re(P.RELATION_CUE)}')::INT + (regexp_matches(q, '{_re(P.SESSION)}') OR regexp_matches(q, '{_re(P.PROCEDURAL)}') OR regexp_matches(q, '{_re(P.CHANGE)}'))::INT)::INTEGER AS routes, CASE WHEN regexp_matches(q, '{_re(P.SESSION)}') THEN 'current_session' WHEN regexp_matches(q, '{_re(P.PROCEDURAL)}') THEN 'procedural' WHEN regexp_matches(q, '{_re(P.CHANGE)}') THEN 'temporal' END AS intent FROM c")
def query_plan(spark, sf_dir):
    """Routes and intent of every query's plan."""
    return _queries(spark, sf_dir).select("conv_id", "turn", "role", F.size(P.routes(F.col("q"))).alias("routes"), P.intent(F.col("q")).alias("intent"))


_RELATION = "['causes', 'Fixed By', 'before', 'happened-after', 'uses', 'part_of', 'similar to', 'trigger_x', 'ends_before'][(event_id % 9 + 1)::INT]"


@query(f"WITH e AS (SELECT event_id, regexp_replace(lower({_RELATION}), '[ -]', '_', 'g') AS r FROM events) SELECT CASE WHEN r IN ({', '.join(map(repr, P.TEMPORAL_RELATIONS))}) OR r LIKE '%\\_before' ESCAPE '\\' OR r LIKE '%\\_after' ESCAPE '\\' THEN 'temporal' WHEN r IN ({', '.join(map(repr, P.CAUSAL_RELATIONS))}) OR r LIKE 'cause%' OR r LIKE 'trigger%' OR r LIKE 'fix%' THEN 'causal' WHEN r IN ({', '.join(map(repr, P.ENTITY_RELATIONS))}) THEN 'entity' ELSE 'semantic' END AS layer, count(*) AS n FROM e GROUP BY 1")
def layer_infer(spark, sf_dir):
    r = F.element_at(F.array(*map(F.lit, ("causes", "Fixed By", "before", "happened-after", "uses", "part_of", "similar to", "trigger_x", "ends_before"))), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(P.layer_of(r).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH t AS (SELECT conv_id, {T.estimate_tokens_sql('text')} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS p FROM conversations), c AS (SELECT conv_id, sum(n) AS whole, sum(n) FILTER (WHERE p <= 3) AS packed, count(*) AS turns FROM t GROUP BY 1) SELECT conv_id, CASE WHEN whole > packed THEN ceil(whole::DOUBLE / (whole - packed))::BIGINT ELSE -1 END AS break_even, CASE WHEN whole <= 75 THEN 'history_bypass' WHEN turns >= 6 THEN 'retrieval' WHEN whole <= 375 THEN 'history_fallback' ELSE 'low_confidence_abstain' END AS mode FROM c")
def adaptive_context(spark, sf_dir):
    """Whether to send a history whole, retrieve from it, fall back or abstain; and after how many queries the tokens of
    reading it once are saved, if each sends the last three turns instead of all (-1: never)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    t = table(spark, sf_dir, "conversations").select("conv_id", T.estimate_tokens(F.col("text")).alias("n"), F.row_number().over(w).alias("p"))
    c = t.groupBy("conv_id").agg(F.sum("n").alias("whole"), F.sum(F.when(F.col("p") <= 3, F.col("n"))).alias("packed"), F.count(F.lit(1)).alias("turns"))
    mode = F.when(F.col("whole") <= 75, "history_bypass").when(F.col("turns") >= 6, "retrieval").when(F.col("whole") <= 375, "history_fallback").otherwise("low_confidence_abstain")
    return c.select("conv_id", F.when(F.col("whole") > F.col("packed"), F.ceil(F.col("whole") / (F.col("whole") - F.col("packed"))).cast("long")).otherwise(-1).alias("break_even"), mode.alias("mode"))


@query("WITH k AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT a.vec_id AS id, b.vec_id AS other FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.35) SELECT id AS vec_id, count(*) AS links FROM l GROUP BY 1")
def vector_near_duplicates(spark, sf_dir):
    """How many vectors are as near as 0.35 to each: counts by blocks, no pairs are shuffled."""
    return R.near_counts(table(spark, sf_dir, "embeddings"), 0.35)


@query("WITH c AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS g FROM lineitem), p AS (SELECT a.g AS a, b.g AS b, count(*) AS w FROM c a JOIN c b ON a.s = b.s AND a.g < b.g GROUP BY ALL) SELECT a, b, w FROM p ORDER BY w DESC, a, b LIMIT 80")
def scene_edges(spark, sf_dir):
    """The strongest 80 edges of a scene: groups of parts that share suppliers, pairs made within each supplier's row."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 50).alias("g")).groupBy("s").agg(F.array_sort(F.collect_set("g")).alias("gs"))
    pairs = F.flatten(F.transform("gs", lambda a: F.transform(F.filter("gs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return c.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).orderBy(F.desc("w"), "a", "b").limit(80)
