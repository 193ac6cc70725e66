"""Retrieval queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scoring as S
from tessella.functions import text as T
from tessella.model import BOOSTS, DAY, EVENT_KINDS, MEM_SQL, NOW, WEIGHTS, memories, table
from tessella.operators import arms as A
from tessella.operators import planning as P
from tessella.operators import retrieval as R
from tessella.operators.graph import cut
from tessella.operators.temporal import visible, visible_sql
from tessella.plans.arms import MULTIPLIERS, QUESTION, calls, code_sql, entities, follow_ups, incidence, relations, symbol_links, symbols, walk_sql
from tessella.plans.base import query

QUERY = "licensed version of worthless things"
TERMS = ["licensed", "version", "worthless", "thing", "then"]
RET_SQL = f"CASE WHEN last_access IS NULL THEN 1.0::DOUBLE ELSE exp(-greatest(({NOW}::DOUBLE - last_access) / 86400, 0) / stability) END"
STALE_SQL = f"CASE WHEN valid_to IS NULL OR (valid_to_recorded_at IS NOT NULL AND valid_to_recorded_at > {NOW}::DOUBLE) THEN 0.0::DOUBLE WHEN valid_to <= {NOW}::DOUBLE THEN 1.0::DOUBLE WHEN (valid_to - {NOW}::DOUBLE) / 86400 >= 7 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (valid_to - {NOW}::DOUBLE) / 86400 / 7 END"


def w_sql(name: str) -> str:
    return "CASE mtype " + " ".join(f"WHEN '{k}' THEN {v[name]}::DOUBLE" for k, v in WEIGHTS.items()) + " END"


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else [1.0] + [0.0] * 63


COS_SQL = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM vec WHERE vec_id = 0), cs AS (SELECT vec_id, label, list_dot_product(e, qe) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(qe, qe)) AS score FROM vec, q)"


@query(f"WITH {COS_SQL} SELECT vec_id, round(score, 6) AS score FROM cs ORDER BY round(score, 6) DESC, vec_id LIMIT 10")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine search."""
    return R.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS position FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def vector_batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for every hundredth vector against all."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return R.batch_knn(e, queries, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {MEM_SQL}, {COS_SQL}, r AS (SELECT id, doc_id, {RET_SQL} AS retention, surprise, score FROM mem JOIN cs ON doc_id = vec_id WHERE {visible_sql()}) SELECT id, round(retention * score * surprise, 9) AS score FROM r WHERE retention >= 0.01 ORDER BY round(retention * score * surprise, 9) DESC, id LIMIT 10")
def legacy_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retention x cosine x surprise above a floor of retention."""
    m = memories(spark, sf_dir, content=False).filter(visible())
    q = F.array(*map(F.lit, _vector(spark, sf_dir)))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), R.dot(R.unit(F.col("embedding")), R.unit(q)).alias("cosine"))
    r = m.join(v, "doc_id").withColumn("retention", S.retention(F.col("last_access"), F.col("stability"))).filter("retention >= 0.01")
    return r.select("id", F.round(F.col("retention") * F.col("cosine") * F.col("surprise"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"WITH {MEM_SQL} SELECT id, round({RET_SQL} * surprise, 9) AS score FROM mem ORDER BY score DESC, id LIMIT 20")
def recall_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir, content=False)
    return m.select("id", F.round(S.retention(F.col("last_access"), F.col("stability")) * F.col("surprise"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"WITH {MEM_SQL} SELECT id, mtype, round({RET_SQL}, 9) AS retention FROM mem WHERE {visible_sql()} AND {RET_SQL} >= 0.2")
def recall_by_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir, content=False).filter(visible())
    return m.select("id", "mtype", F.round(S.retention(F.col("last_access"), F.col("stability")), 9).alias("retention")).filter("retention >= 0.2")


@query(f"WITH {MEM_SQL} SELECT id, round({RET_SQL}, 9) AS retention, CASE WHEN last_access IS NULL THEN 0.0::DOUBLE ELSE round(exp(-greatest(({NOW}::DOUBLE - last_access) / 86400, 0) / 30), 9) END AS recency, round({STALE_SQL}, 9) AS stale FROM mem")
def retention_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention, recency and staleness of every memory."""
    m = memories(spark, sf_dir, content=False)
    return m.select("id", F.round(S.retention(F.col("last_access"), F.col("stability")), 9).alias("retention"), F.round(S.recency(F.col("last_access")), 9).alias("recency"), F.round(S.staleness(F.col("valid_to"), F.col("valid_to_recorded_at")), 9).alias("stale"))


@query(f"WITH {R.bm25_sql(TERMS, 20)} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), TERMS, "doc_id", "text", 20).withColumn("score", F.round("score", 6))


_LIKE = " OR ".join(f"contains(lower(text), '{t}')" for t in QUERY.split())


@query(f"SELECT doc_id, CASE WHEN contains(lower(text), '{QUERY}') THEN 0 ELSE 1 END AS tier, 0.5::DOUBLE AS score FROM documents WHERE {_LIKE} ORDER BY tier, doc_id LIMIT 50")
def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.like_fallback(table(spark, sf_dir, "documents"), QUERY, "doc_id", "text", 50)


_KEY = "['licensed', 'version', 'worthless', 'things']"


@query(f"WITH {MEM_SQL}, h AS (SELECT id, content, coalesce(last_access, valid_from) AS tm FROM mem WHERE scope <> 'session' AND trusted AND {visible_sql()} AND ({' OR '.join(f'''contains(lower(content), '{t}')''' for t in ('licensed', 'version', 'worthless', 'things'))})), t AS (SELECT * FROM h ORDER BY tm DESC, id LIMIT 100), j AS (SELECT id, {T.jaccard_sql(T.tokens_sql('content'), _KEY)} AS s, row_number() OVER (ORDER BY tm DESC, id) AS p FROM t), n AS (SELECT *, min(s) OVER () AS lo, max(s) OVER () AS hi FROM j) SELECT id, round(CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (s - lo) / (hi - lo) END, 9) AS score, p::INTEGER AS position FROM n")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback search: eligible rows with any keyword, newest first, scored by token overlap."""
    words = ("licensed", "version", "worthless", "things")
    some = F.lit(False)
    for w in words:
        some |= F.contains(F.lower("content"), F.lit(w))
    m = memories(spark, sf_dir).filter((F.col("scope") != "session") & F.col("trusted") & visible() & some)
    top = m.select("id", "content", F.coalesce("last_access", "valid_from").alias("at")).orderBy(F.desc("at"), "id").limit(100)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("at"), "id")))  # 100 rows at most
    j = top.select("id", "position", T.jaccard(T.tokens(F.col("content")), F.array(*map(F.lit, words))).alias("s"))
    return R.normalised(j, "s").select("id", F.round("norm", 9).alias("score"), "position")


_ARMS = f"{MEM_SQL}, {COS_SQL}, {R.bm25_sql(TERMS, 200)}, arms AS (SELECT vec_id AS doc_id, 'vector' AS arm, round(score, 9) AS score FROM (SELECT * FROM cs ORDER BY round(score, 9) DESC, vec_id LIMIT 200) UNION ALL SELECT doc_id, 'lexical', round(score, 9) FROM bm)"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 200).select(F.col("vec_id").alias("doc_id"), F.lit("vector").alias("arm"), F.round("score", 9).alias("score"))
    b = R.bm25(table(spark, sf_dir, "documents"), TERMS, "doc_id", "text", 200).select("doc_id", F.lit("lexical").alias("arm"), F.round("score", 9).alias("score"))
    return cut(v.unionByName(b))  # 400 rows that what follows reads more than once


@query(f"WITH {_ARMS}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY arm ORDER BY score DESC, doc_id) AS rank FROM arms) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, count(*) AS arms FROM r GROUP BY doc_id")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf(_arms(spark, sf_dir), "doc_id").withColumn("rrf", F.round("rrf", 9))


@query(f"WITH {_ARMS}, n AS (SELECT doc_id, arm, score, min(score) OVER (PARTITION BY arm) AS lo, max(score) OVER (PARTITION BY arm) AS hi FROM arms) SELECT doc_id, arm, round(CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM n")
def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.normalised(_arms(spark, sf_dir), "score", "arm").select("doc_id", "arm", F.round("norm", 6).alias("norm"))


# The question of the hybrid search, and the terms that the lexical arm makes of it (with their inflections).
TERMS_ASKED = T.expanded(QUESTION)
#: Score that a digest of other memories has on top; digests here are every 23rd memory.
CONSOLIDATED = 0.05
_SCOPE = "SELECT doc_id AS id, ingested_at AS tm FROM mem"
_FOUR = f"""{MEM_SQL}, {COS_SQL}, {R.bm25_sql(TERMS_ASKED, 200).replace('f AS (SELECT', 'fq AS (SELECT', 1).replace('FROM f, s', 'FROM fq, s').replace('FROM f)', 'FROM fq)')}, {walk_sql(_SCOPE, 200)}, {code_sql('SELECT doc_id AS id FROM mem', 200)},
arms AS (SELECT vec_id AS doc_id, 'vector' AS arm, round(score, 9) AS score FROM (SELECT * FROM cs ORDER BY round(score, 9) DESC, vec_id LIMIT 200) UNION ALL SELECT doc_id, 'lexical', round(score, 9) FROM bm UNION ALL SELECT id, 'graph', round(score, 9) FROM gw UNION ALL SELECT id, 'code', round(score, 9) FROM cw)"""
_NORM = lambda arm: f"max(CASE WHEN arm = '{arm}' THEN CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END END)"
_HYBRID = f"""{_FOUR}, nn AS (SELECT doc_id, arm, score, min(score) OVER (PARTITION BY arm) AS lo, max(score) OVER (PARTITION BY arm) AS hi, row_number() OVER (PARTITION BY arm ORDER BY score DESC, doc_id) AS rank FROM arms),
pv AS (SELECT doc_id, {_NORM('vector')} AS sem, {_NORM('lexical')} AS lex, {_NORM('graph')} AS gra, {_NORM('code')} AS cod, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM nn GROUP BY doc_id),
hy AS (SELECT id, mtype, content, coalesce(sem, 0) AS semantic, coalesce(lex, 0) AS lexical, coalesce(gra, 0) AS graph, coalesce(cod, 0) AS code,
  {w_sql('r')} * {RET_SQL} + {w_sql('s')} * greatest(coalesce(sem, 0), coalesce(cod, 0)) + {w_sql('l')} * coalesce(lex, 0) + {w_sql('g')} * coalesce(gra, 0) + {w_sql('i')} * importance * confidence - {w_sql('x')} * {STALE_SQL} + 0.5::DOUBLE * rrf
  + CASE WHEN doc_id % 23 = 0 THEN {CONSOLIDATED}::DOUBLE ELSE 0 END AS score FROM mem JOIN pv USING (doc_id) WHERE trusted AND {visible_sql()})"""


def _four_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, arm, score: 200 candidates of vectors, terms, the joint walk and the code arm, which share nothing but the question."""
    recent = memories(spark, sf_dir, content=False).select(F.col("doc_id").alias("id"), F.col("ingested_at").alias("at"))
    mine = recent.select("id")

    def vector() -> DataFrame:
        return R.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 200).withColumnRenamed("vec_id", "doc_id")

    def lexical() -> DataFrame:
        return R.bm25(table(spark, sf_dir, "documents"), TERMS_ASKED, "doc_id", "text", 200)

    def graph() -> DataFrame:
        links = follow_ups(spark, sf_dir)
        links = links.join(mine.withColumnRenamed("id", "a"), "a", "left_semi").join(mine.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "layer")
        held = incidence(spark, sf_dir).join(mine, "id", "left_semi")
        return A.joint_walk_arm(cut(relations(spark, sf_dir)), held, cut(links), recent, A.seeds_in(entities(spark, sf_dir), QUESTION), 200, MULTIPLIERS).withColumnRenamed("id", "doc_id")

    def code() -> DataFrame:
        return A.code_arm(symbols(spark, sf_dir), cut(calls(spark, sf_dir)), symbol_links(spark, sf_dir).join(mine, "id", "left_semi"), QUESTION, 200).withColumnRenamed("id", "doc_id")

    # The arms do not wait for one another: their jobs are handed to the cluster at once.
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda arm: cut(arm().select("doc_id", F.lit(arm.__name__).alias("arm"), F.round("score", 9).alias("score"))), (vector, lexical, graph, code)))
    return reduce(DataFrame.unionByName, found)  # 800 rows


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eligible candidates of the four arms with their parts and final score; code counts where it says more than the vector."""
    ranked = R.normalised(_four_arms(spark, sf_dir), "score", "arm").withColumn("rank", F.row_number().over(Window.partitionBy("arm").orderBy(F.desc("score"), "doc_id")))
    of = lambda a: F.coalesce(F.max(F.when(F.col("arm") == a, F.col("norm"))), F.lit(0.0))
    fused = ranked.groupBy("doc_id").agg(of("vector").alias("semantic"), of("lexical").alias("lexical"), of("graph").alias("graph"), of("code").alias("code"), F.sum(1.0 / (60 + F.col("rank"))).alias("rrf"))
    m = memories(spark, sf_dir).filter(F.col("trusted") & visible()).join(F.broadcast(fused), "doc_id")  # at most 800 rows
    stale = S.staleness(F.col("valid_to"), F.col("valid_to_recorded_at"))
    score = S.final_score(S.retention(F.col("last_access"), F.col("stability")), F.greatest("semantic", "code"), F.col("lexical"), F.col("graph"), F.col("importance"), F.col("confidence"), stale)
    score = score + 0.5 * F.col("rrf") + F.when(F.col("doc_id") % 23 == 0, CONSOLIDATED).otherwise(0.0)
    return m.select("id", "mtype", "content", "semantic", "lexical", "graph", "code", score.alias("score"))


@query(f"WITH {_HYBRID} SELECT id, mtype, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(graph, 6) AS graph, round(code, 6) AS code, round(score, 6) AS score FROM hy")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with what each arm says of it and the final score."""
    return hybrid(spark, sf_dir).select("id", "mtype", *(F.round(c, 6).alias(c) for c in ("semantic", "lexical", "graph", "code", "score")))


@query(f"WITH {_HYBRID}, c AS (SELECT id, mtype, round(score, 6) AS score FROM hy), n AS (SELECT *, row_number() OVER (PARTITION BY mtype ORDER BY score DESC, id) AS n FROM c) SELECT id, mtype, score FROM n WHERE n <= CASE mtype WHEN 'working' THEN 2 WHEN 'episodic' THEN 3 ELSE 1000000 END ORDER BY score DESC, id LIMIT 12")
def mtype_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.type_limits(hybrid_score(spark, sf_dir).select("id", "mtype", "score"), {"working": 2, "episodic": 3}, 12)


@query(f"WITH {_HYBRID}, p AS (SELECT id, content, round(score, 6) AS score FROM hy ORDER BY round(score, 6) DESC, id LIMIT 40), j AS (SELECT id, score, {T.jaccard_sql(T.tokens_sql('content'), T.tokens_sql(repr(QUERY)))} AS rr FROM p), n AS (SELECT *, min(score) OVER () lo, max(score) OVER () hi, min(rr) OVER () rlo, max(rr) OVER () rhi FROM j) SELECT id, round(0.7::DOUBLE * CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END + 0.3::DOUBLE * CASE WHEN rhi - rlo < 1e-12 THEN 1.0 ELSE (rr - rlo) / (rhi - rlo) END, 6) AS score FROM n")
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of 4k best, blended with a second opinion (token overlap stands in for a model)."""
    pool = hybrid(spark, sf_dir).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(40)
    both = pool.select("id", "score", T.jaccard(T.tokens(F.col("content")), T.tokens(F.lit(QUERY))).alias("rr"))
    a = R.normalised(both, "score").withColumnRenamed("norm", "n1")
    return R.normalised(a, "rr").select("id", F.round(0.7 * F.col("n1") + 0.3 * F.col("norm"), 6).alias("score"))


@query(f"WITH {MEM_SQL}, {COS_SQL} SELECT id, round(greatest(least(greatest(score, 0), 1), {T.jaccard_sql(T.tokens_sql('content'), T.tokens_sql(repr(QUERY)))}), 6) AS support FROM mem JOIN cs ON doc_id = vec_id")
def absolute_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*map(F.lit, _vector(spark, sf_dir)))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), R.dot(R.unit(F.col("embedding")), R.unit(q)).alias("cosine"))
    m = memories(spark, sf_dir).join(v, "doc_id")
    return m.select("id", F.round(F.greatest(F.least(F.greatest("cosine", F.lit(0.0)), F.lit(1.0)), T.jaccard(T.tokens(F.col("content")), T.tokens(F.lit(QUERY)))), 6).alias("support"))


GROUND = "licensed version"
_STEMS = lambda x: f"list_distinct(list_transform({x}, lambda t: {T.stem_sql('t')}))"


@query(f"WITH t AS (SELECT doc_id, {_STEMS(T.tokens_sql('text'))} AS c, {_STEMS(T.tokens_sql(repr(GROUND)))} AS q FROM documents), s AS (SELECT doc_id, CASE WHEN len(list_intersect(q, c)) < 2 THEN 0.0 ELSE greatest({T.jaccard_sql('q', 'c')}, len(list_intersect(q, c)) / 3.0::DOUBLE) END AS support FROM t) SELECT doc_id, round(support, 9) AS support FROM s WHERE support >= 0.25 ORDER BY support DESC, doc_id LIMIT 5")
def grounded_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations whose support reaches the floor; no row means to abstain."""
    return R.grounded(table(spark, sf_dir, "documents"), GROUND, "doc_id", "text").withColumn("support", F.round("support", 9))


@query(f"WITH {MEM_SQL}, p AS (SELECT id, pinned, {w_sql('i')} * importance * {RET_SQL} * confidence + {w_sql('c')} * CASE WHEN last_access IS NULL THEN 0.0 ELSE exp(-greatest(({NOW}::DOUBLE - last_access) / 86400, 0) / 30) END + {w_sql('r')} * {RET_SQL} - {w_sql('x')} * {STALE_SQL} AS score FROM mem WHERE trusted AND {visible_sql()}) SELECT id, pinned, round(score, 6) AS score FROM p ORDER BY pinned DESC, round(score, 6) DESC, id LIMIT 25")
def proactive_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to bring up unasked: pinned rows first, then by the proactive score."""
    m = memories(spark, sf_dir, content=False).filter(F.col("trusted") & visible())
    score = S.proactive(F.col("importance"), S.retention(F.col("last_access"), F.col("stability")), F.col("confidence"), S.recency(F.col("last_access")), S.staleness(F.col("valid_to"), F.col("valid_to_recorded_at")))
    return m.select("id", "pinned", F.round(score, 6).alias("score")).orderBy(F.desc("pinned"), F.desc("score"), "id").limit(25)


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN {BOOSTS[b]}::DOUBLE" for a, b in EVENT_KINDS.items()) + " END"


@query(f"WITH RECURSIVE ev AS (SELECT user_id, {_KIND} AS boost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error'), f AS (SELECT user_id, 0::BIGINT AS n, 1.0::DOUBLE AS s FROM (SELECT DISTINCT user_id FROM ev) UNION ALL SELECT f.user_id, ev.n, least(100.0::DOUBLE, f.s + (least(f.s, 1.0) + boost) * ln(1 + 1.0::DOUBLE / ev.n)) FROM f JOIN ev ON ev.user_id = f.user_id AND ev.n = f.n + 1) SELECT user_id, max(n) AS n, round(max_by(s, n), 6) AS stability FROM f GROUP BY user_id")
def reinforce_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability after all interactions, folded in their order.

    With a start of 1 day or more each event adds (1 + boost) ln(1 + 1/n) and the cap of 100
    absorbs, so that the fold is a sum over a running number: no list of events is collected.
    """
    boost = F.create_map(*[F.lit(v) for a, b in EVENT_KINDS.items() for v in (a, BOOSTS[b])])
    ev = table(spark, sf_dir, "events").filter("event_type <> 'error'").select("user_id", boost[F.col("event_type")].alias("boost"), "ts", "event_id")
    ev = ev.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    s = F.least(F.lit(100.0), 1.0 + F.sum((1.0 + F.col("boost")) * F.log1p(1.0 / F.col("n"))))
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(s, 6).alias("stability"))


@query(f"WITH {MEM_SQL} SELECT id, round(stability * pow(0.5::DOUBLE, greatest({NOW}::DOUBLE - coalesce(last_access, valid_from), 0) / 86400 / 30), 9) AS stability FROM mem WHERE NOT pinned")
def decay_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-life decay of stability."""
    days = F.greatest(F.lit(NOW) - F.coalesce("last_access", "valid_from"), F.lit(0.0)) / DAY
    return memories(spark, sf_dir, content=False).filter("not pinned").select("id", F.round(F.col("stability") * F.pow(F.lit(0.5), days / 30), 9).alias("stability"))


@query(f"WITH {MEM_SQL}, s AS (SELECT id, valid_to IS NULL OR valid_to > {NOW}::DOUBLE AS live, {T.jaccard_sql(T.tokens_sql('content'), T.tokens_sql(repr(QUERY)))} AS related, valid_from FROM mem) SELECT id, live, round(related, 9) AS related FROM s WHERE related > 0 ORDER BY live DESC, related DESC, id LIMIT 20")
def why_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related live rows first, then the closed ones that they replaced."""
    m = memories(spark, sf_dir).select("id", (F.col("valid_to").isNull() | (F.col("valid_to") > NOW)).alias("live"), T.jaccard(T.tokens(F.col("content")), T.tokens(F.lit(QUERY))).alias("related"))
    return m.filter("related > 0").orderBy(F.desc("live"), F.desc("related"), "id").limit(20).withColumn("related", F.round("related", 9))


@query(f"WITH {MEM_SQL}, s AS (SELECT id, {T.jaccard_sql(T.tokens_sql('content'), T.tokens_sql(repr(QUERY)))} AS related, coalesce(nullif(valid_from, 0), nullif(ingested_at, 0), 0) AS tm FROM mem), t AS (SELECT * FROM s WHERE related > 0 ORDER BY related DESC, id LIMIT 30) SELECT id, tm, row_number() OVER (ORDER BY tm, id)::INTEGER AS position FROM t")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most related rows, closed ones too, in the order of time; 0 counts as no time."""
    at = F.coalesce(F.nullif("valid_from", F.lit(0.0)), F.nullif("ingested_at", F.lit(0.0)), F.lit(0.0))
    m = memories(spark, sf_dir).select("id", T.jaccard(T.tokens(F.col("content")), T.tokens(F.lit(QUERY))).alias("related"), at.alias("tm"))
    top = m.filter("related > 0").orderBy(F.desc("related"), "id").limit(30)
    return top.select("id", "tm", F.row_number().over(Window.orderBy("tm", "id")).alias("position"))  # 30 rows


_RE = lambda p: p.replace("'", "''")


@query(f"SELECT item_id, CASE WHEN regexp_matches(text, '{_RE(P.CODE)}') THEN 'code' WHEN regexp_matches(text, '{_RE(P.GRAPH)}') THEN 'graph' WHEN regexp_matches(text, '{_RE(P.LEXICAL)}') THEN 'lexical' ELSE 'balanced' END AS profile FROM benchmark")
def profile_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval profile of each query by its cues: code before graph before lexical."""
    return table(spark, sf_dir, "benchmark").select("item_id", P.profile(F.col("text")).alias("profile"))
