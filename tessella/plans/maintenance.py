"""Write-path and maintenance queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import scoring as S
from tessella.functions import text as T
from tessella.model import MEM_SQL, NOW, memories, table
from tessella.operators import graph as G
from tessella.operators import maintain as M
from tessella.operators.temporal import visible, visible_sql
from tessella.operators import naming as N
from tessella.plans.base import query
from tessella.plans.recall import RET_SQL

# Incoming rows, made from the benchmark's texts: copies, longer and shorter ones, others; every second item is a named claim.
_VARIANTS = "CASE v WHEN 0 THEN text WHEN 1 THEN text || ' extra words here now' WHEN 2 THEN substr(text, 1, CAST(floor(length(text) * 0.8) AS INT)) WHEN 3 THEN substr(text, 1, CAST(floor(length(text) * 0.55) AS INT)) WHEN 4 THEN 'something else entirely' WHEN 5 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 6 THEN substr(text, 1, CAST(floor(length(text) * 0.7) AS INT)) ELSE text END"
_KEYED = "CASE WHEN v IN (5, 6) AND item_id % 2 = 0 THEN 'k' || CAST(item_id AS STRING) WHEN v = 7 THEN 'new' || CAST(item_id AS STRING) END"
_WORDS = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_CLAIM = "lower(trim(regexp_replace(regexp_replace({}, '(^|\\s)\\p{{P}}|\\p{{P}}(\\s|$)', ' ', 'g'), '\\s+', ' ', 'g')))"
_PAIRS = f"""nw AS (SELECT 'n' || item_id::VARCHAR || '_' || v::VARCHAR AS id, {_KEYED} AS k, {_VARIANTS} AS text FROM benchmark, (SELECT unnest(range(8)) AS v)),
od AS (SELECT 'o' || item_id::VARCHAR AS id, CASE WHEN item_id % 2 = 0 THEN 'k' || item_id::VARCHAR END AS k, text, item_id::DOUBLE AS old_from FROM benchmark UNION ALL SELECT 'r' || item_id::VARCHAR, NULL, text || ' rival', item_id + 0.5 FROM benchmark WHERE item_id % 5 = 0),
a AS (SELECT *, {T.tokens_sql('text')} AS t, {_WORDS.format('text')} AS w FROM nw), b AS (SELECT *, {T.tokens_sql('text')} AS t, {_WORDS.format('text')} AS w FROM od),
pq AS (SELECT a.id AS new_id, a.k IS NOT NULL AS keyed, b.id AS old_id, b.old_from, {T.jaccard_sql('a.t', 'b.t')} AS overlap, CASE WHEN len(a.t) * len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / sqrt(len(a.t) * len(b.t)) END AS sim, coalesce(a.k = b.k, false) AS same_key, a.w = b.w AS same_words FROM a, b),
pr AS (SELECT * FROM pq WHERE same_key OR overlap >= 0.4),
pc AS (SELECT *, max(same_key::INT) OVER (PARTITION BY new_id) AS claim FROM pr), ps AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY overlap DESC, sim DESC, old_from DESC NULLS LAST, old_id) AS n, max(overlap) OVER (PARTITION BY new_id) AS best FROM pc WHERE claim = same_key::INT AND (same_key OR sim >= 0.15)),
un AS (SELECT new_id, bool_or(n > 1 AND overlap >= 0.55 AND sim >= 0.45 AND best - overlap <= 0.05 + 1e-9) AS unsure FROM ps GROUP BY new_id),
dc AS (SELECT new_id, old_id, overlap, unsure AND NOT keyed AND overlap >= 0.55 AND overlap < 0.85 AND sim >= 0.45 AND NOT same_key AS unsure, CASE WHEN same_key THEN CASE WHEN same_words THEN 'NOOP' ELSE 'INVALIDATE' END WHEN overlap >= 0.85 THEN CASE WHEN NOT keyed THEN 'NOOP' WHEN same_words THEN 'INVALIDATE' ELSE 'RELATE' END
  WHEN unsure AND NOT keyed AND overlap >= 0.55 AND sim >= 0.45 THEN 'RELATE' WHEN NOT keyed AND overlap >= 0.55 AND sim >= 0.45 THEN 'INVALIDATE' WHEN overlap >= 0.4 THEN 'RELATE' ELSE 'ADD' END AS op FROM ps JOIN un USING (new_id) WHERE n = 1)"""


def _incoming(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    new = b.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(F.expr("concat('n', item_id, '_', v)").alias("id"), F.expr(_KEYED).alias("k"), F.expr(_VARIANTS).alias("text"))
    old = b.select(F.expr("concat('o', item_id)").alias("id"), F.expr("CASE WHEN item_id % 2 = 0 THEN concat('k', item_id) END").alias("k"), "text", F.col("item_id").cast("double").alias("old_from"))
    old = old.unionByName(b.filter("item_id % 5 = 0").select(F.expr("concat('r', item_id)").alias("id"), F.lit(None).cast("string").alias("k"), F.concat("text", F.lit(" rival")).alias("text"), (F.col("item_id") + 0.5).alias("old_from")))
    words = F.lower(F.trim(F.regexp_replace("text", "\\s+", " ")))
    return (df.withColumns({"tokens": T.tokens(F.col("text")), "w": words}) for df in (new, old))


def _decisions(spark, sf_dir):
    """Incoming rows and what to do with each: neighbours are rows of the same claim, and those that overlap."""
    new, old = _incoming(spark, sf_dir)
    pairs = M.similar(new, old, M.SUBJECT).select("new_id", "old_id")
    claims = new.select(F.col("id").alias("new_id"), "k").join(old.select(F.col("id").alias("old_id"), "k"), "k").select("new_id", "old_id")
    a = new.select(F.col("id").alias("new_id"), F.col("k").alias("ak"), F.col("tokens").alias("x"), F.col("w").alias("aw"))
    b = old.select(F.col("id").alias("old_id"), "old_from", F.col("k").alias("bk"), F.col("tokens").alias("y"), F.col("w").alias("bw"))
    p = pairs.unionByName(claims).distinct().join(a, "new_id").join(b, "old_id")
    cosine = F.when(F.size("x") * F.size("y") == 0, 0.0).otherwise(F.size(F.array_intersect("x", "y")) / F.sqrt((F.size("x") * F.size("y")).cast("double")))
    same = F.col("aw") == F.col("bw")
    p = p.select("new_id", F.col("ak").isNotNull().alias("keyed"), "old_id", "old_from", T.jaccard(F.col("x"), F.col("y")).alias("overlap"), cosine.alias("sim"), F.coalesce(F.col("ak") == F.col("bk"), F.lit(False)).alias("same_key"), same.alias("same_text"), same.alias("same_words"))
    made = new.select(F.col("id").alias("new_id")).join(M.decide(p), "new_id", "left")
    return new, old, made.withColumn("op", F.coalesce("op", F.lit("ADD")))


@query(f"WITH {_PAIRS.replace('AS STRING', 'AS VARCHAR')} SELECT a.id AS new_id, coalesce(op, 'ADD') AS op, CASE WHEN op <> 'ADD' AND NOT unsure THEN old_id END AS target, round(overlap, 9) AS overlap FROM a LEFT JOIN dc ON a.id = new_id")
def resolve_decisions(spark, sf_dir):
    """What to do with each incoming row: add, leave, supersede or relate; the cosine of the token sets is the similarity."""
    return _decisions(spark, sf_dir)[2].withColumn("overlap", F.round("overlap", 9))


@query(f"WITH {_PAIRS.replace('AS STRING', 'AS VARCHAR')}, gone AS (SELECT old_id, min(new_id) AS by_id FROM dc WHERE op = 'INVALIDATE' GROUP BY old_id) SELECT od.id, od.old_from AS valid_from, CASE WHEN gone.old_id IS NOT NULL THEN 1000.0::DOUBLE END AS valid_to, by_id AS superseded_by FROM od LEFT JOIN gone ON od.id = old_id UNION ALL SELECT a.id, 1000.0::DOUBLE, NULL, NULL FROM a LEFT JOIN dc ON a.id = new_id WHERE coalesce(op, 'ADD') <> 'NOOP'")
def resolve_store(spark, sf_dir):
    """The table after the decisions, as of time 1000: superseded rows are closed and linked to their (first) successor, the rest is appended."""
    new, old, made = _decisions(spark, sf_dir)
    made = made.select("new_id", "op", "target")
    gone = made.filter("op = 'INVALIDATE'").groupBy("target").agg(F.min("new_id").alias("superseded_by"))
    closed = old.join(gone, F.col("id") == F.col("target"), "left").select("id", F.col("old_from").alias("valid_from"), F.when(F.col("target").isNotNull(), 1000.0).alias("valid_to"), "superseded_by")
    fresh = made.filter("op <> 'NOOP'").select(F.col("new_id").alias("id"), F.lit(1000.0).alias("valid_from"), F.lit(None).cast("double").alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"))
    return closed.unionByName(fresh)


@query("WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS was FROM orders) SELECT o_orderkey, CASE WHEN was IS NULL THEN 'ADD' WHEN was = o_orderstatus THEN 'NOOP' ELSE 'INVALIDATE' END AS op FROM o")
def resolve_keyed_claims(spark, sf_dir):
    """Keyed claims folded in the order of their time: equal text is NOOP, another INVALIDATE."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("was", F.lag("o_orderstatus").over(w))
    return o.select("o_orderkey", F.when(F.col("was").isNull(), "ADD").when(F.col("was") == F.col("o_orderstatus"), "NOOP").otherwise("INVALIDATE").alias("op"))


_q = lambda x: x.replace("'", "''")
_NUM = "list_sort(list_distinct(list_transform(regexp_extract_all({}, '" + _q(M.NUMBER) + "'), lambda x: lower(regexp_replace(x, '\\s+', '', 'g')))))"
_POL = "CASE WHEN regexp_matches({0}, '" + _q(M.NEGATIVE) + "') THEN -1 WHEN regexp_matches({0}, '" + _q(M.POSITIVE) + "') THEN 1 ELSE 0 END"
_LATE = "regexp_matches(a.text, '" + _q(M.TEMPORAL) + "')"
_PART = lambda x, k: f"regexp_extract_all({x}, '{_q(M.STATEMENT)}', {k})"


def _said(x: str) -> str:
    end = f"string_split_regex(z[4], '{_q(M.OBJECT_END)}')[1]"
    predicate = "regexp_replace(trim(regexp_replace(lower(z[3]), '\\s+', ' ', 'g')), 's+$', '')"
    made = f"{{'s': {T.tokens_sql('z[1]')}, 'n': z[2] <> '', 'p': {predicate}, 'o': {T.tokens_sql(end)}}}"
    return f"list_slice(list_filter(list_transform(list_zip({', '.join(_PART(x, k) for k in range(1, 5))}), lambda z: {made}), lambda z: len(z.s) > 0 AND len(z.o) > 0), 1, 8)"


_AGAINST = f"len(list_filter(a.said, lambda x: len(list_filter(b.said, lambda y: x.p = y.p AND {T.jaccard_sql('x.s', 'y.s')} >= 0.5 AND (x.n <> y.n OR (len(list_intersect(x.o, y.o)) / greatest(1, least(len(x.o), len(y.o)))::DOUBLE < 0.8 AND {T.jaccard_sql('x.o', 'y.o')} < 0.55)))) > 0)) > 0"


_NEWER = "CASE item_id % 6 WHEN 0 THEN text || ' now 42 ms' WHEN 1 THEN text WHEN 2 THEN text || ' and is not allowed: it is disabled' WHEN 3 THEN 'many more words with further detail appear here ' || text WHEN 4 THEN text || '. the cache service uses redis cluster; for speed' ELSE text || ' the limit is now 30 mb' END"
_OLDER = "CASE item_id % 6 WHEN 0 THEN text || ' 41 ms' WHEN 2 THEN text || ' and it must be so' WHEN 3 THEN substr(text, 1, CAST(floor(length(text) * 0.5) AS INT)) WHEN 4 THEN text || '. the cache service uses postgres tables when slow' WHEN 5 THEN 'other words' ELSE text END"


@query(
    f"""WITH c AS (SELECT item_id, {_NEWER} AS x, {_OLDER} AS y FROM benchmark), a AS (SELECT item_id, x AS text, {T.tokens_sql('x')} AS t, {_said('x')} AS said FROM c), b AS (SELECT item_id, y AS text, {T.tokens_sql('y')} AS t, {_said('y')} AS said FROM c),
p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, {T.jaccard_sql('a.t', 'b.t')} AS ov, {_LATE} AS late, len(a.t) AS na, len(b.t) AS nb, len(list_intersect(a.t, b.t)) AS k, {_AGAINST} AS ast,
  {_POL.format('a.text')} * {_POL.format('b.text')} = -1 AS opp, len({_NUM.format('a.text')}) > 0 AND len({_NUM.format('b.text')}) > 0 AND {_NUM.format('a.text')} <> {_NUM.format('b.text')} AS num FROM a JOIN b ON a.item_id = b.item_id),
i AS (SELECT *, CASE WHEN ov >= 0.82 THEN 0.25::DOUBLE + least(0.15::DOUBLE, ov - 0.82::DOUBLE) END AS s1, CASE WHEN ov >= 0.24 AND opp THEN CASE WHEN late THEN 0.88 ELSE 0.78 END END::DOUBLE AS s2, CASE WHEN ov >= 0.24 AND num THEN CASE WHEN late THEN 0.86 ELSE 0.74 END END::DOUBLE AS s3, CASE WHEN ast THEN CASE WHEN late THEN 0.9::DOUBLE ELSE 0.82::DOUBLE END + 0.12::DOUBLE * ov END AS s5,
  CASE WHEN ov < 0.82 AND na > nb + 2 AND k::DOUBLE / greatest(nb, 1) >= 0.72 AND NOT (ov >= 0.24 AND (opp OR num)) AND NOT ast THEN 0.42::DOUBLE END AS s4 FROM p)
SELECT a_id, b_id, CASE WHEN s2 IS NOT NULL OR s3 IS NOT NULL OR s5 IS NOT NULL THEN CASE WHEN late THEN 'obsolete' ELSE 'contradiction' END WHEN s4 IS NOT NULL THEN 'refinement' ELSE 'duplicate' END AS kind, round(greatest(coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0), coalesce(s4, 0), coalesce(s5, 0)), 4) AS severity FROM i WHERE s1 IS NOT NULL OR s2 IS NOT NULL OR s3 IS NOT NULL OR s4 IS NOT NULL OR s5 IS NOT NULL"""
)
def conflict_pairs(spark, sf_dir):
    """Contradictions, refinements and duplicates between two states of every text (both derived from it)."""
    c = table(spark, sf_dir, "benchmark").select("item_id", F.expr(_NEWER).alias("a_text"), F.expr(_OLDER).alias("b_text"))
    return M.conflicts(c.select(F.col("item_id").alias("a_id"), F.col("item_id").alias("b_id"), "a_text", "b_text", T.tokens(F.col("a_text")).alias("a_tokens"), T.tokens(F.col("b_text")).alias("b_tokens")))


@query(f"WITH {_PAIRS.split('pq AS')[0].rstrip().rstrip(',').replace('AS STRING', 'AS VARCHAR')}, p AS (SELECT x.id AS new_id, y.id AS old_id, {T.jaccard_sql('x.t', 'y.t')} AS overlap FROM a x, b y) SELECT new_id, old_id, round(overlap, 9) AS overlap FROM p QUALIFY overlap >= 0.15 AND row_number() OVER (PARTITION BY new_id ORDER BY overlap DESC, old_id) <= 3")
def evolve_links(spark, sf_dir):
    """The three most related rows, from an overlap of 0.15 on, of every incoming row."""
    new, old = _incoming(spark, sf_dir)
    w = Window.partitionBy("new_id").orderBy(F.desc("overlap"), "old_id")
    return M.similar(new, old, M.RELATED).withColumn("n", F.row_number().over(w)).filter("n <= 3").select("new_id", "old_id", F.round("overlap", 9).alias("overlap"))


_CL = f"WITH RECURSIVE b AS (SELECT item_id, {T.tokens_sql('text')} AS t FROM benchmark), e AS (SELECT x.item_id AS src, y.item_id AS dst FROM b x JOIN b y ON x.item_id <> y.item_id WHERE {T.jaccard_sql('x.t', 'y.t')} >= 0.03), r AS (SELECT src AS id, src AS reach FROM e UNION SELECT r.id, e.dst FROM r JOIN e ON r.reach = e.src), cl AS (SELECT id, min(reach) AS cluster FROM r GROUP BY id)"


@query(_CL + " SELECT id, cluster FROM cl")
def consolidate_clusters(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    return M.clusters(b, 0.03)


@query(_CL + ", m AS (SELECT cluster, unnest(t) AS token FROM cl JOIN b ON id = item_id), s AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1), k AS (SELECT cluster, token, count(*) AS k FROM m GROUP BY ALL), f AS (SELECT cluster, token, k, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, token)::INTEGER AS position FROM k JOIN s USING (cluster) WHERE k >= greatest(2, n // 2 + 1)) SELECT * FROM f WHERE position <= 5")
def common_tokens(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    return M.common_tokens(M.clusters(b, 0.03).join(b, "id"))


@query(f"WITH {MEM_SQL} SELECT id, round({RET_SQL}, 9) AS retention FROM mem WHERE mtype IN ('working', 'episodic') AND NOT pinned AND {RET_SQL} < 0.05 AND {visible_sql()}")
def archive_sweep(spark, sf_dir):
    m = memories(spark, sf_dir, content=False).filter(F.col("mtype").isin("working", "episodic") & ~F.col("pinned") & visible())
    return m.withColumn("retention", S.retention(F.col("last_access"), F.col("stability"))).filter("retention < 0.05").select("id", F.round("retention", 9).alias("retention"))


@query(f"WITH {MEM_SQL}, t AS (SELECT subject_key, content FROM mem) SELECT subject_key, count(*) AS members, sum({T.estimate_tokens_sql('content')})::BIGINT AS before, max({T.estimate_tokens_sql('content')})::BIGINT AS after FROM t GROUP BY subject_key")
def compaction_accounting(spark, sf_dir):
    """Tokens of a subject's rows before and after keeping one."""
    m = memories(spark, sf_dir).select("subject_key", T.estimate_tokens(F.col("content")).cast("long").alias("t"))
    return m.groupBy("subject_key").agg(F.count(F.lit(1)).alias("members"), F.sum("t").alias("before"), F.max("t").alias("after"))


@query(f"WITH {MEM_SQL} SELECT subject_key, bool_and(trusted) AS trusted, bool_or(pinned) AS pinned, max(stability) AS stability, round(min(confidence), 9) AS confidence FROM mem GROUP BY subject_key")
def safety_inheritance(spark, sf_dir):
    """What a digest or merge inherits from its members."""
    m = memories(spark, sf_dir, content=False)
    return m.groupBy("subject_key").agg(F.bool_and("trusted").alias("trusted"), F.bool_or("pinned").alias("pinned"), F.max("stability").alias("stability"), F.round(F.min("confidence"), 9).alias("confidence"))


# Spellings of part names: as they are, in one word, in capitals with more spaces, in another order, and two that only marks tell apart.
_SPELT = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN '  ' || replace(upper(p_name), ' ', '   ') WHEN 3 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 4 THEN p_name || ' C++' ELSE p_name || ' C#' END"
_TOKENS = "list_sort(list_distinct(list_filter(string_split_regex(n, '[^a-z0-9]+'), lambda t: length(t) >= 2)))"


@query(f"""WITH RECURSIVE e AS (SELECT p_partkey AS id, p_brand AS w, p_type AS y, lower(trim(regexp_replace({_SPELT}, '\\s+', ' ', 'g'))) AS n FROM part),
x AS (SELECT w, y, n, min(id) AS node, replace(n, ' ', '') AS c, regexp_replace(n, '[a-z0-9 ]+', '', 'g') AS m, {_TOKENS} AS t FROM e GROUP BY ALL),
l AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.w = b.w AND a.y = b.y AND (a.c = b.c OR (a.m = b.m AND len(list_intersect(a.t, b.t)) >= 0.6::DOUBLE * greatest(len(a.t), len(b.t)) AND len(list_intersect(a.t, b.t)) > 0))),
r AS (SELECT node, node AS reach FROM x UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a), g AS (SELECT node, min(reach) AS grp FROM r GROUP BY node),
p AS (SELECT e.id, x.node, g.grp FROM e JOIN x USING (w, y, n) JOIN g USING (node)), s AS (SELECT grp, min(id) AS canonical_id, count(*) AS members, count(DISTINCT node) AS nodes FROM p GROUP BY grp)
SELECT id, canonical_id, CASE WHEN members = 1 THEN 'identity' WHEN nodes = 1 THEN 'exact_normalized' ELSE 'closure' END AS method, members FROM p JOIN s USING (grp)""")
def entity_canonicalize(spark, sf_dir):
    """One id for all spellings of a name within a brand and type."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("workspace"), F.col("p_type").alias("etype"), F.expr(_SPELT).alias("name"), F.lit(None).cast("long").alias("canonical_id"))
    return N.canonical_entities(p)


@query("WITH e AS (SELECT p_partkey AS id, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS n FROM part) SELECT id, min(id) OVER (PARTITION BY n) AS canonical_id, count(*) OVER (PARTITION BY n) AS members FROM e")
def entity_exact_names(spark, sf_dir):
    return M.canonical_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


_DIFF = "WITH a AS (SELECT doc_id AS key, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT CASE WHEN doc_id % 10 = 2 THEN doc_id + 100000000 ELSE doc_id END AS key, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4), j AS (SELECT coalesce(a.key, b.key) AS key, a.h AS was, b.h AS now FROM a FULL JOIN b ON a.key = b.key), g AS (SELECT was FROM j WHERE now IS NULL GROUP BY was)"


@query(_DIFF + " SELECT key, CASE WHEN j.was IS NULL AND g.was IS NOT NULL THEN 'renamed' WHEN j.was IS NULL THEN 'new' WHEN now IS NULL THEN 'missing' WHEN j.was <> now THEN 'changed' ELSE 'unchanged' END AS state FROM j LEFT JOIN g ON j.now = g.was")
def import_diff(spark, sf_dir):
    """What changed between two states of a source (the second is derived from the first)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 10
    a = d.filter(k != 1).select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("hash"))
    b = d.filter(k != 4).select(F.when(k == 2, F.col("doc_id") + 100000000).otherwise(F.col("doc_id")).alias("key"), F.sha2(F.when(k == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return M.import_diff(a, b)


@query(f"WITH {MEM_SQL}, g AS (SELECT DISTINCT subject_key FROM mem JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0) SELECT id, CASE WHEN subject_key IN (SELECT subject_key FROM g) THEN least(coalesce(valid_to, {NOW}::DOUBLE), {NOW}::DOUBLE) ELSE valid_to END AS valid_to, subject_key IN (SELECT subject_key FROM g) AS closed FROM mem")
def close_validity(spark, sf_dir):
    """All rows after closing the subjects that a table names: an end that is already earlier stays."""
    m = memories(spark, sf_dir, content=False)
    gone = table(spark, sf_dir, "labels").filter("toxic = 1 and quality = 0").select("doc_id").distinct()
    subjects = m.join(gone, "doc_id", "left_semi").select("subject_key").distinct().withColumn("hit", F.lit(True))
    j = m.join(subjects, "subject_key", "left")
    hit = F.coalesce("hit", F.lit(False))
    return j.select("id", F.when(hit, F.least(F.coalesce("valid_to", F.lit(NOW)), F.lit(NOW))).otherwise(F.col("valid_to")).alias("valid_to"), hit.alias("closed"))


# Promotions asked for: a third of the rows to a repository, another to a workspace, in an order of arrival.
_ASKED = "CASE doc_id % 3 WHEN 0 THEN 'repo' WHEN 1 THEN 'workspace' END"
_RANKED = "CASE {0} WHEN 'session' THEN 0 WHEN 'repo' THEN 1 WHEN 'workspace' THEN 2 WHEN 'user' THEN 3 END"


@query(f"""WITH {MEM_SQL}, m AS (SELECT *, ['normal', 'sensitive', 'secret', 'odd'][(doc_id // 3 % 4 + 1)::INT] AS sensitivity, md5(coalesce(content, '')) AS body FROM mem), a AS (SELECT *, {_ASKED} AS target FROM m WHERE {_ASKED} IS NOT NULL),
s AS (SELECT *, CASE WHEN NOT trusted THEN 'not_approved' WHEN NOT ({visible_sql()}) THEN 'not_live' WHEN {_RANKED.format('target')} <= {_RANKED.format('scope')} THEN 'not_wider' WHEN target = 'repo' AND repo_id IS NULL THEN 'no_repo' ELSE 'promoted' END AS state FROM a),
p AS (SELECT s.*, CASE WHEN target = 'repo' THEN repo_id END AS to_repo FROM s WHERE state = 'promoted'),
g AS (SELECT workspace_id, to_repo, target, body, min(id) AS first, count(*) AS members, bool_or(pinned) AS pinned, max(stability) AS stability, max(CASE sensitivity WHEN 'normal' THEN 0 WHEN 'sensitive' THEN 1 WHEN 'secret' THEN 2 ELSE 3 END) AS rank FROM p GROUP BY ALL)
SELECT id, state, scope, valid_to, NULL::VARCHAR AS promoted_from, NULL::VARCHAR AS sensitivity, pinned, stability FROM s WHERE state <> 'promoted'
UNION ALL SELECT id, 'closed', scope, {NOW}::DOUBLE, NULL, NULL, pinned, stability FROM p
UNION ALL SELECT g.first || '_' || g.target, 'successor', g.target, NULL, (SELECT string_agg(p.id, ',' ORDER BY p.id) FROM p WHERE p.workspace_id IS NOT DISTINCT FROM g.workspace_id AND p.to_repo IS NOT DISTINCT FROM g.to_repo AND p.target = g.target AND p.body = g.body), ['normal', 'sensitive', 'secret', 'odd'][g.rank + 1], g.pinned, g.stability FROM g""")
def promote_rows(spark, sf_dir):
    """Rows that are widened to a repository or workspace: refused, or closed with a successor that inherits the strictest of each property."""
    m = memories(spark, sf_dir).withColumn("sensitivity", F.element_at(F.array(*map(F.lit, ("normal", "sensitive", "secret", "odd"))), (F.expr("doc_id div 3") % 4 + 1).cast("int")))
    asked = m.select("id", F.expr(_ASKED).alias("target")).filter("target is not null")
    return M.promoted(m, asked, visible(), NOW).select("id", "state", "scope", "valid_to", F.array_join("promoted_from", ",").alias("promoted_from"), "sensitivity", "pinned", "stability")


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def secure_erase(spark, sf_dir):
    """What is left after erasing: an anti-join."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(gone, "doc_id", "left_anti").distinct()


@query(f"WITH {MEM_SQL}, r AS (SELECT id, round({RET_SQL}, 9) AS retention FROM mem WHERE NOT pinned) SELECT id, retention FROM r WHERE retention < 0.1 ORDER BY retention, id LIMIT 500")
def prune(spark, sf_dir):
    """The 500 least retained rows below the floor, without pinned ones."""
    m = memories(spark, sf_dir, content=False).filter("not pinned")
    r = m.select("id", F.round(S.retention(F.col("last_access"), F.col("stability")), 9).alias("retention")).filter("retention < 0.1")
    return r.orderBy("retention", "id").limit(500)


_UNION = f"""RECURSIVE {_PAIRS.split('pq AS')[0].rstrip().rstrip(',').replace('AS STRING', 'AS VARCHAR')}, ed AS (SELECT id AS src, 'key:' || k AS dst FROM a WHERE k IS NOT NULL UNION ALL SELECT id, 'entity:' || CAST(substr(string_split(id, '_')[1], 2)::INT // 10 AS VARCHAR) FROM a WHERE string_split(id, '_')[2] = '4' UNION ALL SELECT x.id, y.id FROM a x JOIN a y ON x.id < y.id WHERE {T.jaccard_sql('x.t', 'y.t')} >= 0.7),
un AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), rc AS (SELECT src AS id, src AS reach FROM un UNION SELECT rc.id, un.dst FROM rc JOIN un ON rc.reach = un.src), cl AS (SELECT id, min(reach) AS cluster FROM rc WHERE id LIKE 'n%' GROUP BY id)"""


@query(f"WITH {_UNION}, m AS (SELECT cluster, id, string_split(id, '_')[2] = '0' AS done FROM cl) SELECT cluster, count(*) AS members, count(*) FILTER (WHERE NOT done) AS pending, count(*) || ' notes: ' || string_agg(CASE WHEN NOT done THEN id END, ', ' ORDER BY id) AS digest FROM m GROUP BY cluster HAVING count(*) FILTER (WHERE NOT done) >= 2")
def consolidation_digests(spark, sf_dir):
    """Clusters of rows that share a claim, an entity or most of their words, with two or more members that no digest has yet."""
    new, _ = _incoming(spark, sf_dir)
    new = G.cut(new)
    variant = F.element_at(F.split("id", "_"), 2)
    keys = new.filter("k is not null").select(F.col("id").alias("src"), F.concat(F.lit("key:"), "k").alias("dst"))
    entities = new.filter(variant == "4").select(F.col("id").alias("src"), F.concat(F.lit("entity:"), F.expr("cast(cast(substr(split(id, '_')[0], 2) as int) div 10 as string)")).alias("dst"))
    alike = M.similar(new, new, 0.7).filter("new_id < old_id").select(F.col("new_id").alias("src"), F.col("old_id").alias("dst"))
    of = G.components(keys.unionByName(entities).unionByName(alike)).filter("node like 'n%'")
    # A component's least node may be a claim or an entity: both sort before the rows.
    m = of.select(F.col("component").alias("cluster"), F.col("node").alias("id"), (F.element_at(F.split("node", "_"), 2) == "0").alias("done"))
    waiting = F.when(~F.col("done"), F.col("id"))
    g = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.count(waiting).alias("pending"), F.array_sort(F.collect_list(waiting)).alias("ids"))
    return g.filter("pending >= 2").select("cluster", "members", "pending", F.concat(F.col("members").cast("string"), F.lit(" notes: "), F.array_join("ids", ", ")).alias("digest"))
