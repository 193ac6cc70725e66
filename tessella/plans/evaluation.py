"""Retrieval quality: every hundredth vector as a query, rows of the same label as gold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.model import table
from tessella.operators import metrics as M
from tessella.operators import retrieval as R
from tessella.plans.base import query

_RANKED = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id AS id, v.label, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s), rel AS (SELECT query_id, count(*) FILTER (WHERE ql = label) AS relevant FROM s GROUP BY 1 HAVING relevant > 0), m AS (SELECT query_id, relevant, sum((ql = label)::INT) AS hits, min(CASE WHEN ql = label THEN position END) AS first, sum((ql = label)::INT / log2(position + 1.0::DOUBLE)) AS dcg, count(*) AS shown FROM k JOIN rel USING (query_id) WHERE position <= 10 GROUP BY ALL)"


def scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    ranked = R.batch_knn(e, q, 10).select("query_id", F.col("vec_id").alias("id"), "position")
    return M.summed(M.marked_by_group(ranked, q.select("query_id", "label"), e.select(F.col("vec_id").alias("id"), "label"), "label"), 10)


@query(f"WITH {_RANKED} SELECT query_id, round(hits / relevant::DOUBLE, 9) AS recall, (hits > 0)::INTEGER AS hit FROM m")
def recall_at_k(spark, sf_dir):
    return scores(spark, sf_dir).select("query_id", F.round("recall", 9).alias("recall"), "hit")


@query(f"WITH {_RANKED} SELECT query_id, round(coalesce(1.0::DOUBLE / first, 0), 9) AS mrr FROM m")
def mrr(spark, sf_dir):
    return scores(spark, sf_dir).select("query_id", F.round("mrr", 9).alias("mrr"))


@query(f"WITH {_RANKED} SELECT query_id, round(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 9) AS ndcg FROM m")
def ndcg(spark, sf_dir):
    return scores(spark, sf_dir).select("query_id", F.round("ndcg", 9).alias("ndcg"))


@query(f"WITH {_RANKED} SELECT query_id, round(hits / shown::DOUBLE, 9) AS precision, round(CASE WHEN hits = 0 THEN 0.0 ELSE 2 * (hits / relevant::DOUBLE) * (hits / shown::DOUBLE) / (hits / relevant::DOUBLE + hits / shown::DOUBLE) END, 9) AS f1 FROM m")
def precision_recall_f1(spark, sf_dir):
    return scores(spark, sf_dir).select("query_id", F.round("precision", 9).alias("precision"), F.round("f1", 9).alias("f1"))


@query(f"WITH a AS (SELECT item_id, {T.tokens_sql('text')} AS t FROM benchmark), d AS (SELECT doc_id, {T.tokens_sql('text')} AS t FROM documents) SELECT item_id, round(max(len(list_intersect(a.t, d.t))::DOUBLE / len(a.t)), 9) AS recall FROM a, d WHERE len(a.t) > 0 GROUP BY item_id")
def answer_token_recall(spark, sf_dir):
    """The best share of an answer's tokens that one document holds.

    Tokens meet in an inverted index; an answer without any match has recall 0.
    """
    a = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t")).filter("size(t) > 0")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    hits = a.select("item_id", F.explode("t").alias("token")).join(d, "token").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("item_id").agg(F.max("k").alias("k"))
    return a.join(hits, "item_id", "left").select("item_id", F.round(F.coalesce("k", F.lit(0)) / F.size("t"), 9).alias("recall"))


@query(f"WITH t AS (SELECT conv_id, turn, {T.estimate_tokens_sql('text')} AS n, role, text FROM conversations), w AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text ROWS UNBOUNDED PRECEDING) AS spent FROM t) SELECT conv_id, turn, n AS tokens, spent::BIGINT AS spent FROM w WHERE spent <= 120")
def recency_window(spark, sf_dir):
    """The newest turns of each conversation, without a gap, under 120 tokens."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", T.estimate_tokens(F.col("text")).alias("tokens"))
    return R.recency_window(c, 120, ["conv_id"], "tokens", F.desc("turn"), F.col("role"), F.col("text")).select("conv_id", "turn", "tokens", "spent")


@query(f"WITH t AS (SELECT conv_id, sum({T.estimate_tokens_sql('text')}) AS whole FROM conversations GROUP BY 1), b AS (SELECT unnest([50, 100, 200, 400]) AS budget) SELECT budget, count(*) FILTER (WHERE whole <= budget) AS fit, count(*) AS n FROM t, b GROUP BY budget")
def fixed_budget_curve(spark, sf_dir):
    """How many conversations fit each budget; the budgets are spread within the row."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("whole"))
    return t.withColumn("budget", F.explode(F.array(*map(F.lit, (50, 100, 200, 400))))).groupBy("budget").agg(F.count_if(F.col("whole") <= F.col("budget")).alias("fit"), F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT quantile_cont(value, [0.5, 0.95, 0.99]) AS q, event_type FROM events GROUP BY event_type) SELECT event_type, round(q[1], 6) AS p50, round(q[2], 6) AS p95, round(q[3], 6) AS p99 FROM s")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q"))
    return e.select("event_type", *[F.round(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate((50, 95, 99))])


@query("WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) SELECT conv_id, count(*) FILTER (WHERE n <= 3) AS last_n, max(CASE WHEN n = 1 THEN turn END) AS newest FROM n GROUP BY conv_id")
def handoff_strategies(spark, sf_dir):
    """What the last three turns hand over."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    n = c.withColumn("n", F.row_number().over(w))
    return n.groupBy("conv_id").agg(F.count_if(F.col("n") <= 3).alias("last_n"), F.max(F.when(F.col("n") == 1, F.col("turn"))).alias("newest"))


REPLICATES = 200
_ONE = f"(xor(x, x >> 16) * {M.MIX[2]}) % 4294967296"


@query(f"WITH x AS (SELECT event_id, event_type, value - 5 AS gain FROM events), h0 AS (SELECT event_type, gain, r, (event_id * {M.MIX[0]} + r * {M.MIX[1]}) % 4294967296 AS x FROM x, (SELECT unnest(range(1, {REPLICATES} + 1)) AS r)), h1 AS (SELECT event_type, gain, r, {_ONE} AS x FROM h0), h2 AS (SELECT event_type, gain, r, {_ONE} AS x FROM h1), s AS (SELECT event_type, gain, r, xor(x, x >> 16) / 4294967296.0::DOUBLE AS u FROM h2), w AS (SELECT *, {' + '.join(f'(u >= {c}::DOUBLE)::INT' for c in M.DRAWS)} AS w FROM s), m AS (SELECT event_type, r, sum(w * gain) / sum(w) AS mean FROM w GROUP BY ALL HAVING sum(w) > 0), e AS (SELECT event_type, avg(gain) AS mean FROM x GROUP BY 1) SELECT event_type, round(any_value(e.mean), 6) AS mean, round(quantile_cont(m.mean, 0.025), 6) AS low, round(quantile_cont(m.mean, 0.975), 6) AS high FROM m JOIN e USING (event_type) GROUP BY event_type")
def bootstrap_ci(spark, sf_dir):
    """Mean paired gain of every stratum with its 95 percent interval over 200 bootstrap replicates."""
    x = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") - 5).alias("gain"))
    m = M.bootstrap_sums(x, "event_id", "event_type", "gain", REPLICATES).filter("n > 0").withColumn("m", F.col("total") / F.col("n"))
    ci = m.groupBy(F.col("stratum").alias("event_type")).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return x.groupBy("event_type").agg(F.round(F.avg("gain"), 6).alias("mean")).join(ci, "event_type").select("event_type", "mean", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))
