"""Graph queries over the brand-supplier graph of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.model import table
from tessella.operators import graph as G
from tessella.plans.base import query

EDGE_SQL = "ed AS (SELECT p_brand AS src, 'supplier_' || l_suppkey::VARCHAR AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), un AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and suppliers, weighted by common lines; lines are counted by part and supplier first."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("src"))
    return lines.join(brands, "l_partkey").groupBy("src", F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("dst")).agg(F.sum("n").cast("double").alias("weight"))


@query(f"WITH {EDGE_SQL} SELECT src AS node, count(*) AS degree, sum(weight) AS weight FROM un GROUP BY src ORDER BY count(*) DESC, sum(weight) DESC, src LIMIT 12")
def graph_degree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.undirected(edges(spark, sf_dir)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight")).orderBy(F.desc("degree"), F.desc("weight"), "node").limit(12)


@query(f"WITH {EDGE_SQL} SELECT dst AS node, sum(weight) AS weight FROM un WHERE src IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY dst")
def graph_neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("Brand#11", "Brand#12", "Brand#13")))).alias("node"))
    return G.one_hop(edges(spark, sf_dir), seeds)


def _ranks_sql(restart: str, rounds: int) -> str:
    steps = [f"wk AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM un), nd AS MATERIALIZED (SELECT DISTINCT src AS node FROM un), b AS MATERIALIZED (SELECT node, {restart} AS restart FROM nd), r0 AS (SELECT node, restart AS rank FROM b)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT b.node, 0.15::DOUBLE * restart + 0.85::DOUBLE * coalesce(flow, 0) AS rank FROM b LEFT JOIN (SELECT dst, sum(rank * share) AS flow FROM r{k - 1} JOIN wk ON node = src GROUP BY dst) f ON b.node = f.dst)")
    return f"WITH {EDGE_SQL}, " + ", ".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query(_ranks_sql("CASE WHEN node IN ('Brand#11', 'Brand#23') THEN 0.5::DOUBLE / (CASE WHEN (SELECT count(*) FROM nd WHERE node IN ('Brand#11', 'Brand#23')) = 2 THEN 1 ELSE 0.5 END) ELSE 0 END", 30))
def ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personalised PageRank from two brands."""
    e = G.cut(edges(spark, sf_dir))
    seeds = e.select(F.col("src").alias("node")).filter(F.col("node").isin("Brand#11", "Brand#23")).distinct()
    return G.pagerank(e, seeds).withColumn("rank", F.round("rank", 9))


@query(_ranks_sql("1.0::DOUBLE / (SELECT count(*) FROM nd)", 32))
def global_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(edges(spark, sf_dir), rounds=32).withColumn("rank", F.round("rank", 9))


_TREE = "SELECT 'c' || c_custkey::VARCHAR AS src, 'n' || c_nationkey::VARCHAR AS dst FROM customer UNION SELECT 's' || s_suppkey::VARCHAR, 'n' || s_nationkey::VARCHAR FROM supplier UNION SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR FROM nation"


@query(f"WITH RECURSIVE e AS ({_TREE}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS reach FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON r.reach = u.src) SELECT node, min(reach) AS component FROM r GROUP BY node")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of customers, suppliers, nations and regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = [table(spark, sf_dir, t).select(name(p, a).alias("src"), name(q, b).alias("dst")) for t, p, a, q, b in (("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"))]
    return G.components(rows[0].unionByName(rows[1]).unionByName(rows[2]))


_PATH = ["pc AS MATERIALIZED (SELECT src, dst, -ln(least(greatest(weight / (SELECT max(weight) FROM ed), 0.02::DOUBLE), 1.0::DOUBLE)) AS cost FROM un)", "b0 AS (SELECT 'Brand#11' AS node, 0.0::DOUBLE AS cost)"]
for _k in range(1, 9):
    _PATH.append(f"b{_k} AS MATERIALIZED (SELECT node, min(cost) AS cost FROM (SELECT * FROM b{_k - 1} UNION ALL SELECT dst, b.cost + pc.cost FROM b{_k - 1} b JOIN pc ON b.node = pc.src) GROUP BY node)")


@query(f"WITH {EDGE_SQL}, {', '.join(_PATH)} SELECT node, round(cost, 9) AS cost FROM b8")
def strongest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest paths of at most eight edges from a brand."""
    e = G.cut(edges(spark, sf_dir))
    top = e.agg(F.max("weight").alias("top"))
    e = e.join(F.broadcast(top)).select("src", "dst", (F.col("weight") / F.col("top")).alias("weight"))  # one row
    return G.strongest_path(e, "Brand#11").select("node", F.round("cost", 9).alias("cost"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey::VARCHAR AS src, 's' || l_suppkey::VARCHAR AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT DISTINCT 's' || l_suppkey::VARCHAR, 'p' || l_partkey::VARCHAR FROM lineitem), f AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT e.dst, f.depth + 1 FROM f JOIN e ON f.node = e.src) SELECT node, min(depth)::INTEGER AS depth FROM f GROUP BY node")
def code_bfs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of everything that a node depends on (customer to supplier to part stands in for calls)."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    b = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return G.bfs(a.unionByName(b), "c1")


_SUP = "sp AS (SELECT p_brand AS src, 'supplier_' || l_suppkey::VARCHAR AS dst, l_orderkey AS support, max(0.3::DOUBLE + l_discount * 5) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), bu AS (SELECT src, dst, count(*) AS supports, 1 - exp(sum(ln(1 - least(greatest(confidence, 0.05::DOUBLE), 0.99::DOUBLE)))) AS confidence FROM sp GROUP BY ALL)"


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge bundles with their independent supports: the best confidence of each order, then noisy-or."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_discount")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("src"))
    sp = li.join(brands, "l_partkey").groupBy("src", F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("dst"), "l_orderkey").agg(F.max(0.3 + F.col("l_discount") * 5).alias("confidence"))
    return sp.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("supports"), G.noisy_or(F.col("confidence")).alias("confidence"))


@query(f"WITH {_SUP} SELECT src, dst, supports, round(confidence, 9) AS confidence FROM bu")
def edge_bundle_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))


_STR = f"{_SUP}, rw AS (SELECT src, dst, least(greatest(supports / 10.0::DOUBLE, 0.05::DOUBLE), 4.0::DOUBLE) * confidence * (1 + least(log2(1.0::DOUBLE + supports) / 4, 0.75::DOUBLE)) * CASE supports % 4 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS raw FROM bu), qs AS (SELECT quantile_cont(ln(1 + raw), 0.05) AS lo, quantile_cont(ln(1 + raw), 0.95) AS hi FROM rw), st AS (SELECT src, dst, raw, CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE least(greatest((ln(1 + raw) - lo) / (hi - lo), 0), 1) END AS strength FROM rw, qs)"


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("co_occurs", "entity", "temporal", "semantic"))), (F.col("supports") % 4 + 1).cast("int"))
    raw = bundles(spark, sf_dir).select("src", "dst", G.strength(F.col("supports") / 10.0, F.col("confidence"), F.col("supports"), kind).alias("raw"))
    return G.scaled(raw, "raw")


@query(f"WITH {_STR} SELECT src, dst, round(raw, 9) AS raw, round(strength, 6) AS strength FROM st")
def edge_strength_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strengths(spark, sf_dir).select("src", "dst", F.round("raw", 9).alias("raw"), F.round("strength", 6).alias("strength"))


@query("WITH e AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_orderkey AS id, l_linenumber AS line, l_discount AS confidence, l_shipdate AS valid_from FROM lineitem WHERE l_partkey <> l_suppkey), n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY valid_from, id, line) AS n FROM e), g AS (SELECT a, b, max(confidence) AS confidence, min(valid_from) AS valid_from, count(*) AS merged FROM e GROUP BY a, b) SELECT n.a, n.b, n.id AS survivor, g.confidence, g.merged FROM n JOIN g USING (a, b) WHERE n.n = 1")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One live edge for each unordered pair: the oldest survives with the best confidence of all.

    A single aggregation instead of a window and a join: least (time, id, line) and the maximum.
    """
    e = table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), "l_orderkey", "l_linenumber", "l_discount", "l_shipdate")
    g = e.groupBy("a", "b").agg(F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first"), F.max("l_discount").alias("confidence"), F.count(F.lit(1)).alias("merged"))
    return g.select("a", "b", F.col("first.l_orderkey").alias("survivor"), "confidence", "merged")


@query("WITH f AS (SELECT 'status' AS facet, l_linestatus AS value FROM lineitem UNION ALL SELECT 'flag', l_returnflag FROM lineitem UNION ALL SELECT 'support', CASE WHEN l_quantity >= 40 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END FROM lineitem UNION ALL SELECT 'confidence', CASE WHEN l_discount >= 0.08 THEN '>=0.8' WHEN l_discount >= 0.05 THEN '0.5-0.8' ELSE '<0.5' END FROM lineitem) SELECT facet, value, count(*) AS n FROM f GROUP BY ALL")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every facet in one scan: grouping sets over four columns."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_quantity") >= 40, "high").when(F.col("l_quantity") >= 15, "medium").otherwise("low").alias("support"),
        F.when(F.col("l_discount") >= 0.08, ">=0.8").when(F.col("l_discount") >= 0.05, "0.5-0.8").otherwise("<0.5").alias("confidence"),
    )
    names = ("status", "flag", "support", "confidence")
    small = li.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return small.select(F.inline(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"), F.col("n").alias("k")) for f in names]))).groupBy("facet", "value").agg(F.sum("k").alias("n"))


@query("WITH t AS (SELECT cn.n_regionkey AS a, sn.n_regionkey AS b, count(*) AS edges, sum(l_discount) AS strength, count(DISTINCT l_orderkey) AS support FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_regionkey <> sn.n_regionkey GROUP BY ALL), u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(edges) AS edges, sum(strength) AS strength, sum(support) AS support FROM t GROUP BY ALL) SELECT a, b, edges::BIGINT AS edges, round(0.6::DOUBLE * ln(1 + strength) + 0.25::DOUBLE * ln(1 + support) + 0.15::DOUBLE * ln(1 + edges), 6) AS raw FROM u")
def community_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges between regions: trade from customers of one to suppliers of another."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("a"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("b"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey")
    both = li.join(s, "l_suppkey").join(o, "l_orderkey").filter("a <> b")
    per = both.groupBy("a", "b", "l_orderkey").agg(F.count(F.lit(1)).alias("edges"), F.sum("l_discount").alias("strength"))
    t = per.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("edges").alias("edges"), F.sum("strength").alias("strength"), F.count(F.lit(1)).alias("support"))
    return t.select("a", "b", "edges", F.round(0.6 * F.log1p("strength") + 0.25 * F.log1p("support") + 0.15 * F.log1p("edges"), 6).alias("raw"))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.communities(edges(spark, sf_dir))


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.communities(edges(spark, sf_dir), "labels", 30)


@query("WITH f AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS f, count(*) AS s, count(DISTINCT l_partkey) AS i, count(*) FILTER (l_returnflag = 'R') AS m, count(DISTINCT l_linestatus) AS c FROM lineitem GROUP BY l_orderkey), r AS (SELECT l_orderkey, least(100, 5 * f + 2 * s + 3 * i + 2 * m + 5 * c) AS risk FROM f) SELECT l_orderkey, risk, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level FROM r")
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of touching a node: files, symbols, inbound edges, memories and communities that depend on it."""
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("f"), F.count(F.lit(1)).alias("s"), F.countDistinct("l_partkey").alias("i"), F.count_if(F.col("l_returnflag") == "R").alias("m"), F.countDistinct("l_linestatus").alias("c"))
    risk = F.least(F.lit(100), F.expr("5 * f + 2 * s + 3 * i + 2 * m + 5 * c"))
    return f.select("l_orderkey", risk.alias("risk")).withColumn("level", F.when(F.col("risk") >= 75, "critical").when(F.col("risk") >= 50, "high").when(F.col("risk") >= 25, "medium").otherwise("low"))
