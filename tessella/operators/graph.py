"""Graph operators over edge tables (src, dst, weight).

Iterative ones loop on the driver over DataFrames; each round is written to the shared
folder, so that lineage stays short and a lost executor costs only its tasks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAMPING, ROUNDS = 0.85, 30
#: From so many nodes on the steps of a walk are kept partitioned.
MANY_NODES = 500_000


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below that of spark.checkpoint.dir, deleted when the interpreter ends."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the folder of spark.checkpoint.dir and read again; deleted when the interpreter ends."""
    spark: SparkSession = df.sparkSession
    path = own_folder(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Cuts:
    """Written tables of the rounds of one operator, deleted when it is done: its result must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Cuts:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.path)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")


def clean(edges: DataFrame) -> DataFrame:
    """Finite positive weights within [1e-6, 1e6]; no loops; parallel edges summed."""
    w = F.col("weight")
    good = edges.filter(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")) & (F.col("src") != F.col("dst")))
    return good.groupBy("src", "dst").agg(F.sum(F.least(F.greatest(w.cast("double"), F.lit(1e-6)), F.lit(1e6))).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, rounds: int = ROUNDS, damping: float = DAMPING, every: int = 5) -> DataFrame:
    """node, rank after a fixed number of rounds; restart on the seeds (column node), or everywhere.

    Weights are normalised by source; what dangling nodes hold goes to the restart.  A
    round shuffles the flows alone, summed up before, with the restart among them: the
    ranks of few nodes go to every task, where the steps of the walk are read (as Spark finds
    in the size of the last round); of more than MANY_NODES, the steps lie partitioned by their source and stay there
    (in memory or on disk, and recomputed from a written table if an executor is lost).
    """
    spark = edges.sparkSession
    with Cuts(spark) as cuts:
        both = cuts.save(undirected(clean(edges)))
        total = both.groupBy("src").agg(F.sum("weight").alias("total"))
        walk = cuts.save(both.join(total, "src").selectExpr("src", "dst", f"{damping}D * weight / total as share"))
        nodes = cuts.save(total.select(F.col("src").alias("node")))
        small = nodes.count() <= MANY_NODES
        if not small:
            walk = walk.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").persist(StorageLevel.MEMORY_AND_DISK)
        start = nodes if seeds is None else cuts.save(seeds.select("node").distinct())
        n = start.count()
        if not n:
            return edges.select(F.col("src").alias("node"), F.lit(0.0).alias("rank")).filter("false")
        # Every node of an undirected graph has an edge: only isolated seeds dangle, and what they hold is known without a walk.
        alone = 0 if seeds is None else start.join(nodes, "node", "left_anti").count()
        dangling = alone / n
        ranks = start.select("node", F.lit(1.0 / n).alias("rank"))
        for k in range(1, rounds + 1):
            again = (1 - damping) + damping * dangling
            flows = walk.join(ranks.withColumnRenamed("node", "src"), "src").selectExpr("dst as node", "rank * share as rank")
            ranks = flows.union(start.selectExpr("node", f"{again / n!r}D as rank")).groupBy("node").agg(F.sum("rank").alias("rank"))
            dangling = alone / n * again
            if k % every == 0 and k < rounds:
                ranks = cuts.save(ranks)
        out = cut(ranks if seeds is None else nodes.join(ranks, "node", "full").select("node", F.coalesce("rank", F.lit(0.0)).alias("rank")))
        if not small:
            walk.unpersist()
    return out


def bounded_walks(graph: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """query, node, rank for graphs that are bounded by their making: (query, src, dst, weight) with seeds (query, node).

    The ranks are those of ``pagerank``, of every query at once.  A query's graph must be
    of a fixed size at most (some 10,000 edges, as the caps of a walk give it): it is one
    group, so that the queries are what is spread over the cluster.  A query without a
    seed has no rows.
    """
    rows = graph.select("query", "src", "dst", "weight").unionByName(seeds.select("query", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("weight")))

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges, asked = pdf[pdf["dst"].notna()], pdf.loc[pdf["dst"].isna(), "src"].unique()
        w = edges["weight"].to_numpy(float)
        good = np.isfinite(w) & (w > 0) & (edges["src"] != edges["dst"]).to_numpy()
        edges, w = edges[good], np.clip(w[good], 1e-6, 1e6)
        names, at = np.unique(np.concatenate((edges["src"], edges["dst"], asked)).astype(object), return_inverse=True)
        a, b, s = np.split(at, (len(w), 2 * len(w)))
        src, dst, weight, n = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w)), len(names)
        held = np.bincount(src, weight, n)
        share, restart = weight / held[src], np.bincount(s, minlength=n) / max(len(s), 1)
        rank = restart
        for _ in range(rounds if len(s) else 0):
            flow = np.bincount(dst, rank[src] * share, n) + rank[held == 0].sum() * restart
            rank = (1 - damping) * restart + damping * flow
        keep = rank > 0
        return pd.DataFrame({"query": [key[0]] * int(keep.sum()), "node": names[keep], "rank": rank[keep]})

    return rows.groupBy("query").applyInPandas(walk, f"query {graph.schema['query'].dataType.simpleString()}, node string, rank double")


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds and their neighbours with the weight that reaches them."""
    both = undirected(clean(edges))
    near = both.join(seeds.select(F.col("node").alias("src")).distinct(), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("weight"))
    return near


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (least node reachable), by least labels with pointer jumping."""
    both = cut(undirected(edges.select("src", "dst", F.lit(1.0).alias("weight"))).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("label")))
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("low"))
        mid = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        nxt = cut(mid.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved")))
        labels = nxt.select("node", "label")
        if nxt.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle within {most} rounds")
    return labels.select("node", F.col("label").alias("component"))


def penalty(relation: Column, layer: Column) -> Column:
    """What a path pays for an edge besides its strength: 1 for mere co-occurrence, else by layer."""
    return F.when(relation == "co_occurs", 1.0).when(layer == "temporal", 0.1).when(layer == "semantic", 0.2).otherwise(0.0)


def strongest_path(edges: DataFrame, source: str, hops: int = 8) -> DataFrame:
    """node, cost, hops of the cheapest path of at most ``hops`` edges; cost -ln(max(weight, 0.02)) per edge,
    and its ``penalty`` if the edges have that column.

    Bounded Bellman-Ford: each round relaxes all edges once.
    """
    if "penalty" not in edges.columns:
        edges = edges.withColumn("penalty", F.lit(0.0))
    both = edges.select("src", "dst", "weight", "penalty").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "penalty"))
    costs = cut(both.select("src", "dst", (F.col("penalty") - F.ln(F.least(F.greatest("weight", F.lit(0.02)), F.lit(1.0)))).alias("cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    best = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        step = best.select(F.col("node").alias("src"), F.col("cost").alias("had")).join(costs, "src").select(F.col("dst").alias("node"), (F.col("had") + F.col("cost")).alias("cost"), F.lit(k).alias("hops"))
        both = best.unionByName(step).groupBy("node").agg(F.min(F.struct("cost", "hops")).alias("b")).select("node", "b.cost", "b.hops")
        best = cut(both)
    return best


def bfs(edges: DataFrame, source: str, hops: int = 32) -> DataFrame:
    """node, depth of the nodes within ``hops`` edges along the direction of the edges."""
    step = cut(edges.select("src", "dst").distinct())
    seen = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.lit(0).alias("depth"))
    front = seen
    for k in range(1, hops + 1):
        new = front.join(step, front["node"] == step["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k))
        front = cut(new)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def strength(weight: Column, confidence: Column, supports: Column, relation: Column) -> Column:
    """Raw strength of an edge bundle."""
    factor = F.when(relation == "co_occurs", 0.25).when(relation.isin("entity", "causal"), 1.0).when(relation == "temporal", 0.9).otherwise(0.8)
    return F.least(F.greatest(weight, F.lit(0.05)), F.lit(4.0)) * confidence * (1 + F.least(F.log2(1.0 + supports) / 4, F.lit(0.75))) * factor


def noisy_or(confidence: Column) -> Column:
    """1 - prod(1 - c) over independent supports, c within [0.05, 0.99]."""
    return 1 - F.exp(F.sum(F.ln(1 - F.least(F.greatest(confidence, F.lit(0.05)), F.lit(0.99)))))


def scaled(edges: DataFrame, raw: str) -> DataFrame:
    """raw as strength from 0 to 1 between its 5th and 95th percentile on a log scale; flat gives 1."""
    q = edges.agg(F.percentile(F.log1p(raw), F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    value = F.when(hi - lo < 1e-12, 1.0).otherwise(F.least(F.greatest((F.log1p(raw) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    return edges.join(F.broadcast(q)).withColumn("strength", value).drop("q")  # one row


def soft_mass(nodes: DataFrame, parts) -> DataFrame:
    """node, mass: the weighted sum of evidence columns (name, weight), each 1 - exp(-ln(1 + x) / ln(1 + p95)) with the
    95th percentile of its positive values; without any, or for values of 0 and less, 0."""
    q = nodes.agg(*[F.percentile(F.when(F.col(c) > 0, F.col(c).cast("double")), F.lit(0.95)).alias(f"{c}_p95") for c, _ in parts])
    all_ = nodes.join(F.broadcast(q))  # one row
    mass = sum((w * F.when((F.col(c) > 0) & (F.col(f"{c}_p95") > 0), 1 - F.exp(-F.log1p(F.col(c).cast("double")) / F.log1p(F.col(f"{c}_p95")))).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return all_.select("node", mass.alias("mass"))


def _sequential(pdf: pd.DataFrame, louvain: bool, sweeps: int) -> dict:
    """Moves in sorted order, each seeing those before it: Louvain's gain or weighted label propagation."""
    near: dict = {}
    for s, d, w in zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True):
        near.setdefault(s, {})
        near.setdefault(d, {})
        near[s][d] = near[s].get(d, 0.0) + w
        near[d][s] = near[d].get(s, 0.0) + w
    degree = {v: sum(x.values()) for v, x in near.items()}
    total = sum(degree.values()) or 1.0
    of = {v: v for v in near}
    held = dict(degree)
    for _ in range(sweeps):
        moved = False
        for v in sorted(near):
            to: dict = {}
            for u, w in near[v].items():
                to[of[u]] = to.get(of[u], 0.0) + w
            if louvain:
                held[of[v]] -= degree[v]
                best = of[v]
                most = to.get(best, 0.0) - held[best] * degree[v] / total
                for c in sorted(to):
                    gain = to[c] - held[c] * degree[v] / total
                    if gain > most + 1e-12:
                        best, most = c, gain
                held[best] += degree[v]
            else:
                best = min(to, key=lambda c: (-to[c], c)) if to else of[v]
            if best != of[v]:
                of[v], moved = best, True
        if not moved:
            break
    return of


def communities(edges: DataFrame, method: str = "louvain", sweeps: int = 24) -> DataFrame:
    """node, community by one level of Louvain, or by label propagation.

    Moves depend on those before them, so each connected component is one group of
    pandas work; components are spread over the cluster.
    """
    e = cut(clean(edges))
    of = components(e)
    dealt = e.join(of.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", "weight")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _sequential(pdf, method == "louvain", sweeps)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    return dealt.groupBy("component").applyInPandas(solve, "node string, community string")
