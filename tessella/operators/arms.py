"""Arms that rank memories through a graph of entities or of code, as joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import graph as G

# Strength of a symbol that has the identifier as its name, or within it, and what a hop keeps of it.
EXACT, PARTIAL, HOP = 1.0, 0.75, 0.55


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds and their neighbours."""
    near = G.undirected(edges).join(seeds.select(F.col("node").alias("src")).distinct(), "src").select(F.col("dst").alias("node"))
    return near.unionByName(seeds.select("node")).distinct()


def one_hop_arm(edges: DataFrame, seeds: DataFrame, incidence: DataFrame, k: int) -> DataFrame:
    """The k memories (id, score) with the most confidence of incidences (id, node, confidence) with seeds or neighbours."""
    hits = incidence.join(reached(edges, seeds), "node", "left_semi")
    return hits.groupBy("id").agg(F.sum("confidence").alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def ranked_arm(ranks: DataFrame, incidence: DataFrame, k: int) -> DataFrame:
    """The k memories with the most rank (node, rank) times confidence."""
    hits = incidence.join(ranks, "node")
    return hits.groupBy("id").agg(F.sum(F.col("rank") * F.col("confidence")).alias("score")).filter("score > 0").orderBy(F.desc(F.round("score", 12)), "id").limit(k)


# Words of a query that name no symbol, and bounds of the code arm.
NO_SYMBOLS = ["about", "called", "class", "code", "does", "file", "from", "function", "into", "module", "that", "this", "what", "where", "which", "with"]
IDENTIFIERS = 8


def identifiers_in(query: str) -> list[str]:
    """The first eight distinct identifiers of a query that could name a symbol, without regard to case."""
    found: dict[str, str] = {}
    for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", query or ""):
        if word.casefold() not in NO_SYMBOLS:
            found.setdefault(word.casefold(), word)
    return list(found.values())[:IDENTIFIERS]


def _within(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def code_arm(symbols: DataFrame, edges: DataFrame, links: DataFrame, query: str, k: int) -> DataFrame:
    """The k memories (id, score) linked to the symbols that a query names, or to their neighbours.

    A symbol (symbol, name, fqname) holds an identifier of the query in one of its names,
    whatever the case; it has 1 (a whole name) or 0.75 over its place among the matches
    of that identifier.  A neighbour (edges: src, dst) has 0.55 of that; a memory (links:
    symbol, id, confidence) the symbol's strength times its confidence over its place, at
    best.  Matches per identifier, edges, symbols and memories per symbol are bounded by k.
    """
    words = identifiers_in(query)
    if not words:
        return links.select("id", F.lit(0.0).alias("score")).filter("false")
    per_word, most_edges = _within(k // len(words), 2, 12), _within(20 * k, 100, 2000)
    names = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "fqname")]
    held = F.array(*[F.struct(F.lit(w.lower()).alias("word"), (F.contains(names[0], F.lit(w.lower())) | F.contains(names[1], F.lit(w.lower()))).alias("there"), ((names[0] == w.lower()) | (names[1] == w.lower())).alias("exact")) for w in words])
    hits = symbols.select("symbol", "name", F.inline(F.filter(held, lambda x: x["there"])))
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("name", "symbol"))).filter(F.col("place") <= per_word)
    strength = F.max(F.when(F.col("exact"), EXACT).otherwise(PARTIAL) / F.col("place")).alias("strength")
    own = G.cut(hits.groupBy("symbol").agg(strength))  # at most 8 * 12 rows
    one = lambda c: edges.select("src", "dst").distinct().join(F.broadcast(own.select(F.col("symbol").alias(c))), c, "left_semi")
    near = G.cut(one("src").unionByName(one("dst")).distinct().orderBy("src", "dst").limit(most_edges))
    hop = lambda a, b: near.join(F.broadcast(own.withColumnRenamed("symbol", a)), a).select(F.col(b).alias("symbol"), (F.col("strength") * HOP).alias("strength"))
    best = own.unionByName(hop("src", "dst")).unionByName(hop("dst", "src")).groupBy("symbol").agg(F.max("strength").alias("strength"))
    best = best.orderBy(F.desc("strength"), "symbol").limit(_within(2 * k, 10, 100))
    place = Window.partitionBy("symbol").orderBy(F.desc("confidence"), "id")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0))))
    linked = links.withColumn("confidence", confidence).join(F.broadcast(best), "symbol").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= _within(k, 2, 10))
    score = F.max(F.col("strength") * F.col("confidence") / F.col("place")).alias("score")
    return linked.groupBy("id").agg(score).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


# What the joint walk takes of entity edges, incidences, links, and of the newest memories.
EDGE_CAP, INCIDENCE_CAP, LINK_CAP, MEMORY_CAP = 4000, 12_000, 20_000, 12_000


def seeds_in(entities: DataFrame, query: str) -> DataFrame:
    """node: entities (node, name) whose name is in the query as whole words, whatever the case; with ``canonical`` also the rest of their groups."""
    low, name = query.lower(), F.lower("name")
    whole = F.regexp_like(F.lit(low), F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), name, F.lit("\\E(?![\\p{L}\\p{N}_])")))
    found = entities.filter(F.col("name").isNotNull() & (F.col("name") != "") & F.contains(F.lit(low), name)).filter(whole)
    if "canonical" not in entities.columns:
        return found.select("node").distinct()
    group = F.coalesce(F.nullif("canonical", F.lit("")), F.col("node"))
    groups = found.select(group.alias("canonical_group")).distinct()
    return entities.withColumn("canonical_group", group).join(groups, "canonical_group", "left_semi").select("node").distinct()


def frontier_edges(edges: DataFrame, seeds: DataFrame, most: int = EDGE_CAP) -> DataFrame:
    """The edges (id, src, dst, ...) around the seeds, nearest first and by id within a distance, ``most`` at the most.

    A round takes the edges of the nodes that the last one reached.  Nodes of a round are
    no more than twice the bound, so that they go to every task; edges stay where they are.
    """
    held, expanded, n = None, G.cut(seeds.select("node").distinct()), 0
    frontier = expanded
    while n < most:
        ends = [edges.join(F.broadcast(frontier.withColumnRenamed("node", c)), c, "left_semi") for c in ("src", "dst")]
        new = ends[0].unionByName(ends[1]).dropDuplicates(["id"])
        if held is not None:
            new = new.join(F.broadcast(held.select("id")), "id", "left_anti").select(*edges.columns)
        new = G.cut(new.orderBy("id").limit(most - n))
        count = new.count()
        if not count:
            break
        held, n = new if held is None else held.unionByName(new), n + count
        if n >= most:
            break
        frontier = G.cut(new.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(F.broadcast(expanded), "node", "left_anti"))
        expanded = expanded.unionByName(frontier)
        if frontier.isEmpty():
            break
    return edges.filter("false") if held is None else held


def joint_walk_arm(edges: DataFrame, incidence: DataFrame, links: DataFrame, recent: DataFrame, seeds: DataFrame, k: int, multipliers: dict[str, float] | None = None) -> DataFrame:
    """The k memories (id, score) that a walk with restart from the seeds visits most.

    The walk goes over entities, memories and links together: entity edges (id, src, dst,
    weight, layer) around the seeds, incidences (id, node, confidence) of the entities
    reached, and links (a, b, layer) among the memories reached, those next to them by a
    link, and the newest ones (recent: id, at).  An edge or link counts as much more as
    its layer's multiplier says; incidences do not.  Weights that are no positive finite
    number are absent.  Bounds and their orders are fixed, so that the same graph always
    gives the same walk, over at most EDGE_CAP + INCIDENCE_CAP + LINK_CAP edges; without a
    seed there is no row.  edges and links are read several times: give them as tables.
    """
    of = F.lit(1.0)
    for layer, value in (multipliers or {}).items():
        of = F.when(F.col("layer") == layer, F.lit(float(value))).otherwise(of)
    seeds = G.cut(seeds.select("node").distinct())
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    near = G.cut(frontier_edges(edges.filter(good("weight")), seeds))
    reached = seeds.unionByName(near.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    held = G.cut(incidence.filter(good("confidence")).join(F.broadcast(reached), "node", "left_semi").select("id", "node", "confidence").orderBy(F.desc("confidence"), "id", "node").limit(INCIDENCE_CAP))
    mine = held.select("id").distinct()
    touching = [links.join(F.broadcast(mine.withColumnRenamed("id", c)), c, "left_semi") for c in ("a", "b")]
    touching = touching[0].unionByName(touching[1]).select("a", "b").distinct().orderBy("a", "b").limit(LINK_CAP)
    newest = recent.orderBy(F.desc("at"), F.desc("id")).limit(MEMORY_CAP).select("id")
    universe = G.cut(mine.unionByName(touching.select(F.explode(F.array("a", "b")).alias("id"))).unionByName(newest).distinct())
    among = links.join(F.broadcast(universe.withColumnRenamed("id", "a")), "a", "left_semi").join(F.broadcast(universe.withColumnRenamed("id", "b")), "b", "left_semi")
    among = among.select("a", "b", "layer").orderBy("a", "b", "layer").limit(LINK_CAP)
    entity, memory = (lambda c: F.concat(F.lit("ent::"), F.col(c))), (lambda c: F.concat(F.lit("mem::"), F.col(c).cast("string")))
    graph = near.select(entity("src").alias("src"), entity("dst").alias("dst"), (F.col("weight") * of).alias("weight"))
    graph = graph.unionByName(held.groupBy("id", "node").agg(F.max("confidence").alias("weight")).select(memory("id").alias("src"), entity("node").alias("dst"), "weight"))
    graph = graph.unionByName(among.select(memory("a").alias("src"), memory("b").alias("dst"), of.alias("weight")))
    one = F.lit(0).alias("query")
    ranks = G.bounded_walks(graph.select(one, "*"), seeds.select(one, entity("node").alias("node"))).filter(F.col("node").startswith("mem::"))
    kind = incidence.schema["id"].dataType
    return ranks.select(F.substring("node", 6, 1 << 20).cast(kind).alias("id"), F.col("rank").alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)
