"""Graph and code arms over orders as memories, suppliers and brands as entities, and parts as symbols."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.model import LAYERS, table
from tessella.operators import arms as A
from tessella.operators import graph as G
from tessella.plans.base import ORACLE_SQL, query
from tessella.plans.graphs import EDGE_SQL, edges
from tessella.sources import code_export as X

_INC = "inc AS (SELECT l_orderkey AS id, 'supplier_' || l_suppkey::VARCHAR AS node, max(0.3::DOUBLE + l_discount::DOUBLE * 5) AS confidence FROM lineitem GROUP BY ALL)"


def incidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("id"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("node")).agg(F.max(0.3 + F.col("l_discount").cast("double") * 5).alias("confidence"))


def _seeds(spark, *names):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("node"))


@query(f"WITH {EDGE_SQL}, {_INC}, rc AS (SELECT dst AS node FROM un WHERE src = 'Brand#11' UNION SELECT 'Brand#11') SELECT id, round(sum(confidence), 6) AS score FROM inc WHERE node IN (SELECT node FROM rc) GROUP BY id ORDER BY round(sum(confidence), 9) DESC, id LIMIT 50")
def graph_arm_1hop(spark, sf_dir):
    """The 50 orders with the most confidence of suppliers next to a brand."""
    return A.one_hop_arm(edges(spark, sf_dir), _seeds(spark, "Brand#11"), incidence(spark, sf_dir), 50).withColumn("score", F.round("score", 6))


#: A question that names an entity and symbols; the layer of its intent counts more, others less.
QUESTION = "which Brand#11 small ring has the licensed version of worthless things"
MULTIPLIERS = {"causal": 4.0, "semantic": 0.25}
_MULT = "CASE layer " + " ".join(f"WHEN '{n}' THEN {v}::DOUBLE" for n, v in MULTIPLIERS.items()) + " ELSE 1.0::DOUBLE END"
_LAYER = "['temporal', 'entity', 'causal', 'semantic'][({0} % 4 + 1)::INT]"


def layer(n):
    return F.element_at(F.array(*map(F.lit, LAYERS)), (n % 4 + 1).cast("int"))


def relations(spark, sf_dir):
    """Brands and suppliers as entities, each edge in a layer."""
    n = F.substring("dst", 10, 20).cast("long")
    return edges(spark, sf_dir).select(F.concat_ws("|", "src", "dst").alias("id"), "src", "dst", "weight", layer(n).alias("layer"))


def follow_ups(spark, sf_dir):
    """Links from an order to the customer's next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"))
    return o.filter("b is not null").select("a", "b", layer(F.col("a")).alias("layer"))


def entities(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("node"), F.col("p_brand").alias("name")).distinct()


def walk_sql(universe: str, k: int) -> str:
    """CTEs of the joint walk over the memories of ``universe`` (id, tm); the last, gw, has id and score."""
    rounds = ["f0 AS (SELECT * FROM rel WHERE false)"]
    for i in range(1, 6):
        had = " UNION ALL ".join(f"SELECT * FROM f{j}" for j in range(i))
        rounds.append(f"n{i} AS (SELECT node FROM sd UNION SELECT src FROM ({had}) UNION SELECT dst FROM ({had})), f{i} AS MATERIALIZED (SELECT * FROM rel WHERE (src IN (SELECT node FROM n{i}) OR dst IN (SELECT node FROM n{i})) AND id NOT IN (SELECT id FROM ({had})) ORDER BY id LIMIT (SELECT greatest(0, {A.EDGE_CAP} - count(*)) FROM ({had})))")
    near = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(1, 6))
    ranks = ["k0 AS (SELECT 'ent::' || node AS node, 1.0::DOUBLE / (SELECT count(*) FROM sd) AS rank FROM sd)"]
    for i in range(1, 31):
        ranks.append(f"k{i} AS MATERIALIZED (SELECT node, sum(rank) AS rank FROM (SELECT dst AS node, 0.85::DOUBLE * rank * share AS rank FROM k{i - 1} JOIN gs ON node = src UNION ALL SELECT node, 0.15::DOUBLE * rank FROM k0) GROUP BY node)")
    return f"""{EDGE_SQL}, {_INC}, rel AS (SELECT src || '|' || dst AS id, src, dst, weight, {_LAYER.format('substr(dst, 10)::BIGINT')} AS layer FROM ed),
sd AS (SELECT DISTINCT p_brand AS node FROM part WHERE regexp_matches('{QUESTION.lower()}', '(^|[^a-z0-9_])' || lower(p_brand) || '([^a-z0-9_]|$)')), {', '.join(rounds)},
nr AS MATERIALIZED ({near}), rc AS (SELECT node FROM sd UNION SELECT src FROM nr UNION SELECT dst FROM nr), un_ AS ({universe}),
hi AS MATERIALIZED (SELECT * FROM inc WHERE node IN (SELECT node FROM rc) AND id IN (SELECT id FROM un_) ORDER BY confidence DESC, id, node LIMIT {A.INCIDENCE_CAP}),
fo AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
lk AS MATERIALIZED (SELECT a, b, {_LAYER.format('a')} AS layer FROM fo WHERE b IS NOT NULL AND a IN (SELECT id FROM un_) AND b IN (SELECT id FROM un_)),
tl AS (SELECT DISTINCT a, b FROM lk WHERE a IN (SELECT id FROM hi) OR b IN (SELECT id FROM hi) ORDER BY a, b LIMIT {A.LINK_CAP}),
nw AS (SELECT id FROM un_ ORDER BY tm DESC, id DESC LIMIT {A.MEMORY_CAP}), uv AS (SELECT id FROM hi UNION SELECT a FROM tl UNION SELECT b FROM tl UNION SELECT id FROM nw),
al AS (SELECT * FROM lk WHERE a IN (SELECT id FROM uv) AND b IN (SELECT id FROM uv) ORDER BY a, b, layer LIMIT {A.LINK_CAP}),
gr AS (SELECT 'ent::' || src AS src, 'ent::' || dst AS dst, weight * {_MULT} AS weight FROM nr UNION ALL SELECT 'mem::' || id::VARCHAR, 'ent::' || node, max(confidence) FROM hi GROUP BY id, node UNION ALL SELECT 'mem::' || a::VARCHAR, 'mem::' || b::VARCHAR, {_MULT} FROM al),
gu AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM gr UNION ALL SELECT dst, src, weight FROM gr) GROUP BY ALL), gs AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM gu), {', '.join(ranks)},
gw AS (SELECT substr(node, 6)::BIGINT AS id, rank AS score FROM k30 WHERE node LIKE 'mem::%' AND rank > 0 ORDER BY round(rank, 12) DESC, id LIMIT {k})"""


@query(f"WITH {walk_sql('SELECT o_orderkey AS id, o_orderdate AS tm FROM orders', 50)} SELECT id, round(score, 9) AS score FROM gw")
def graph_arm_ppr(spark, sf_dir):
    """The 50 orders that a walk from the brand of a question visits most, over suppliers, orders, and a customer's orders one after the other."""
    recent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    inc = incidence(spark, sf_dir).join(recent.select("id"), "id", "left_semi")
    arm = A.joint_walk_arm(G.cut(relations(spark, sf_dir)), inc, G.cut(follow_ups(spark, sf_dir)), recent, A.seeds_in(entities(spark, sf_dir), QUESTION), 50, MULTIPLIERS)
    return arm.withColumn("score", F.round("score", 9))


_CALLS = "calls AS (SELECT DISTINCT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem QUALIFY dst IS NOT NULL)"


def calls(spark, sf_dir):
    """Part to the next part of the same order, as calls between symbols."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).filter("dst is not null").distinct()


def code_sql(universe: str, k: int) -> str:
    """CTEs of the code arm over the memories of ``universe`` (id); the last, cw, has id and score."""
    words = [w.lower() for w in A.identifiers_in(QUESTION)]
    per = max(2, min(12, k // len(words)))
    found = " UNION ALL ".join(f"SELECT symbol, CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END / n AS strength FROM (SELECT symbol, lower(name) = '{w}' OR lower(fqname) = '{w}' AS exact, row_number() OVER (ORDER BY name, symbol) AS n FROM sy WHERE contains(lower(name), '{w}') OR contains(lower(fqname), '{w}')) WHERE n <= {per}" for w in words)
    return f"""{_CALLS}, sy AS (SELECT p_partkey AS symbol, p_name AS name, p_brand || '.' || p_name AS fqname FROM part), ow AS MATERIALIZED (SELECT symbol, max(strength) AS strength FROM ({found}) GROUP BY symbol),
ne AS MATERIALIZED (SELECT src, dst FROM calls WHERE src IN (SELECT symbol FROM ow) OR dst IN (SELECT symbol FROM ow) ORDER BY src, dst LIMIT {max(100, min(2000, 20 * k))}),
st AS (SELECT symbol, max(strength) AS strength FROM (SELECT * FROM ow UNION ALL SELECT dst, strength * 0.55::DOUBLE FROM ne JOIN ow ON src = symbol UNION ALL SELECT src, strength * 0.55::DOUBLE FROM ne JOIN ow ON dst = symbol) GROUP BY symbol ORDER BY strength DESC, symbol LIMIT {max(10, min(100, 2 * k))}),
ln AS (SELECT l_partkey AS symbol, l_orderkey AS id, least(1.0::DOUBLE, max(0.3::DOUBLE + l_discount::DOUBLE * 5)) AS confidence FROM lineitem WHERE l_orderkey IN (SELECT id FROM ({universe})) GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, id) AS place FROM ln JOIN st USING (symbol)),
cw AS (SELECT id, max(strength * confidence / place) AS score FROM pl WHERE place <= {max(2, min(10, k))} GROUP BY id ORDER BY round(max(strength * confidence / place), 9) DESC, id LIMIT {k})"""


def symbols(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("fqname"))


def symbol_links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("id")).agg(F.max(0.3 + F.col("l_discount").cast("double") * 5).alias("confidence"))


@query(f"WITH {code_sql('SELECT l_orderkey AS id FROM lineitem', 50)} SELECT id, round(score, 6) AS score FROM cw")
def code_arm(spark, sf_dir):
    """The 50 orders that the parts named in a question, and the parts called next to them, lead to."""
    return A.code_arm(symbols(spark, sf_dir), G.cut(calls(spark, sf_dir)), symbol_links(spark, sf_dir), QUESTION, 50).withColumn("score", F.round("score", 6))


@query(f"WITH {_CALLS}, hot AS (SELECT p_partkey, p_type FROM part WHERE p_size = 1) SELECT h.p_partkey AS symbol, f.p_type AS file, count(DISTINCT c.src) AS callers FROM hot h JOIN calls c ON c.dst = h.p_partkey JOIN part f ON f.p_partkey = c.src WHERE f.p_type <> h.p_type GROUP BY ALL")
def impact_dependents(spark, sf_dir):
    """Which other files call a changed symbol: inbound edges, then the files (types) that they come from."""
    p = table(spark, sf_dir, "part")
    hot = p.filter("p_size = 1").select(F.col("p_partkey").alias("dst"), F.col("p_type").alias("own"))
    of = p.select(F.col("p_partkey").alias("src"), F.col("p_type").alias("file"))
    c = calls(spark, sf_dir).join(hot, "dst").join(of, "src").filter("file <> own")
    return c.groupBy(F.col("dst").alias("symbol"), "file").agg(F.countDistinct("src").alias("callers"))


@query(f"WITH {_CALLS}, x AS (SELECT a.p_partkey AS src, b.p_partkey AS dst, a.p_type <> b.p_type AS crosses FROM calls c JOIN part a ON a.p_partkey = c.src JOIN part b ON b.p_partkey = c.dst), d AS (SELECT src AS symbol, 1 AS o, 0 AS i, crosses::INT AS x FROM x UNION ALL SELECT dst, 0, 1, crosses::INT FROM x) SELECT symbol, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, sum(x)::BIGINT AS crossing FROM d GROUP BY symbol ORDER BY fan_in + fan_out DESC, symbol LIMIT 20")
def code_hotspots(spark, sf_dir):
    """The 20 symbols with the most calls in and out, and how many of them cross files."""
    of = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    c = calls(spark, sf_dir).join(of.select(F.col("p_partkey").alias("src"), F.col("p_type").alias("a")), "src").join(of.select(F.col("p_partkey").alias("dst"), F.col("p_type").alias("b")), "dst")
    ends = c.select(F.inline(F.array(*[F.struct(F.col(s).alias("symbol"), F.lit(i).alias("i"), F.lit(o).alias("o"), (F.col("a") != F.col("b")).cast("int").alias("x")) for s, i, o in (("src", 0, 1), ("dst", 1, 0))])))
    d = ends.groupBy("symbol").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("x").alias("crossing"))
    return d.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "symbol").limit(20)


@query(
    f"""WITH {_CALLS}, sy AS (SELECT p_partkey AS symbol, p_name AS name, p_brand || '.' || p_name AS fqname, p_type AS file FROM part), o AS (SELECT src AS symbol, count(*) AS calls FROM calls GROUP BY 1), i AS (SELECT dst AS symbol, count(*) AS callers FROM calls GROUP BY 1)
SELECT 'node' AS kind, symbol::VARCHAR AS key, to_json({{'symbol': symbol, 'name': name, 'fqname': fqname, 'file': file, 'calls': coalesce(calls, 0), 'callers': coalesce(callers, 0)}})::VARCHAR AS body FROM sy LEFT JOIN o USING (symbol) LEFT JOIN i USING (symbol)
UNION ALL SELECT 'file', file, to_json({{'file': file, 'symbols': list(symbol ORDER BY symbol)}})::VARCHAR FROM sy GROUP BY file UNION ALL SELECT 'edge', src::VARCHAR || '|' || dst::VARCHAR, to_json({{'src': src, 'dst': dst}})::VARCHAR FROM calls
UNION ALL SELECT 'memory_link', l_partkey::VARCHAR || '|' || l_orderkey::VARCHAR, to_json({{'symbol': l_partkey, 'id': l_orderkey, 'confidence': count(*)}})::VARCHAR FROM lineitem GROUP BY l_partkey, l_orderkey"""
)
def code_export(spark, sf_dir):
    """The code graph as JSON lines: files with their symbols, symbols with their calls, edges, and links to orders."""
    sy = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("fqname"), F.col("p_type").alias("file"))
    links = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("confidence"))
    return X.lines(sy, G.cut(calls(spark, sf_dir)), links)


# Nodes of the scene: weighted degree, rank, support and spread of every brand and supplier.
_NODES = f"""{EDGE_SQL}, rk AS ({ORACLE_SQL['global_pagerank']}), ln AS (SELECT p_brand AS b, 'supplier_' || l_suppkey::VARCHAR AS s, l_orderkey, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey),
ev AS (SELECT node, count(DISTINCT l_orderkey) AS support, count(DISTINCT l_linestatus) AS repos FROM (SELECT b AS node, l_orderkey, l_linestatus FROM ln UNION ALL SELECT s, l_orderkey, l_linestatus FROM ln) GROUP BY node),
dg AS (SELECT src AS node, sum(weight) AS degree FROM un GROUP BY src), nd0 AS (SELECT * FROM dg JOIN rk USING (node) JOIN ev USING (node)),
q AS (SELECT quantile_cont(degree, 0.95) AS a, quantile_cont(rank, 0.95) AS b, quantile_cont(support::DOUBLE, 0.95) AS c, quantile_cont(repos::DOUBLE, 0.95) AS d FROM nd0),
ms AS (SELECT node, 0.45::DOUBLE * (1 - exp(-ln(1 + degree) / ln(1 + a))) + 0.30::DOUBLE * (1 - exp(-ln(1 + rank) / ln(1 + b))) + 0.15::DOUBLE * (1 - exp(-ln(1 + support) / ln(1 + c))) + 0.10::DOUBLE * (1 - exp(-ln(1 + repos) / ln(1 + d))) AS mass FROM nd0, q)"""


def masses(spark, sf_dir, e=None):
    """node, mass: evidence of degree, rank, support and spread, each softly saturated at its 95th percentile; of the edges e, if they are there already."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    ends = li.select(F.inline(F.array(*[F.struct(n.alias("node"), "l_orderkey", "l_linestatus") for n in (F.col("p_brand"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")))])))
    ev = ends.groupBy("node").agg(F.countDistinct("l_orderkey").alias("support"), F.countDistinct("l_linestatus").alias("repos"))
    e = e or G.cut(edges(spark, sf_dir))
    degree = G.undirected(e).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
    rank = G.pagerank(e, rounds=32).withColumn("rank", F.round("rank", 9))
    n = G.cut(degree.join(rank, "node").join(ev, "node"))
    parts = (("degree", 0.45), ("rank", 0.30), ("support", 0.15), ("repos", 0.10))
    return G.soft_mass(n, parts)


@query(f"WITH {_NODES} SELECT node, round(mass, 6) AS mass, round(1 + 15 * mass * mass, 6) AS gravity, round(1.5::DOUBLE + 2 * pow(1 + 15 * mass * mass, 2.0::DOUBLE / 3), 6) AS radius FROM ms")
def node_mass(spark, sf_dir):
    gravity = 1 + 15 * F.col("mass") * F.col("mass")
    return masses(spark, sf_dir).select("node", F.round("mass", 6).alias("mass"), F.round(gravity, 6).alias("gravity"), F.round(1.5 + 2 * F.pow(gravity, F.lit(2.0 / 3)), 6).alias("radius"))


# Nodes and edges that a level of a scene shows.
LEVELS = (("overview", 80, 80), ("system", 150, 400), ("neighborhood", 100, 250), ("path", 100, 250))
_LV = "lv AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in LEVELS) + ") t(level, nodes, edges))"


@query(f"WITH {_NODES}, {_LV}, rn AS (SELECT node, row_number() OVER (ORDER BY round(mass, 9) DESC, node) AS n FROM ms), sn AS (SELECT level, node, n, edges FROM rn JOIN lv ON n <= nodes), se AS (SELECT a.level, ed.src, ed.dst, a.edges, row_number() OVER (PARTITION BY a.level ORDER BY ed.weight DESC, ed.src, ed.dst) AS n FROM ed JOIN sn a ON a.node = ed.src JOIN sn b ON b.node = ed.dst AND b.level = a.level) SELECT level, 'node' AS kind, node AS id, n::INTEGER AS position FROM sn UNION ALL SELECT level, 'edge', src || '|' || dst, n::INTEGER FROM se WHERE n <= edges")
def scene_selection(spark, sf_dir):
    """The heaviest nodes of each level and the strongest edges among them; only the nodes that a level can show are ranked."""
    e = G.cut(edges(spark, sf_dir))
    top = masses(spark, sf_dir, e).orderBy(F.desc(F.round("mass", 9)), "node").limit(max(n for _, n, _ in LEVELS))
    ranked = top.withColumn("n", F.row_number().over(Window.orderBy(F.desc(F.round("mass", 9)), "node")))  # at most 150 rows
    levels = F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("nodes"), F.lit(c).alias("edges")) for a, b, c in LEVELS])
    sn = G.cut(ranked.select("node", "n", F.inline(levels)).filter("n <= nodes"))
    a = F.broadcast(sn.select(F.col("node").alias("src"), "level", "edges"))
    b = F.broadcast(sn.select(F.col("node").alias("dst"), "level"))
    se = e.join(a, "src").join(b, ["dst", "level"]).withColumn("n", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("weight"), "src", "dst"))).filter("n <= edges")
    nodes = sn.select("level", F.lit("node").alias("kind"), F.col("node").alias("id"), F.col("n").alias("position"))
    return nodes.unionByName(se.select("level", F.lit("edge").alias("kind"), F.concat_ws("|", "src", "dst").alias("id"), F.col("n").alias("position")))


_COM = "CASE WHEN {0} LIKE 'Brand#%' THEN substr({0}, 7, 1) ELSE (substr({0}, 10)::INT % 5 + 1)::VARCHAR END"


@query(f"WITH {_NODES}, cn AS (SELECT node, mass, {_COM.format('node')} AS community FROM ms), ce AS (SELECT weight, {_COM.format('src')} AS a, {_COM.format('dst')} AS b FROM ed), ie AS (SELECT a AS community, sum(weight) AS internal FROM ce WHERE a = b GROUP BY a), xe AS (SELECT community, sum(weight) AS external FROM (SELECT a AS community, weight FROM ce WHERE a <> b UNION ALL SELECT b, weight FROM ce WHERE a <> b) GROUP BY 1), g AS (SELECT community, count(*) AS members, round(sum(1 + 15 * mass * mass), 4) AS mass, max_by(node, (round(mass, 9), node)) AS anchor FROM cn GROUP BY community) SELECT g.*, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external FROM g LEFT JOIN ie USING (community) LEFT JOIN xe USING (community)")
def community_summaries(spark, sf_dir):
    """Members, mass, anchor, and the strength within and across, of every community (given by brand and supplier numbers)."""
    of = lambda c: F.when(F.col(c).startswith("Brand#"), F.substring(c, 7, 1)).otherwise((F.substring(c, 10, 20).cast("int") % 5 + 1).cast("string"))
    links = G.cut(edges(spark, sf_dir))
    n = masses(spark, sf_dir, links).withColumn("community", of("node"))
    g = n.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum(1 + 15 * F.col("mass") * F.col("mass")), 4).alias("mass"), F.max_by("node", F.struct(F.round("mass", 9), "node")).alias("anchor"))
    e = links.select(of("src").alias("a"), of("dst").alias("b"), "weight")
    ends = e.select("weight", (F.col("a") == F.col("b")).alias("inside"), F.explode(F.array_distinct(F.array("a", "b"))).alias("community"))
    s = ends.groupBy("community").agg(F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("internal"), F.sum(F.when(F.col("inside"), 0.0).otherwise(F.col("weight"))).alias("external"))
    return g.join(s, "community", "left").select("community", "members", "mass", "anchor", F.coalesce("internal", F.lit(0.0)).alias("internal"), F.coalesce("external", F.lit(0.0)).alias("external"))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type AS label, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, lower(p_type), p_type) = 1")
def canonical_label(spark, sf_dir):
    """The commonest type of every brand; ties go to the first in case-folded order."""
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("less"), F.lower("p_type").alias("low"), F.col("p_type").alias("label"))).alias("m")).select("p_brand", "m.label", (-F.col("m.less")).alias("n"))
