"""Hand-computed cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scoring as S
from tessella.functions import text as T
from tessella.model import DAY, NOW
from tessella.operators import blocks, graph, maintain, metrics, receipts, retrieval, sync
from tessella.operators.temporal import SearchFilter, visible
from tessella.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_estimates(spark):
    assert sorted(one(spark, T.tokens(F.lit("The Cat, a cat! x über 12")))) == ["12", "cat", "über"]
    assert one(spark, T.estimate_tokens(F.lit("ab  cd\n"))) == 1
    assert one(spark, T.estimate_tokens(F.lit("a" * 10))) == 2  # half to even
    assert one(spark, T.estimate_tokens(F.lit("  "))) == 0
    assert one(spark, T.search_terms(F.lit("policies nations"))) == ["policies", "policy", "nations", "nat"]
    assert one(spark, T.lexical_support(F.array(F.lit("bake"), F.lit("bread")), F.array(F.lit("bread")))) == 0.0
    assert one(spark, T.claim_text(F.lit("Uses v1.2, now."))) == "uses v1.2 now"


def test_scores(spark):
    assert one(spark, S.retention(F.lit(NOW - 2 * DAY), F.lit(2.0))) == pytest.approx(math.exp(-1))
    assert one(spark, S.retention(F.lit(None).cast("double"), F.lit(2.0))) == 1.0
    assert one(spark, S.clean_stability(F.lit(float("nan")))) == 1.0
    assert one(spark, S.staleness(F.lit(NOW + 3.5 * DAY), F.lit(None).cast("double"))) == pytest.approx(0.5)
    assert one(spark, S.staleness(F.lit(NOW - 1.0), F.lit(NOW + 5.0))) == 0.0
    assert one(spark, S.reinforced(F.lit(1.0), F.lit(0), F.lit(0.05))) == pytest.approx(1 + 1.05 * math.log(2))


def test_visibility_is_half_open_and_bitemporal(spark):
    rows = [("a", 0.0, 10.0, 20.0, 0.0, None), ("b", 10.0, None, None, 10.0, None), ("c", 0.0, None, None, 0.0, 15.0)]
    df = spark.createDataFrame(rows, "id string, valid_from double, valid_to double, valid_to_recorded_at double, ingested_at double, expired_at double")
    ids = lambda v, k: sorted(r["id"] for r in df.filter(visible(v, k)).collect())
    assert ids(10.0, 14.0) == ["a", "b", "c"]  # the end of a is not yet recorded
    assert ids(10.0, 20.0) == ["b"]
    assert ids(9.0, 9.0) == ["a", "c"]


def test_filter_rules(spark):
    with pytest.raises(ValueError):
        SearchFilter(valid_at=1.0, as_of=2.0)
    df = spark.createDataFrame([("session", "r1"), ("repo", "r1"), ("repo", "r2"), ("user", "r3")], "scope string, repo_id string").withColumns({"workspace_id": F.lit("w"), "mtype": F.lit("working")})
    keep = lambda **k: df.filter(SearchFilter(workspace_id="w", include_invalid=True, **k).predicate()).count()
    assert keep(repo_id="r1") == 2 and keep() == 3 and keep(mtypes=()) == 0 and keep(repo_id="r1", include_ancestors=False) == 2


def test_rrf_ties_and_flat_scores(spark):
    arms = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("b", "y", 3.0)], "id string, arm string, score double")
    got = {r["id"]: r["rrf"] for r in retrieval.rrf(arms).collect()}
    assert got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(1 / 62 + 1 / 61)
    assert {r["norm"] for r in retrieval.normalised(arms.filter("arm = 'x'"), "score", "arm").collect()} == {1.0}


def test_batch_search_equals_single(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    q = e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    batch = retrieval.batch_knn(e, q, 5).filter("query_id = 100").orderBy("position").collect()
    v = [float(x) for x in e.filter("vec_id = 100").first()["embedding"]]
    single = [r["vec_id"] for r in retrieval.knn(e, v, 6).collect() if r["vec_id"] != 100]
    assert [r["vec_id"] for r in batch] == single[:5]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_graph(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("d", "e", 2.0), ("x", "y", float("nan"))])
    assert {r["node"]: r["component"] for r in graph.components(e.filter("src <> 'x'")).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks["d"] == 0.0 and ranks["b"] > ranks["c"]
    far = {r["node"]: r["rank"] for r in graph.pagerank(e, spark.createDataFrame([("a",), ("alone",)], "node string")).collect()}
    assert sum(far.values()) == pytest.approx(1) and far["alone"] == pytest.approx(0.075 / 0.575)  # half of what is given out, and half of what dangles, which goes back to the seeds
    assert graph.pagerank(e, spark.createDataFrame([], "node string")).count() == 0
    with pytest.raises(RuntimeError, match="settle"):
        graph.components(edges(spark, [(str(k), str(k + 1), 1.0) for k in range(60)]), most=2)
    path = {r["node"]: r["cost"] for r in graph.strongest_path(edges(spark, [("a", "b", 0.5), ("b", "c", 0.5), ("a", "c", 0.1)]), "a").collect()}
    assert path["c"] == pytest.approx(-math.log(0.25))
    assert {r["node"]: r["depth"] for r in graph.bfs(e, "a").collect()} == {"a": 0, "b": 1, "c": 2}
    two = edges(spark, [(a, b, 1.0) for g in ("abc", "def") for a in g for b in g if a < b] + [("c", "d", 0.1)])
    of = {r["node"]: r["community"] for r in graph.communities(two).collect()}
    assert of["a"] == of["b"] == of["c"] != of["d"] == of["e"] == of["f"]


def test_merge_is_order_free(spark):
    schema = "id long, title string, content string, importance long, hlc string, ingested_at double, valid_to double, valid_to_recorded_at double, expired_at double, stability double, access_count long, last_access double, pinned_at double, unpinned_at double"
    a = spark.createDataFrame([(1, "a", "x", 1, "001", 1.0, 9.0, 12.0, None, 1.0, 2, 5.0, 1.0, None)], schema)
    b = spark.createDataFrame([(1, "b", "y", 2, "002", 0.0, 9.0, None, 7.0, 2.0, 1, 6.0, None, 3.0)], schema)
    ab, ba, again = (sync.merge(*x).collect() for x in ((a, b), (b, a), (a, b, a, b)))
    assert ab == ba == again
    r = ab[0]
    assert (r["title"], r["valid_to"], r["valid_to_recorded_at"], r["expired_at"], r["stability"], r["pinned"]) == ("b", 9.0, None, 7.0, 2.0, False)


def test_receipts(spark):
    df = spark.createDataFrame([("a", i, f"p{i}") for i in range(8)] + [("b", 0, "x"), (None, 3, "n")], "k string, i int, p string")
    make = lambda rows: receipts.chain(rows, ["k"], ["i"], receipts.payload_hash(F.col("p")))
    c = make(df).cache()
    assert {r["k"]: r[1:] for r in receipts.verify(c, ["k"]).collect()} == {"a": (8, 0, 0), "b": (1, 0, 0), None: (1, 0, 0)}
    own = [hashlib.sha256(f"p{i}".encode()).hexdigest() for i in range(8)]
    head = None
    for i in range(8):  # the chain again, in plain Python
        head = hashlib.sha256(f"{head or 'genesis'}\x1f{own[i]}\x1f{i + 1}".encode()).hexdigest()
    assert c.filter("k = 'a' and sequence = 8").first()["receipt_hash"] == head
    # Forged contents under an old hash break their link; made anew, they change every hash after them and the head.
    forged = c.withColumn("p", F.when((F.col("k") == "a") & (F.col("i") == 2), "forged").otherwise(F.col("p")))
    assert receipts.links(forged, ["k"], receipts.payload_hash(F.col("p"))).filter("broken").select("i").collect() == [(2,)]
    anew = make(forged.select("k", "i", "p")).cache()
    assert c.join(anew.select(F.col("k").alias("k2"), F.col("i").alias("i2"), F.col("receipt_hash").alias("h2")), F.expr("k = k2 and i = i2 and receipt_hash = h2")).filter("k = 'a'").count() == 2
    anchors = receipts.heads(c, ["k"]).filter("k is not null")
    status = lambda rows: {r["k"]: r["status"] for r in receipts.check_anchors(rows, anchors, ["k"]).filter("k is not null").collect()}
    assert status(c) == {"a": "ok", "b": "ok"} and status(anew) == {"a": "forked", "b": "ok"}
    assert status(c.filter("k = 'a' and i < 6")) == {"a": "truncated", "b": "missing"}
    more = make(df.unionByName(spark.createDataFrame([("a", 9, "more"), ("c", 0, "new")], df.schema)))
    assert status(more) == {"a": "extended", "b": "ok", "c": "unanchored"}
    assert receipts.verify(c.filter("i <> 4"), ["k"]).filter("k = 'a'").first()[1:] == (7, 1, 1) and make(df.filter("false")).count() == 0


def test_resolution(spark):
    rows = [("n1", "o1", 0.9, 1.0, False, False, 1), ("n2", "o1", 0.6, 1.0, False, False, 1), ("n2", "o2", 0.58, 1.0, False, False, 2), ("n3", "o1", 0.1, 1.0, True, True, 1), ("n4", "o1", 0.2, 1.0, False, False, 1)]
    df = spark.createDataFrame(rows, "new_id string, old_id string, overlap double, sim double, same_key boolean, same_text boolean, old_from long").withColumns({"keyed": F.col("same_key"), "same_words": F.col("same_text")})
    assert {r["new_id"]: r["op"] for r in maintain.decide(df).collect()} == {"n1": "NOOP", "n2": "RELATE", "n3": "NOOP", "n4": "ADD"}


def test_import_diff(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "5")], "key string, hash string")
    assert {r["key"]: r["state"] for r in maintain.import_diff(a, b).collect()} == {"a": "unchanged", "b": "changed", "c": "missing", "d": "renamed", "e": "new"}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, id string, position int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z")], "query_id string, id string")
    r = metrics.at_k(ranked, gold, 3).first()
    assert r["recall"] == 0.5 and r["hit"] == 1 and r["mrr"] == 0.5
    assert r["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_ranks_of_many_nodes_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    e = edges(spark, [(f"n{a}", f"n{b}", float(w)) for a, b, w in rng.integers(1, 40, (150, 3))])
    seeds = spark.createDataFrame([("n1",), ("n2",)], "node string")
    few = {r["node"]: r["rank"] for r in graph.pagerank(e, seeds, rounds=7).collect()}
    monkeypatch.setattr(graph, "MANY_NODES", 0)
    many = {r["node"]: r["rank"] for r in graph.pagerank(e, seeds, rounds=7).collect()}
    assert many == pytest.approx(few) and sum(few.values()) == pytest.approx(1)
    one = graph.bounded_walks(e.selectExpr("'q' as query", "*"), seeds.selectExpr("'q' as query", "node"), rounds=7)
    assert {r["node"]: r["rank"] for r in one.collect()} == pytest.approx({k: v for k, v in few.items() if v > 0})


def test_blocks():
    text = "# One\nPara a\ngoes on.\n\n- x\n  more\n- y\n| a | b |\n|---|---|\n## Two ##\n```py\n# no heading\n\n```\nend\n~~~\nopen"
    got = [(b.kind, b.path, text[b.first : b.last]) for b in blocks.blocks(text)]
    assert got == [
        ("heading", "One", "# One"), ("prose", "One", "Para a\ngoes on."), ("list", "One", "- x\n  more\n- y"), ("table", "One", "| a | b |\n|---|---|"), ("heading", "One > Two", "## Two ##"),
        ("code", "One > Two", "```py\n# no heading\n\n```"), ("prose", "One > Two", "end"), ("code", "One > Two", "~~~\nopen"),
    ]
    assert list(blocks.blocks("")) == list(blocks.blocks(" \n\n")) == []


def test_chunks_hold_the_text_within_their_size():
    rng = np.random.default_rng(2)
    parts = ["# Head\n", "## Sub\n", "A sentence of some words. ", "Another one! ", "x" * 90 + " ", "\n\n", "- item\n", "| c | d |\n", "```\ncode here\n```\n", "word " * 30, "\u65e5\u672c ", "\t\n"]
    for _ in range(200):
        text = "".join(rng.choice(parts, rng.integers(1, 40)))
        for target, overlap in ((8, 0), (20, 10), (256, 32)):
            covered, last = np.zeros(len(text), bool), -1
            for c in blocks.chunks(text, target, overlap):
                assert c.kind == "code" or blocks.quarter(text[c.first : c.last]) <= target
                assert c.first < c.last and c.last > last and text[c.first : c.last].strip() == text[c.first : c.last]
                covered[c.first : c.last], last = True, c.last
            assert all(covered[k] or x.isspace() for k, x in enumerate(text))


def test_chunks_overlap_and_fences():
    text = "One is here. Two is here. Three is here. Four is here."
    got = [text[c.first : c.last] for c in blocks.chunks(text, 8, 4)]
    assert got == ["One is here. Two is here.", "Two is here. Three is here.", "Three is here. Four is here."] or got[1].startswith("Two is here.")
    code = "```py\n" + "line of code\n" * 50 + "```"
    pieces = list(blocks.chunks(code, 8, 0, most_code=200))
    assert len(pieces) > 3 and all((p.before, p.after) == ("```py\n", "```") and len(p.before) + p.last - p.first + len(p.after) <= 200 for p in pieces)
    assert "".join(code[p.first : p.last] for p in pieces) == "line of code\n" * 50


def test_chunks_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (None, "b " * 5000), (5, "y" * 50_000)]
    got = blocks.chunk_documents(spark.createDataFrame(rows, "key long, body string"), "key", "body").collect()
    assert sorted({str(r["key"]) for r in got}) == ["4", "5", "None"] and sum(r["key"] == 4 for r in got) == 2
    assert "".join(r["text"] for r in got if r["key"] == 5) == "y" * 50_000


def test_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "a.md").write_text("---\nt: 1\n---\nSee [[Other|x]] #tag ![[p.png]]")
    (tmp_path / "b.html").write_text("<p>Hi &amp; <script>no</script>you</p>")
    (tmp_path / "c.py").write_text("def f():\n    pass\nclass G:\n    def g(self):\n        f()\n")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w><p>Hello</p><p>there</p></w>")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    files = readers.scan_tree(spark, str(tmp_path)).cache()
    text = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"]) for r in files.collect()}
    assert text["b.html"] == ("html", "Hi & you") and text["d.docx"] == ("docx", "Hello there") and text["e.docx"] == ("unreadable", "")
    n = readers.notes(files).first()
    assert (n["links"], n["attachments"], n["tags"], n["front_matter"]) == (["Other"], ["p.png"], ["tag"], "t: 1")
    s = readers.symbols(files.filter("kind = 'py'"))
    assert sorted((r["kind"], r["name"]) for r in s.collect()) == [("class", "G"), ("def", "f"), ("def", "g")]
    assert "f" in {r["name"] for r in readers.calls(files.filter("kind = 'py'"), s).collect()}


def test_streaming(spark, data, tmp_path):
    from tessella.streaming import events

    spark.read.parquet(f"{data}/events.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.statefulOperator.checkCorrectness.enabled", "false")
    stream = events.read_events(spark, str(tmp_path / "in"))
    q = events.tumbling(stream, "1 day").writeStream.format("memory").queryName("daily").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.read.parquet(f"{data}/events.parquet").count()
    assert spark.sql("select sum(n) as n from daily").first()["n"] == batch
    q = events.reinforcement(stream).writeStream.format("memory").queryName("state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count(distinct user_id) as n from state").first()["n"] > 0
