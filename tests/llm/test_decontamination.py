"""Decontamination against every window of every text, its SQL, and odd rows."""

import hashlib
import re

import numpy as np
import pytest

from oracle import connect, rows
from tessella.llm import decontamination

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(docs, items, width=10):
    out = []
    windows = []
    for name, text in items:
        w = words(text)
        size = min(len(w), width)
        windows += [(str(name if name is not None else ""), tuple(w[i : i + size])) for i in range(len(w) - size + 1) if w]
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(x) for _, x in windows}:
            at = {}
            for k in range(len(w) - size + 1):
                at.setdefault(tuple(w[k : k + size]), []).append(k)
            for name, x in windows:
                for k in at.get(x, ()) if len(x) == size else ():
                    hit |= set(range(k, k + size))
                    names.add(name)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    rng = np.random.default_rng(11)
    vocabulary = ["the", "of", "Et", "été", "日本", "x1", "2"] + [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for k in range(30)]
    items += [(30, items[3][1] + " more words after it"), (31, items[4][1]), (4, "another text of the same id, longer than a window of ten words"), (None, "an item without an id"), (33, None), (34, "..."), (35, "alone"), (36, "Two words")]
    docs = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 80)))) for k in range(60)]
    for k in range(60):
        body = words(items[rng.integers(0, 30)][1])
        a = rng.integers(0, len(body) + 1)
        cut = body[a : a + rng.integers(5, 30)]
        docs.append((100 + k, ("prefix, " + "; ".join(cut).upper() + "\n" + " ".join(rng.choice(vocabulary, 5))) * rng.integers(1, 4)))
    docs += [(5, "ALONE"), (5, "ALONE"), (None, "two words two words"), (None, "nothing"), (200, None), (201, ""), (202, "w1 " * 300_000), (203, "".join(x[1] or "" for x in items)), (204, "ab-alone-ab"), (205, "an item"), (206, "without an id")]
    return docs, items


def result(spark, docs, items, **how):
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **how).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got), key=repr)


def test_equals_all_windows(spark):
    docs, items = cases()
    want = plain(docs, items)
    assert result(spark, docs, items) == want
    assert result(spark, docs, items, block_bytes=1500) == want  # several blocks
    assert sum(r[-1] for r in want) > 40


def test_shards_of_one_document(spark, monkeypatch):
    docs, items = cases()
    buf = decontamination.K.text_bytes(decontamination.pa.array([t for _, t in docs]))
    block = decontamination.block_of([str(n) for n, _ in items], decontamination.pa.array([t for _, t in items]))
    hashes, count = decontamination._words(*buf)
    assert count.tolist() == [len(words(t)) for _, t in docs]
    code = np.searchsorted(block.vocabulary, hashes)
    code = np.where(block.vocabulary[np.minimum(code, len(block.vocabulary) - 1)] == hashes, code + 1, 0)
    text, where, sa = decontamination.shard_suffixes(code, len(block.vocabulary), 1, 10)
    padded = np.append(text, np.zeros(10, text.dtype))
    tuples = [tuple(padded[k : k + 10]) for k in sa]
    assert tuples == sorted(tuples) and len(sa) == (code > 0).sum() and (text[sa] == code[where[sa]]).all()


def test_matches_are_maximal_and_verbatim(spark):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), with_matches=True).filter("doc_id >= 100 and doc_id < 200").collect()
    bodies = {}
    for name, text in items:
        bodies.setdefault(str(name), []).append(words(text))
    seen = 0
    for r in got:
        w = words(dict(docs)[r["doc_id"]])
        for m in r["matches"]:
            a, n, b = m["start"], m["words"], m["item_start"]
            body = next(x for x in bodies[m["item"]] if x[b : b + n] == w[a : a + n])
            assert a == 0 or b == 0 or w[a - 1] != body[b - 1]
            assert a + n == len(w) or b + n == len(body) or w[a + n] != body[b + n]
            seen += n >= 10
    assert seen > 20


def test_affected_documents_go(spark):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as matches", "3 as sha", "4 as key")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(frame, bench)
    assert got.columns == frame.columns
    assert sorted((repr(tuple(r)[:2]) for r in got.collect())) == sorted(repr(d) for d, r in zip(docs, [plain([d], items)[0] for d in docs], strict=True) if not r[-1])


def test_empty_tables(spark):
    docs, items = cases()
    assert result(spark, [], items) == []
    assert all(r[2:4] == (0, 0) and not r[5] for r in result(spark, docs[:5], []))
    assert all(r[2:4] == (0, 0) for r in result(spark, docs[:5], [(1, None), (2, "--")]))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_says_what_its_sql_says(spark, size):
    folder = f"/root/testdata/{size}"
    got = decontamination.op12_decontamination(spark, folder).toPandas()
    assert rows(got) == rows(connect(folder).execute(decontamination.OP12_SQL).df())
