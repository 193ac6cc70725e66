"""Spelling variants against all pairs of words, and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def deleted(word):
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return a in deleted(b) if len(a) == len(b) - 1 else b in deleted(a) if len(b) == len(a) - 1 else False


def plain(words, times=5):
    """Near words by what a deletion leaves, each confirmed by its definition."""
    left = {}
    for w in words:
        for x in {w} | deleted(w):
            left.setdefault(x, set()).add(w)
    near = {w: {o for x in {w} | deleted(w) for o in left[x] if o != w and is_near(w, o)} for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows(frame):
    got = frame.collect()
    out = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got}
    assert len(out) == len(got)
    return out


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = plain(plain_words(docs))
    assert rows(spelling.op11_spelling(spark, folder)) == want
    assert sum(r[1] is not None for r in want) > 3 and len(want) > 500


@pytest.mark.parametrize("block", [2, 100])
def test_skewed_blocks(spark, block):
    """Words that share their halves by the hundred, chains of forms, ties, and words of all lengths."""
    rng = np.random.default_rng(7)
    words = {}
    for k in range(300):
        words["aaaaaa" + "".join(rng.choice(list("abé"), 4))] = int(rng.integers(5, 2000))
        words["".join(rng.choice(list("xy"), 4)) + "zzzzzzz"] = int(rng.integers(5, 2000))
        words["".join(rng.choice(list("mn"), rng.integers(6, 9)))] = int(5 ** rng.integers(1, 6))
        words["q" * rng.integers(6, 60)] = int(rng.integers(5, 10**7))
    words |= {"é" * 400 + x: n for x, n in (("a", 5), ("b", 25), ("ab", 125), ("c", 625))}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.spelling_groups(frame, block=block)) == plain(words)
    got = spelling.near_words(frame, block).collect()
    assert len(got) == len({(r["word"], r["near"]) for r in got}) == sum(r[4] for r in plain(words))


def test_memory_of_pairs_is_bounded():
    """Blocks of long words, and one of very long ones among many of short ones: no array of all pairs or words by the widest."""
    import tracemalloc

    rows = []

    def block(words, key):
        short = min(map(len, words))
        rows.extend((w, 5, "f", short, short // 2, 0, 1 << 30, key) for w in words)

    for k in range(45):
        block([f"{'q' * 30}{j:030d}" for j in range(100)], f"a{k:03d}")
    for k in range(3000):
        block([f"word{k:04d}x", f"word{k:04d}y"], f"b{k:04d}")
    block(["é" * 20_000 + x for x in "xyz"], "c")
    names = ["word", "n", "side", "short", "front", "back", "bar", "key"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    tracemalloc.start()
    got = Counter(p for b in spelling.near_in_blocks(iter([batch])) for p in zip(b["word"].to_pylist(), b["near"].to_pylist(), strict=True))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = {(a, b) for words in ([f"{'q' * 30}{j:030d}" for j in range(100)],) for a in words for b in words if is_near(a, b)}
    assert all(got[p] == 45 for p in near) and len(got) == len(near) + 6000 + 6
    assert most < 100e6


def test_short_words(spark):
    words = {"a": 1, "b": 5, "ab": 25, "ba": 3, "abc": 125, "": 7}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {r for r in plain(words) if r[0]}
    got = {r for r in rows(spelling.spelling_groups(frame)) if r[0]}
    assert {r[:1] + r[3:4] for r in got} == {r[:1] + r[3:4] for r in want}


def test_checksums(monkeypatch):
    monkeypatch.setattr(spelling, "TABLE_BYTES", 7)
    ids, runs = ["12", "", "-5", "x"], ["a", "été", "longer", "much longer", ""]
    doc, code = np.repeat(np.arange(4), 5), np.tile(np.arange(5), 4)
    got = spelling._slips(ids, doc, code, pa.array(runs, pa.large_string()))
    assert got.tolist() == [zlib.crc32(f"{i}:{r}".encode()) for i in ids for r in runs]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = ["Straße", "straBe", "naïveté", "naivete", "Àbcdef", "àbcdef", "abcdefg", "ab cdefg", "x×y÷zzz", "日本語日本語"]
    docs = [(int(k) if k % 7 else None, " ".join(rng.choice(base, 40))) for k in range(60)]
    docs += [(5, "repeated rows here"), (5, "repeated rows here")] * 5 + [(1, None), (2, ""), (3, "  \n"), (4, "word" * 200_000), (6, "lengthy " * 100_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as key", "4 as short", "5 as near")
    assert rows(spelling.spelling_variants(frame)) == plain(plain_words(docs))
    assert spelling.spelling_variants(frame.filter("false")).count() == 0
