"""Divergence of sources against a plain version, its SQL, and odd rows."""

import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from oracle import connect, rows
from tessella.llm import divergence

DOC = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top):
    """The same by its definition, over all terms of all pairs."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))) for text, lang, source in docs]
    seen, of = Counter(), defaultdict(Counter)
    for lang, source, terms in docs:
        seen.update((lang, t) for t in set(terms))
        of[lang, source].update(terms)
    out = set()
    for lang in {x[0] for x in docs}:
        kept = sorted(t for (x, t), n in seen.items() if x == lang and n >= least)
        groups = {s: c for (x, s), c in of.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def level(count, kept=kept):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        p, q = {s: level(c) for s, c in groups.items()}, level(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def result(spark, data, **how):
    got = divergence.source_divergence(spark.createDataFrame([(i, *x, 0) for i, x in enumerate(data)], DOC), **how).collect()
    return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got}, len(got)


def test_equals_the_definition(spark):
    rng = np.random.default_rng(5)
    words = ["Été", "naïve", "日本", "a", "B", "the", "THE", "x1y", "über-", "mañana"] + [f"w{chr(97 + i)}" for i in range(20)]
    data = [(" ".join(rng.choice(words, rng.integers(0, 30))), ("en", "de", None, "")[rng.integers(0, 4)], ("a", "b", "ç", None, "hot", "hot", "hot")[rng.integers(0, 7)]) for _ in range(300)]
    data += [("only here", "xx", "one"), (None, "xx", "two"), ("", "yy", "alone"), ("12 34 !", "en", "no terms"), *[("same text", "en", "copies")] * 50]
    for least, top in ((10, 10), (1, 3), (60, 10)):
        got, n = result(spark, data, least=least, top=top)
        assert got == plain(data, least, top) and n == len(got)


def test_empty_and_clashing_names(spark):
    assert result(spark, [])[1] == 0
    data = [("one two", "en", "a"), ("two", "en", "b")] * 6
    odd = spark.createDataFrame([(i, *x, 0) for i, x in enumerate(data)], DOC).selectExpr("*", "1 as term", "2 as n", "3 as total", "4 as p", "5 as rank", "6 as item", "7 as o")
    got = divergence.source_divergence(odd).collect()
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == plain(data, 10, 10)


def test_long_text_and_large_counts(spark):
    data = [("word " * 400_000 + "x" * 100_000, "en", "a"), *[(f"word other{chr(97 + i)}", "en", "b") for i in range(20)]]
    assert result(spark, data)[0] == plain(data, 10, 10)


def test_groups_too_many_to_be_sent_everywhere(spark, monkeypatch):
    data = [(f"one two {w}", "en", s) for w, s in product(("x", "y", "z"), "abcdefgh")]
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    assert result(spark, data, least=2)[0] == plain(data, 2, 10)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_says_what_its_sql_says(spark, size):
    folder = f"/root/testdata/{size}"
    got = divergence.op13_source_divergence(spark, folder).toPandas()
    assert rows(got) == rows(connect(folder).execute(divergence.OP13_SQL).df())
