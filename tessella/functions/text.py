"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the token sets.
STOPWORDS = ["the", "a", "an", "to", "of", "in", "on", "for", "and", "or", "is", "are", "was", "were", "we", "our", "with", "by", "it", "that", "this", "did", "do", "as", "at", "be", "has", "have", "from", "into", "now", "will", "all"]


def tokens(text: Column) -> Column:
    """Distinct lower-case letter and digit tokens of two or more characters that are no stop words."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "), " ")
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that it uses several times: as a variable, which is not worked out again at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters after collapsing white space, half to even, at least 1; 0 for blank text."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    return F.when(flat == "", 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(flat) / 4, 0).cast("int")))


def regex_tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])"), F.lit(1)))


def stem(t: Column) -> Column:
    """Conservative English inflections."""
    n = F.length(t)
    cut = lambda k: F.substr(t, F.lit(1), n - k)
    return (
        F.when((n > 5) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 6) & t.endswith("ions"), cut(4))
        .when((n > 5) & t.endswith("ion"), cut(3))
        .when((n > 6) & (t.endswith("ised") | t.endswith("ized")), cut(1))
        .when((n > 6) & t.endswith("ates"), cut(2))
        .when((n > 4) & t.endswith("s") & ~t.endswith("ss"), cut(1))
        .otherwise(t)
    )


def search_terms(query: Column) -> Column:
    """Terms of a query, each followed by its inflection variant, without repeats."""
    terms = F.filter(F.split(F.regexp_replace(query, "[^\\p{L}\\p{N}]+", " "), " "), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.array_distinct(F.array(t, stem(t))))))


def expanded(query: str) -> list[str]:
    """``search_terms`` of a query that is known when the plan is made: its lower-case terms, each with its inflection variant."""
    endings = (("ies", 5, 3, "y"), ("ions", 6, 4, ""), ("ion", 5, 3, ""), ("ised", 6, 1, ""), ("ized", 6, 1, ""), ("ates", 6, 2, ""))
    out: dict[str, None] = {}
    for term in re.findall(r"[^\W_]+", query.lower()):
        out[term] = None
        ending = next((e for e in endings if len(term) > e[1] and term.endswith(e[0])), None)
        if ending:
            out[term[: -ending[2]] + ending[3]] = None
        elif len(term) > 4 and term.endswith("s") and not term.endswith("ss"):
            out[term[:-1]] = None
    return list(out)


def lexical_support(query: Column, content: Column) -> Column:
    """Evidence of stemmed token sets; one shared word of several is none."""
    q, c = (F.array_distinct(F.transform(x, stem)) for x in (query, content))
    hit = F.size(F.array_intersect(q, c))
    return F.when((F.size(q) == 0) | ((F.size(q) >= 2) & (hit < 2)), 0.0).otherwise(F.greatest(jaccard(q, c), hit / (F.size(q) + 1)))


def related_count(query: Column, content: Column) -> Column:
    """How many query terms the content holds, as they are or with a common beginning of 5 to 7 characters."""

    def same(q: Column, t: Column) -> Column:
        n = F.greatest(F.lit(5), F.least(F.lit(7), F.length(q), F.length(t)))
        return (q == t) | ((F.least(F.length(q), F.length(t)) >= 5) & (F.substr(q, F.lit(1), n) == F.substr(t, F.lit(1), n)))

    return F.size(F.filter(query, lambda q: F.exists(content, lambda t: same(q, t))))


def overlapping(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each beginning ``overlap`` before the end of the last; a short text is one piece."""
    step = size - overlap
    last = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)) - 1
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.substr(text, k * step + 1, F.lit(size)))


def fitting_sentences(text: Column, budget: int) -> Column:
    """The first sentences (up to their final marks) whose estimated tokens together stay within the budget."""
    sentences = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^.!?]+[.!?]*"), F.lit(0))
    none = F.struct(F.array().cast("array<string>").alias("held"), F.lit(0).alias("spent"))

    def step(s: Column, x: Column) -> Column:
        spent = s["spent"] + estimate_tokens(x)
        return F.when(spent <= budget, F.struct(F.array_append(s["held"], x).alias("held"), spent.alias("spent"))).otherwise(F.struct(s["held"].alias("held"), spent.alias("spent")))

    return F.aggregate(sentences, none, step, lambda s: s["held"])


# Words that limit or turn round what a sentence says.
QUALIFIERS = ["cannot", "except", "if", "must", "never", "no", "not", "only", "unless", "until", "when", "without"]


def excerpt(text: Column, terms: Column, budget: int) -> Column:
    """The sentences of a text that answer terms best, in their order, within a budget of regex tokens.

    Sentences that qualify go first, as leaving one out could turn the meaning round; only
    if all of them fit, others fill the rest, those with most terms before others.  A mark
    stands for what is left out, and if no sentence fits, the first words of the best do.
    """
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])[\"')\\]]*\\s+|\\n+"), lambda s: F.trim(s) != "")
    limits = F.array(*map(F.lit, QUALIFIERS))
    count = lambda words, of: F.size(F.array_intersect(words, of))  # noqa: E731  each word once

    def rated(s: Column, i: Column) -> Column:
        counts = once(F.split(F.lower(s), "[^\\p{L}\\p{N}_]+"), lambda w: F.struct((-count(w, terms)).alias("hits"), count(w, limits).alias("odd")))
        return once(counts, lambda c: F.struct((c["odd"] == 0).cast("int").alias("plain"), c["hits"].alias("hits"), (-c["odd"]).alias("odd"), i.alias("place"), F.trim(s).alias("s"), regex_tokens(s).alias("n")))

    def chosen(ranked: Column, n: Column) -> Column:
        def admit(st: Column, x: Column) -> Column:
            mark = F.when(F.size(st["held"]) + 1 < n, 3).otherwise(0)  # tokens of [...]
            fits = (st["spent"] + x["n"] + mark <= budget) & ((x["plain"] == 0) | st["whole"])
            more = F.array_append(st["held"], F.struct(x["place"].alias("place"), x["s"].alias("s")))
            with_it = F.struct(more.alias("held"), (st["spent"] + x["n"]).alias("spent"), st["whole"].alias("whole"))
            return F.when(fits, with_it).otherwise(F.struct(st["held"].alias("held"), st["spent"].alias("spent"), (st["whole"] & (x["plain"] == 1)).alias("whole")))

        begin = F.struct(F.array().cast("array<struct<place: int, s: string>>").alias("held"), F.lit(0).alias("spent"), F.lit(True).alias("whole"))
        return F.aggregate(ranked, begin, admit, lambda st: F.sort_array(st["held"]))

    def shown(ranked: Column, n: Column, held: Column) -> Column:
        cut = F.array_join(F.slice(F.split(F.get(ranked, F.lit(0))["s"], "\\s+"), 1, budget), " ")
        joined = F.array_join(F.transform(held, lambda x: x["s"]), " ")
        return F.when(n == 0, "").when(F.size(held) == 0, cut).otherwise(F.concat(joined, F.when(F.size(held) < n, " […]").otherwise("")))

    ranked = F.sort_array(F.transform(parts, rated))
    return once(ranked, lambda r: once(F.size(r), lambda n: once(chosen(r, n), lambda held: shown(r, n, held))))


def claim_text(value: Column) -> Column:
    """A claim without punctuation at word boundaries, white space collapsed, in lower case."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), "(?<=^|\\s)\\p{P}|\\p{P}(?=\\s|$)", " ")
    return F.lower(F.trim(F.regexp_replace(bare, "\\s+", " ")))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, common entities decoded, white space collapsed."""
    text = F.regexp_replace(html, "(?is)<(script|style|template|noscript)\\b.*?</\\1\\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def trigrams(text: Column, most: int = 512) -> Column:
    """Character trigrams of the first ``most`` characters (the limit is part of the embedder)."""
    head = F.substring(F.lower(text), 1, most)
    last = F.length(head) - 2
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(head, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def entity_name(name: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(name, "\\s+", " ")))


# The same functions for DuckDB.
_STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: length(t) > 1 AND t NOT IN ({_STOP_SQL})))"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def estimate_tokens_sql(x: str) -> str:
    flat = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    return f"CASE WHEN {flat} = '' THEN 0 ELSE greatest(1, round_even(length({flat}) / 4.0::DOUBLE, 0)::INTEGER) END"


def stem_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 5 AND {t} LIKE '%ies' THEN substr({t}, 1, length({t}) - 3) || 'y' WHEN length({t}) > 6 AND {t} LIKE '%ions' THEN substr({t}, 1, length({t}) - 4) "
        f"WHEN length({t}) > 5 AND {t} LIKE '%ion' THEN substr({t}, 1, length({t}) - 3) WHEN length({t}) > 6 AND ({t} LIKE '%ised' OR {t} LIKE '%ized') THEN substr({t}, 1, length({t}) - 1) "
        f"WHEN length({t}) > 6 AND {t} LIKE '%ates' THEN substr({t}, 1, length({t}) - 2) WHEN length({t}) > 4 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"
    )
