"""Ranked retrieval: vector and lexical arms, fusion, caps, grounding."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scoring
from tessella.functions import text as T
from tessella.operators.graph import cut

#: Vectors that a block holds, of queries and of what they are compared with.
QUERY_BLOCK = 16_384


def unit(v: Column) -> Column:
    """A vector of doubles of length 1; null for a zero vector."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows most similar to the query by cosine, ties by id; zero vectors do not count."""
    length = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / length) for x in query])
    scored = vectors.select(id_col, dot(unit(F.col(vector_col)), q).alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows most similar to each query (a row is not its own neighbour); zero vectors do not count.

    Queries and vectors are dealt to blocks of about ``block`` rows by a hash, and each
    pair of blocks is one group of matrix work that gives k rows a query.  Nothing is
    collected; a vector travels once for each block of queries, and no pair does.
    """
    width = F.transform(vector_col, lambda x: x.cast("double")).alias("v")
    mine = queries.select(F.col(query_id).cast("long").alias("id"), width, F.lit(True).alias("asks")).filter("v is not null")
    theirs = vectors.select(F.col(id_col).cast("long").alias("id"), width, F.lit(False).alias("asks")).filter("v is not null")
    a, b = (max(1, -(-df.count() // block)) for df in (mine, theirs))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = mine.withColumn("a", F.expr(f"cast(pmod(xxhash64(id), {a}) as int)")).withColumn("b", spread(b))
    theirs = theirs.withColumn("b", F.expr(f"cast(pmod(xxhash64(id), {b}) as int)")).withColumn("a", spread(a))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        norm = np.linalg.norm(x, axis=1)
        ids, asks = pdf["id"].to_numpy(), pdf["asks"].to_numpy(bool)
        q, d = np.flatnonzero(asks & (norm > 0)), np.flatnonzero(~asks & (norm > 0))
        d = d[np.argsort(ids[d], kind="stable")]  # among equal scores the least id comes first
        right = (x[d] / norm[d, None]).T
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q) if len(d) else 0, 512):
            some = q[at : at + 512]
            s = (x[some] / norm[some, None]) @ right
            s[ids[some][:, None] == ids[d][None, :]] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(s, order, 1)
            good = np.isfinite(best)
            out.append((np.repeat(ids[some], good.sum(axis=1)), ids[d][order[good]], best[good]))
        cat = lambda i, kind: np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind)
        return pd.DataFrame({query_id: cat(0, np.int64), id_col: cat(1, np.int64), "score": cat(2, float)})

    found = mine.unionByName(theirs).groupBy("a", "b").applyInPandas(search, f"{query_id} long, {id_col} long, score double")
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def _begins(term: str):
    return lambda word: F.startswith(word, F.lit(term))


def bm25(docs: DataFrame, terms: list[str], id_col: str, text_col: str, k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 of prefix terms over all rows; statistics cover the whole table.

    One pass over the texts writes each row's length and term counts, numbers only; the
    statistics and the scores are read from those.  All terms are found by one pattern
    that takes the longest that begins a word: the others that begin it are beginnings
    of that one.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    any_term = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    found = F.regexp_extract_all("low", F.lit(f"(?<![\\p{{L}}\\p{{N}}])(?:{any_term})"), F.lit(0)) if terms else F.array().cast("array<string>")
    rows = docs.select(id_col, low.alias("low")).select(id_col, F.regexp_count("low", F.lit("[\\p{L}\\p{N}]+")).alias("dl"), found.alias("found"))
    rows = rows.select(id_col, "dl", *[F.size(F.filter("found", _begins(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    rows = cut(rows)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    for i in range(len(terms)):
        df = stats[f"df{i}"]
        idf = max(float(np.log((n - df + 0.5) / (df + 0.5))), 1e-6)
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))
    hits = rows.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false").select(id_col, score.alias("score"))
    return hits.orderBy(F.desc("score"), id_col).limit(k) if k else hits


def bm25_sql(terms: list[str], k: int, id_col: str = "doc_id", text: str = "text", source: str = "documents", k1: float = 1.2, b: float = 0.75) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda t: starts_with(t, '{t}'))) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf{i} * {k1 + 1}::DOUBLE / (tf{i} + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""w AS (SELECT {id_col}, list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '') AS w FROM {source}),
f AS (SELECT {id_col}, len(w) AS dl, {tf} FROM w), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM f),
bm AS (SELECT {id_col}, {part} AS score FROM f, s WHERE {some} ORDER BY score DESC, {id_col} LIMIT {k})"""


def like_fallback(docs: DataFrame, query: str, id_col: str, text_col: str, k: int) -> DataFrame:
    """Rows that hold the query literally, then rows that hold one of its terms; score 0.5."""
    terms = [t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split() if t]
    low = F.lower(F.col(text_col))
    literal = F.contains(low, F.lit(query.lower()))
    some = F.lit(False)
    for t in terms:
        some |= F.contains(low, F.lit(t))
    rows = docs.filter(literal | some).select(id_col, F.when(literal, 0).otherwise(1).alias("tier"), F.lit(0.5).alias("score"))
    return rows.orderBy("tier", id_col).limit(k)


def normalised(df: DataFrame, score: str, *keys: str) -> DataFrame:
    """Min-max over all rows of the keys; values that are no finite number drop out."""
    x = F.col(score)
    good = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    span = good.groupBy(*keys).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    joined = good.join(span, list(keys)) if keys else good.crossJoin(F.broadcast(span))  # one row
    return joined.withColumn("norm", scoring.minmax(x, F.col("__low"), F.col("__high"))).drop("__low", "__high")


def rrf(arms: DataFrame, id_col: str = "id", arm: str = "arm", score: str = "score", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion over the arms of an (id, arm, score) table."""
    order = Window.partitionBy(arm).orderBy(F.desc(score), id_col)
    ranked = arms.withColumn("__rank", F.row_number().over(order))
    return ranked.groupBy(id_col).agg(F.sum(1.0 / (constant + F.col("__rank"))).alias("rrf"), F.count(F.lit(1)).alias("arms"))


def type_limits(ranked: DataFrame, caps: dict[str, int], k: int, id_col: str = "id", score: str = "score") -> DataFrame:
    """At most the given number of rows of each type in rank order, then the best k."""
    order = Window.partitionBy("mtype").orderBy(F.desc(score), id_col)
    cap = F.coalesce(F.create_map(*[F.lit(v) for kv in caps.items() for v in kv])[F.col("mtype")], F.lit(1 << 30)) if caps else F.lit(1 << 30)
    return ranked.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= cap).drop("__n").orderBy(F.desc(score), id_col).limit(k)


def grounded(rows: DataFrame, query: str, id_col: str, text_col: str, floor: float = 0.25, most: int = 5) -> DataFrame:
    """Sources whose lexical support reaches the floor, best first; none means to abstain."""
    q = T.tokens(F.lit(query))
    s = rows.select(id_col, T.lexical_support(q, T.tokens(F.col(text_col))).alias("support"))
    return s.filter(F.col("support") >= floor).orderBy(F.desc("support"), id_col).limit(most)


def recency_window(rows: DataFrame, budget: int, keys: list[str], tokens: str, *order: Column) -> DataFrame:
    """The newest rows, without a gap, whose tokens together stay within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("spent", F.sum(tokens).over(w)).filter(F.col("spent") <= budget)


def near_counts(vectors: DataFrame, threshold: float, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, links: how many other vectors have at least the given cosine; rows without any are left out.

    The vectors fall into blocks, and each pair of blocks is one group: a row goes to as
    many groups as there are blocks, and comes out of each as one count.  The work is
    that of all pairs, which exactness takes, but the pairs never leave the task.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).filter("v is not null")
    rows = rows.withColumn("own", F.expr(f"cast(pmod(xxhash64(id), {blocks}) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "v", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        norm = np.linalg.norm(x, axis=1)
        x = x / np.where(norm > 0, norm, 1)[:, None]
        ids, own = pdf["id"].to_numpy(), pdf["own"].to_numpy()
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        near = (x[left] @ x[right].T >= threshold) & (norm[left] > 0)[:, None] & (norm[right] > 0)[None, :]
        near &= ids[left][:, None] != ids[right][None, :]
        if a == b:
            return pd.DataFrame({"id": ids[left], "links": near.sum(axis=1)})
        return pd.DataFrame({"id": np.concatenate((ids[left], ids[right])), "links": np.concatenate((near.sum(axis=1), near.sum(axis=0)))})

    found = rows.groupBy("a", "b").applyInPandas(count, "id long, links long")
    return found.groupBy("id").agg(F.sum("links").alias("links")).filter("links > 0").withColumnRenamed("id", id_col)
