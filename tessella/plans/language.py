"""Names, phrases, keywords, chunks and excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.model import table
from tessella.operators import naming as N
from tessella.plans.base import query

_FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_ODD = "CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || '-X ' WHEN 1 THEN upper(p_name) || '.io' WHEN 2 THEN replace(p_name, ' ', '  ') ELSE p_name || ' & co.' END"


@query(f"WITH n AS (SELECT p_partkey, {_ODD} AS name FROM part) SELECT p_partkey, {_FOLD.format('name')} AS normalized, list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda t: length(t) >= 2))) AS tokens, replace({_FOLD.format('name')}, ' ', '') AS compact, regexp_replace(lower(name), '[\\p{{L}}\\p{{N}}\\s]+', '', 'g') AS punctuation FROM n")
def name_signatures(spark, sf_dir):
    """Normalised name, blocking tokens, compact spelling and punctuation of entity names (ASCII here; see tests for others)."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ODD).alias("name"))
    return n.select("p_partkey", N.folded("name").alias("normalized"), N.token_set(F.col("name")).alias("tokens"), N.compact(F.col("name")).alias("compact"), N.punctuation(F.col("name")).alias("punctuation"))


@query("WITH n AS (SELECT DISTINCT lower(array_to_string(string_split(text, ' ')[3:5], ' ')) AS name FROM benchmark), m AS (SELECT name FROM n WHERE regexp_matches(name, '[\\p{L}\\p{N}_]')), d AS (SELECT doc_id, lower(text) AS low FROM documents), c AS MATERIALIZED (SELECT doc_id, low, name FROM d, m WHERE contains(low, name)) SELECT doc_id, name FROM c WHERE regexp_matches(low, '(^|[^\\p{L}\\p{N}_])' || regexp_replace(name, '([^\\p{L}\\p{N}\\s])', '\\\\\\1', 'g') || '($|[^\\p{L}\\p{N}_])')")
def phrase_mentions(spark, sf_dir):
    """Which document holds which phrase (three words of each benchmark text) as whole words."""
    names = table(spark, sf_dir, "benchmark").select(F.lower(F.array_join(F.slice(F.split("text", " "), 3, 3), " ")).alias("name"))
    return N.phrase_mentions(table(spark, sf_dir, "documents"), names, "doc_id", "text")


@query("SELECT doc_id, contains(text, '_') AS under, contains(text, '%') AS percent FROM documents WHERE contains(text, '_') OR contains(text, '%')")
def like_escaped(spark, sf_dir):
    """Texts that hold a wildcard itself: LIKE with the wildcards of the query escaped."""
    d = table(spark, sf_dir, "documents")
    has = lambda q: F.expr(f"text LIKE '%{N.escaped(q)}%' ESCAPE '!'")
    return d.select("doc_id", has("_").alias("under"), has("%").alias("percent")).filter("under or percent")


@query(f"SELECT doc_id, list_slice(list_sort({T.tokens_sql('text')}), 1, 8) AS keywords FROM documents")
def keywords(spark, sf_dir):
    """The first eight tokens of every text in their order (each counts once)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.slice(F.array_sort(T.tokens(F.col("text"))), 1, 8).alias("keywords"))


WORDS = ("licensing", "versions", "worthless", "thing")
_P = "greatest(5, least(7, least(length('{w}'), length(t))))"


@query(f"WITH d AS (SELECT doc_id, {T.tokens_sql('text')} AS ts FROM documents) SELECT doc_id, CAST({' + '.join(f'''(len(list_filter(ts, lambda t: t = '{w}' OR (length(t) >= 5 AND substr(t, 1, {_P.format(w=w)}) = substr('{w}', 1, {_P.format(w=w)})))) > 0)::INT''' for w in WORDS)} AS INTEGER) AS related FROM d")
def related_terms(spark, sf_dir):
    """How many words of a query a text holds, as they are or with a common beginning of 5 to 7 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return d.select("doc_id", T.related_count(F.array(*map(F.lit, WORDS)), F.col("ts")).alias("related"))


@query("WITH r AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 900.0) AS BIGINT)))) AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, k::INTEGER AS chunk, sha256(substr(text, (k * 900 + 1)::BIGINT, 1000)) AS digest, length(substr(text, (k * 900 + 1)::BIGINT, 1000))::INTEGER AS n_chars FROM r")
def chunk_overlap(spark, sf_dir):
    """Texts in chunks of 1000 characters that overlap by 100."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    c = d.select("doc_id", F.posexplode(T.overlapping(F.col("text"), 1000, 100)).alias("chunk", "body"))
    return c.select("doc_id", "chunk", F.sha2("body", 256).alias("digest"), F.length("body").alias("n_chars"))


@query(f"WITH s AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS p FROM documents) WHERE len(p) > 0), c AS (SELECT *, sum({T.estimate_tokens_sql('s')}) OVER (PARTITION BY doc_id ORDER BY i) AS spent FROM s) SELECT doc_id, count(*)::INTEGER AS sentences, sha256(string_agg(s, '' ORDER BY i)) AS digest FROM c WHERE spent <= 60 GROUP BY doc_id")
def sentence_fit(spark, sf_dir):
    """The first whole sentences of every text within 60 estimated tokens; texts whose first sentence is longer are left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.fitting_sentences(F.col("text"), 60).alias("s"))
    return d.filter("size(s) > 0").select("doc_id", F.size("s").alias("sentences"), F.sha2(F.array_join("s", ""), 256).alias("digest"))


@query()
def context_excerpts(spark, sf_dir):
    """What each document says to a query in 40 tokens; limits and negations stay with what they limit."""
    terms = F.array(*map(F.lit, ("licensed", "version", "worthless", "things")))
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), terms, 40).alias("excerpt"))
