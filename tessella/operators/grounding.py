"""Whether answers say only what the sources say that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import safety

# Words that make a citation grammatical without claiming anything.
GLUE = ["according", "answer", "answers", "based", "evidence", "indicates", "per", "provided", "said", "says", "source", "sources", "states", "supports"]


def ordered(text: Column) -> Column:
    """The words of a text in their order, in lower case, numbers and repeats too."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _line(words: Column) -> Column:
    """Words between spaces, so that a run of words is a part of the line."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def clauses(answers: DataFrame) -> DataFrame:
    """id, clause (its place), markers and claim of every clause of answers (id, text): a clause ends at a mark and white space;
    the claim is its words without markers and glue."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "(?<=[.!?])\\s+"), lambda c: F.trim(c) != "")
    each = answers.select("id", F.posexplode(parts).alias("clause", "body"))
    # A number too long for an integer names no source either.
    numbers = F.transform(F.regexp_extract_all("body", F.lit("\\[(\\d+)\\]"), F.lit(1)), lambda m: F.when(F.length(F.ltrim(m, F.lit("0"))) > 9, F.lit(-1)).otherwise(m.cast("int")))
    glue = F.array(*map(F.lit, GLUE))
    claim = F.filter(ordered(F.regexp_replace("body", "\\[\\d+\\]", "")), lambda w: ~F.array_contains(glue, w))
    return each.select("id", "clause", numbers.alias("markers"), claim.alias("claim"))


def bounded(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """id, supported, clauses, supported_clauses for answers (id, text; ids distinct) with citations (id, n, content).

    An answer is supported if it has no payload signal, every marker [n] names one of its
    citations (numbered from 1), and the words of each clause, in their order and without
    a gap, are in one of the sources that this clause cites.  A set of words would not do:
    the same words in another order can say the opposite.  Without a clause, a marker in
    every clause, or a claim, an answer is not supported.  Every clause meets its own sources
    in a join of (id, n); no source travels more than once for each clause that cites it.
    """
    parts = clauses(answers)
    numbered = citations.groupBy("id").agg(F.countDistinct("n").alias("n_citations"))
    lines = citations.select("id", F.col("n").alias("marker"), _line(ordered(F.col("content"))).alias("line"))
    cited = parts.filter("size(claim) > 0").select("id", "clause", _line(F.col("claim")).alias("claim"), F.explode(F.array_distinct("markers")).alias("marker"))
    hits = cited.join(lines, ["id", "marker"]).filter(F.contains("line", F.col("claim"))).select("id", "clause").distinct().withColumn("hit", F.lit(1))
    each = parts.select("id", "clause", "markers").join(hits, ["id", "clause"], "left").join(numbered, "id", "left")
    good = F.forall("markers", lambda m: (m >= 1) & (m <= F.coalesce("n_citations", F.lit(0))))
    whole = each.groupBy("id").agg(F.count(F.lit(1)).alias("clauses"), F.count("hit").alias("supported_clauses"), F.bool_and(good).alias("cited"))
    shown = safety.assessed(answers, "text").select("id", (F.size("reasons") > 0).alias("odd"))
    out = shown.join(whole, "id", "left").fillna(0, ["clauses", "supported_clauses"])
    fine = ~F.col("odd") & (F.col("clauses") > 0) & (F.col("clauses") == F.col("supported_clauses")) & F.coalesce("cited", F.lit(False))
    return out.select("id", fine.alias("supported"), "clauses", "supported_clauses")
