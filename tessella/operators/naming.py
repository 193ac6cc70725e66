"""Spellings of entity names, and phrases in texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.operators import graph as G
from tessella.operators.maintain import similar


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed; null stays null.  (Spark has no normal forms of its own.)"""
    return names.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()), na_action="ignore")


def token_set(name: Column) -> Column:
    """ASCII letter and digit tokens of two or more characters, for blocking."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)))


def compact(name: Column) -> Column:
    """The folded name without white space, punctuation kept."""
    return F.regexp_replace(folded(name), "\\s+", "")


def punctuation(name: Column) -> Column:
    """What is neither letter, digit nor space: names that differ in it are different."""
    return F.regexp_replace(folded(name), "[\\p{L}\\p{N}\\s]+", "")


def phrase_mentions(docs: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name) for every name that a text holds between characters that are no word's.

    A name is looked up by its longest word, so that only texts with that word are
    searched for the whole phrase; names without a letter or digit are left out.  Words
    meet names without the texts; each text then meets its candidates once, and is
    searched where it is.  Rows that repeat an id, and null ids, are rows of their own.
    """
    split = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}_]+"), lambda t: t != "")
    keys = names.select("name").distinct().withColumn("words", split(F.col("name"))).filter("size(words) > 0")
    keys = keys.select("name", F.array_max(F.transform("words", lambda t: F.struct(F.length(t).alias("n"), t.alias("word"))))["word"].alias("word"))
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"), F.xxhash64(id_col, text_col).alias("key"))
    held = rows.select("key", F.explode(F.array_distinct(split(F.col("low")))).alias("word")).join(keys, "word").groupBy("key").agg(F.collect_set("name").alias("names"))

    def there(name: Column) -> Column:
        quoted = F.concat(F.lit("(?<![\\p{L}\\p{N}_])"), F.regexp_replace(F.lower(name), r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit("(?![\\p{L}\\p{N}_])"))
        return F.contains("low", F.lower(name)) & F.regexp_like("low", quoted)

    return rows.join(held, "key").select(F.col("id").alias(id_col), F.explode(F.filter("names", there)).alias("name"))


def escaped(text: str, mark: str = "!") -> str:
    """A literal for LIKE: the wildcards and the mark itself are marked."""
    return re.sub(f"([%_{re.escape(mark)}])", rf"{mark}\1", text)


#: Share of the larger token set that two spellings of one name have in common.
SAME_TOKENS = 0.6


def canonical_entities(entities: DataFrame, least: float = SAME_TOKENS) -> DataFrame:
    """id, canonical_id, method and members for entities (id, workspace, etype, name, canonical_id as given or null).

    Within a workspace and type, names are one entity if they are equal when folded, or
    but for white space, or if they share ``least`` of the larger token set and have the
    same punctuation, which keeps C++ and C# apart; also whatever a given canonical_id
    ties together.  Links are closed over any number of steps.  Of a group the least given
    canonical_id that is not itself given another stands, else the least id.  The method
    is identity, exact_normalized (equal folded names only) or closure; members counts
    the group's entities.  Ids must be distinct; null names are entities of their own.

    Equal names and equal token sets are one row before any pair is looked at, and pairs
    come from the rarest tokens of a set (``maintain.similar``), within their scope.
    """
    ids = entities.schema["id"].dataType
    none = F.lit("")
    scope = F.to_json(F.array(F.coalesce(F.col("workspace").cast("string"), none), F.coalesce(F.col("etype").cast("string"), none)))
    name = F.coalesce(folded("name"), F.concat(F.lit("\0"), F.col("id").cast("string")))
    rows = G.cut(entities.select("id", scope.alias("scope"), name.alias("name"), F.col("canonical_id").cast(ids).alias("given")))
    exact = rows.groupBy("scope", "name").agg(F.min("id").alias("node"))
    signed = exact.select("scope", "node", F.regexp_replace("name", "\\s+", "").alias("compact"), F.regexp_replace("name", "[\\p{L}\\p{N}\\s]+", "").alias("marks"), token_set(F.col("name")).alias("tokens"))
    signed = G.cut(signed.filter(~F.startswith("compact", F.lit("\0"))))

    def to_least(rows: DataFrame, *keys: str) -> DataFrame:
        head = rows.groupBy(*keys).agg(F.min("node").alias("dst"))
        return rows.join(head, list(keys)).select(F.col("node").alias("src"), "dst")

    sets = signed.filter("size(tokens) > 0").groupBy("scope", "marks", "tokens").agg(F.min("node").alias("id"))
    sets = G.cut(sets.select("id", F.transform("tokens", lambda t: F.concat_ws("\0", "scope", "marks", t)).alias("tokens")))
    # Sets that share so much of the larger one have at least this Jaccard overlap.
    close = similar(sets, sets, least / (2 - least)).filter("new_id < old_id").select("new_id", "old_id")
    a, b = (sets.select(F.col("id").alias(k), F.col("tokens").alias(t)) for k, t in (("new_id", "x"), ("old_id", "y")))
    shared = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"))
    close = close.join(a, "new_id").join(b, "old_id").filter(shared >= least - 1e-9).select(F.col("new_id").alias("src"), F.col("old_id").alias("dst"))
    node_of = G.cut(rows.join(exact, ["scope", "name"]).select("id", "node", "given"))
    told = node_of.filter("given is not null and given <> id").select("node", "given").join(node_of.select(F.col("id").alias("given"), F.col("node").alias("other")), "given", "left")
    told = told.select(F.col("node").alias("src"), F.coalesce("other", "given").alias("dst"))
    equal = to_least(signed, "scope", "compact").unionByName(to_least(signed.filter("size(tokens) > 0"), "scope", "marks", "tokens"))
    links = equal.unionByName(close).unionByName(told).filter("src <> dst").distinct()
    group = G.components(links)
    placed = G.cut(node_of.join(group, "node", "left").select("id", "node", "given", F.coalesce("component", "node").alias("group")))
    roots = placed.filter("given is not null").select("group", "given").join(placed.select(F.col("id").alias("given"), F.col("given").alias("further")), "given", "left")
    roots = roots.groupBy("group").agg(F.min(F.when(F.col("further").isNull() | (F.col("further") == F.col("given")), F.col("given"))).alias("root"), F.min("given").alias("any"))
    whole = placed.groupBy("group").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    method = F.when(F.col("members") == 1, "identity").when(F.col("lo") == F.col("hi"), "exact_normalized").otherwise("closure")
    out = placed.select("id", "group").join(whole.join(roots, "group", "left"), "group")
    return out.select("id", F.coalesce("root", "any", "least").alias("canonical_id"), method.alias("method"), "members")
