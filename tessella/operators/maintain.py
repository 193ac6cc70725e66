"""Write-path decisions, conflicts, clustering and sweeps, as batch transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import graph as G

# Thresholds of write-time resolution.
RELATED, DUPLICATE, SUBJECT, STRONG, JOINT, MARGIN = 0.15, 0.85, 0.40, 0.55, 0.45, 0.05


def similar(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """Pairs (new_id, old_id) of token sets (id, tokens) with a Jaccard overlap of at least ``threshold`` > 0; exact.

    Tokens are ordered from rare to frequent.  Two sets that reach the threshold share one
    of the first n - ceil(threshold * n) + 1 tokens of each, so that only those are
    indexed: frequent tokens fall behind.  Sizes that cannot reach it do not meet; the
    others are compared on their whole sets.
    """
    each = lambda df: df.select("id", F.explode("tokens").alias("token"))
    seen = each(old) if new is old else each(old).unionByName(each(new))
    rarity = seen.groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        t = df.select(F.col("id").alias(key), F.size("tokens").alias(f"{key}_n"), F.explode("tokens").alias("token")).join(rarity, "token")
        t = t.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("df", "token")))
        return t.filter(F.col("place") <= F.col(f"{key}_n") - F.ceil(threshold * F.col(f"{key}_n") - 1e-9) + 1).select(key, f"{key}_n", "token")

    fits = F.least("new_id_n", "old_id_n") >= threshold * F.greatest("new_id_n", "old_id_n") - 1e-9
    met = prefix(new, "new_id").join(prefix(old, "old_id"), "token").filter((F.col("new_id") != F.col("old_id")) & fits).select("new_id", "old_id").distinct()
    whole = met.join(new.select(F.col("id").alias("new_id"), F.col("tokens").alias("x")), "new_id").join(old.select(F.col("id").alias("old_id"), F.col("tokens").alias("y")), "old_id")
    return whole.select("new_id", "old_id", T.jaccard(F.col("x"), F.col("y")).alias("overlap")).filter(F.col("overlap") >= threshold)


def decide(pairs: DataFrame) -> DataFrame:
    """The operation for each new row from its neighbours.

    Expects new_id, keyed (the new row names its claim), old_id, old_from, overlap, sim,
    same_key, same_text (as normalised claims) and same_words (but for case and white
    space).  Neighbours of the same claim come before all others, which count from a
    similarity of RELATED on; of those the best has the most overlap, similarity and
    latest time.  The target is null for ADD, and for RELATE between several.
    """
    of = Window.partitionBy("new_id")
    p = pairs.withColumn("claim", F.max(F.col("same_key").cast("int")).over(of)).filter((F.col("claim") == F.col("same_key").cast("int")) & (F.col("same_key") | (F.col("sim") >= RELATED)))
    order = of.orderBy(F.desc("overlap"), F.desc("sim"), F.desc_nulls_last("old_from"), "old_id")
    p = p.withColumns({"n": F.row_number().over(order), "best": F.max("overlap").over(of)})
    strong = (F.col("overlap") >= STRONG) & (F.col("sim") >= JOINT)
    rival = (F.col("n") > 1) & strong & (F.col("best") - F.col("overlap") <= MARGIN + 1e-9)
    top = p.groupBy("new_id").agg(F.max(F.when(F.col("n") == 1, F.struct("overlap", "sim", "same_key", "same_text", "same_words", "keyed", "old_id"))).alias("b"), F.bool_or(rival).alias("unsure"))
    b = F.col("b")
    unsure = F.col("unsure") & ~b["keyed"] & (b["overlap"] >= STRONG) & (b["overlap"] < DUPLICATE) & (b["sim"] >= JOINT) & ~b["same_key"]
    op = (
        F.when(b["same_key"], F.when(b["same_text"], "NOOP").otherwise("INVALIDATE"))
        .when(b["overlap"] >= DUPLICATE, F.when(~b["keyed"], "NOOP").when(b["same_words"], "INVALIDATE").otherwise("RELATE"))
        .when(unsure, "RELATE").when(~b["keyed"] & (b["overlap"] >= STRONG) & (b["sim"] >= JOINT), "INVALIDATE")
        .when(b["overlap"] >= SUBJECT, "RELATE").otherwise("ADD")
    )
    return top.select("new_id", op.alias("op"), F.when((op != "ADD") & ~unsure, b["old_id"]).alias("target"), b["overlap"].alias("overlap"))


# Cue patterns of conflicts, and what a statement looks like (subject, negation, predicate, object).
TEMPORAL = r"(?i)\b(now|currently|as of|from now on|no longer|instead|replaced|switched|migrated|deprecated|supersedes|superseded)\b"
NEGATIVE = r"(?i)\b(no longer|does not|doesn't|do not|don't|never|without|disabled?|disallowed|den(?:y|ies|ied)|forbidden|blocked|deprecated|removed|unsupported)\b"
POSITIVE = r"(?i)\b(uses?|requires?|supports?|allows?|enabled?|must|should|stores?|runs on|prefers?)\b"
NUMBER = r"(?i)\b\d+(?:\.\d+)?\s*(?:ms|s|sec|secs|seconds|m|min|mins|minutes|h|hours|rpm|rps|requests?|%|percent|mb|gb)?\b"
STATEMENT = r"(?i)\b([A-Za-z0-9][A-Za-z0-9_.#/+ -]{1,80}?)\s+(does not|doesn't|do not|don't|no longer\s+)?(uses?|requires?|supports?|stores?|runs on|defaults? to|prefers?|rate limit(?: is)?|timeout(?: is)?|version(?: is)?|is|are)\s+([^.;\n]{1,120})"
OBJECT_END = r"(?i)\b(?:for|because|after|before|with|when|while|during|if)\b"
SAME_SUBJECT, SAME_OBJECT, REFINED = 0.24, 0.55, 0.72


def polarity(text: Column) -> Column:
    """-1 if anything negates, else 1 if anything affirms, else 0."""
    return F.when(text.rlike(NEGATIVE), -1).when(text.rlike(POSITIVE), 1).otherwise(0)


def numbers(text: Column) -> Column:
    """The distinct numbers with their units, without spaces."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, "\\s+", "")))))


def statements(text: Column) -> Column:
    """What a text states, at most eight times: subject and object as token sets, predicate, and whether it is negated."""
    part = lambda k: F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(k))
    rows = F.arrays_zip(part(1).alias("s"), part(2).alias("n"), part(3).alias("p"), part(4).alias("o"))
    made = F.transform(
        rows,
        lambda r: F.struct(
            T.tokens(r["s"]).alias("subject"), (r["n"] != "").alias("negated"),
            F.regexp_replace(F.trim(F.regexp_replace(F.lower(r["p"]), "\\s+", " ")), "s+$", "").alias("predicate"), T.tokens(F.get(F.split(r["o"], OBJECT_END), F.lit(0))).alias("object"),
        ),
    )
    return F.slice(F.filter(made, lambda a: (F.size(a["subject"]) > 0) & (F.size(a["object"]) > 0)), 1, 8)


def contradicts(a: Column, b: Column) -> Column:
    """Whether any statement says of the same subject, with the same predicate, something else or the opposite."""

    def against(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x["object"], y["object"]))
        other = (both / F.greatest(F.lit(1), F.least(F.size(x["object"]), F.size(y["object"]))) < 0.8) & (T.jaccard(x["object"], y["object"]) < SAME_OBJECT)
        return (x["predicate"] == y["predicate"]) & (T.jaccard(x["subject"], y["subject"]) >= 0.5) & ((x["negated"] != y["negated"]) | other)

    return F.exists(a, lambda x: F.exists(b, lambda y: against(x, y)))


def conflicts(pairs: DataFrame, floor: float = SAME_SUBJECT, duplicate: float = 0.82) -> DataFrame:
    """The worst issue of each pair (a newer, b older; texts and token sets on both sides)."""
    a, b = F.col("a_tokens"), F.col("b_tokens")
    pairs = pairs.withColumns({"a_said": statements(F.col("a_text")), "b_said": statements(F.col("b_text"))})
    over = T.jaccard(a, b)
    late = F.col("a_text").rlike(TEMPORAL)
    same = over >= floor
    numeric = same & (F.size(numbers(F.col("a_text"))) > 0) & (F.size(numbers(F.col("b_text"))) > 0) & (numbers(F.col("a_text")) != numbers(F.col("b_text")))
    polar = same & (polarity(F.col("a_text")) * polarity(F.col("b_text")) == -1)
    stated = contradicts(F.col("a_said"), F.col("b_said"))
    inside = F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1))
    refined = (over < duplicate) & (F.size(a) > F.size(b) + 2) & (inside >= REFINED)
    against = F.struct(F.lit(0.0).alias("severity"), F.when(late, 4).otherwise(3).alias("rank"), F.when(late, "obsolete").otherwise("contradiction").alias("kind"))
    issues = F.array(
        F.when(over >= duplicate, F.struct((0.25 + F.least(F.lit(0.15), over - duplicate)).alias("severity"), F.lit(1).alias("rank"), F.lit("duplicate").alias("kind"))),
        F.when(stated, against.withField("severity", F.when(late, 0.9).otherwise(0.82) + 0.12 * over)),
        F.when(polar, against.withField("severity", F.when(late, 0.88).otherwise(0.78))),
        F.when(numeric, against.withField("severity", F.when(late, 0.86).otherwise(0.74))),
        F.when(refined & ~polar & ~numeric & ~stated, F.struct(F.lit(0.42).alias("severity"), F.lit(2).alias("rank"), F.lit("refinement").alias("kind"))),
    )
    worst = F.array_max(F.filter(issues, lambda x: x.isNotNull()))
    return pairs.select("a_id", "b_id", worst.alias("w")).filter("w is not null").select("a_id", "b_id", F.col("w.kind").alias("kind"), F.round("w.severity", 4).alias("severity"))


def clusters(rows: DataFrame, threshold: float) -> DataFrame:
    """id, cluster: components of rows whose token sets overlap by the threshold or more."""
    near = similar(rows, rows, threshold)
    return G.components(near.select(F.col("new_id").alias("src"), F.col("old_id").alias("dst"))).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")


def common_tokens(rows: DataFrame, most: int = 5) -> DataFrame:
    """Tokens of at least max(2, half of the cluster + 1) members, the most frequent first."""
    size = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    t = rows.select("cluster", F.explode("tokens").alias("token")).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("k")).join(size, "cluster")
    t = t.filter(F.col("k") >= F.greatest(F.lit(2), F.expr("n div 2 + 1")))
    return t.withColumn("position", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("k"), "token"))).filter(F.col("position") <= most).select("cluster", "token", "k", "position")


def canonical_names(entities: DataFrame) -> DataFrame:
    """One canonical id, the least, for all entities with the same normalised name."""
    n = entities.withColumn("normalized", T.entity_name(F.col("name")))
    first = n.groupBy("normalized").agg(F.min("id").alias("canonical_id"), F.count(F.lit(1)).alias("members"))
    return n.join(first, "normalized").select("id", "canonical_id", "members")


def import_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, state: new, changed, missing, unchanged, or renamed (same hash under another key)."""
    both = before.select("key", F.col("hash").alias("was")).join(after.select("key", F.col("hash").alias("now")), "key", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    d = both.withColumn("state", state)
    gone = d.filter("state = 'missing'").groupBy(F.col("was").alias("now")).agg(F.min("key").alias("old_key"))
    return d.join(gone, "now", "left").select("key", F.when((F.col("state") == "new") & F.col("old_key").isNotNull(), "renamed").otherwise(F.col("state")).alias("state"))


# How wide scopes are, and how strict labels; a label that is not known is stricter than all.
SCOPE_RANK = {"session": 0, "repo": 1, "workspace": 2, "user": 3}
SENSITIVITY_RANK = {"normal": 0, "sensitive": 1, "secret": 2}


def _rank(ranks: dict[str, int], of: str, other: int | None = None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv])[F.col(of)], F.lit(other))


def promoted(rows: DataFrame, asked: DataFrame, live: Column, now: float) -> DataFrame:
    """What becomes of rows that are asked (id, target) to be widened to a scope: id, state, scope, valid_to, promoted_from, sensitivity, pinned, stability.

    A row is refused (state not_approved, not_live, not_wider, no_repo) if it is not
    trusted, not live, already as wide (user scope is never a target), or has no
    repository to go to; it then stays as it is.  Else it is closed as of now, and a
    successor takes over.  Rows of one text that go to the same place share one successor
    that names them all, in order; no protection is lost: the strictest sensitivity
    (labels that are not known are strictest), any pin, and the greatest stability.
    Each id may be asked for once; ids without a row are ignored.
    """
    mine = rows.join(asked, "id").withColumn("live", live)
    state = (
        F.when(~F.coalesce("trusted", F.lit(False)), "not_approved").when(~F.coalesce("live", F.lit(False)), "not_live")
        .when(F.coalesce((F.col("target") == "user") | (_rank(SCOPE_RANK, "target") <= _rank(SCOPE_RANK, "scope")), F.lit(True)), "not_wider")
        .when((F.col("target") == "repo") & F.col("repo_id").isNull(), "no_repo").otherwise("promoted")
    )
    none = F.lit(None).cast("array<string>").alias("promoted_from"), F.lit(None).cast("string").alias("sensitivity")
    told = mine.withColumn("state", state)
    kept = told.select("id", F.when(F.col("state") == "promoted", "closed").otherwise(F.col("state")).alias("state"), "scope", F.when(F.col("state") == "promoted", F.lit(now)).otherwise(F.col("valid_to")).alias("valid_to"), *none, "pinned", "stability")
    place = ["workspace_id", F.when(F.col("target") == "repo", F.col("repo_id")).alias("to_repo"), "target", F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("body")]
    strict = F.max(F.struct(_rank(SENSITIVITY_RANK, "sensitivity", len(SENSITIVITY_RANK)).alias("rank"), "sensitivity"))
    new = told.filter("state = 'promoted'").groupBy(*place).agg(F.array_sort(F.collect_list("id")).alias("promoted_from"), strict.alias("s"), F.bool_or("pinned").alias("pinned"), F.max("stability").alias("stability"))
    new = new.select(F.concat_ws("_", F.col("promoted_from")[0], "target").alias("id"), F.lit("successor").alias("state"), F.col("target").alias("scope"), F.lit(None).cast("double").alias("valid_to"), "promoted_from", F.col("s.sensitivity").alias("sensitivity"), "pinned", "stability")
    return kept.unionByName(new)
