"""Mixing documents to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic.  The tokens of the cells are
raked to target marginals in turn; a cell's weight over its tokens, divided by the
largest such ratio, is the probability with which each of its documents is sampled,
so that the expected tokens of the sample have the target shares.  The draw depends
only on the id and a seed.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import BROADCAST_ROWS, Scratch, documents, fresh

MARGINS = ("source", "lang", "topic")
#: Target shares are the present shares raised to these powers: below 1, large parts give way to small ones.
POWERS = {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: Raking ends when no weight changes by more than this share within a round, when STALLED rounds have not lowered the
#: change by a tenth (the targets contradict each other), or after so many rounds.
TOLERANCE = 1e-12
STALLED = 3
MOST_ROUNDS = 60
SEED = "mix-1"
NONE = "(none)"
# Signs of a topic, the first that is found; else prose.
TOPICS = {
    "legal": "(?i)licen[sc]e|copyright|warrant",
    "contact": "@|https?:|www\\.",
    "table": " \\| ",
    "numbers": "[0-9]{4}",
    "shouting": "[A-Z]{4}",
}


def topic_of(text: Column) -> Column:
    """The topic of a text by simple signs."""
    out = None
    for name, pattern in TOPICS.items():
        test = text.rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words separated by ASCII white space."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def draw(id_col: Column, seed: str) -> Column:
    """A uniform number from [0, 1) that depends on the id and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / 2.0**52


def rake(cells: DataFrame, scratch: Scratch, margins=MARGINS, targets: dict[str, DataFrame] | None = None, powers=POWERS, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """Cells (the margins, tokens) with weight, tokens raked to the target shares of every margin; and the error left.

    ``targets`` holds tables of a margin's value and its ``share``; for others the share
    is the present one raised to a power.  Values without a target, or with tokens but
    no share, get weight 0.  The error is the largest share by which the last round
    still changed a margin: near 0 if the targets agree, else it stays (targets that
    contradict each other, or that the present cells cannot meet).
    """
    cells = cells.filter("tokens > 0")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for m in margins:
        if targets and m in targets:
            goal = targets[m].select(m, F.col("share").cast("double").alias("goal"))
        else:
            goal = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers[m])).alias("goal"))
        whole = goal.agg(F.sum("goal").alias("whole"))
        goals[m] = scratch.save(goal.join(F.broadcast(whole)).select(m, (F.col("goal") / F.col("whole") * float(total)).alias("goal")), f"goal-{m}")
    weighted = cells.withColumns({"weight": F.col("tokens").cast("double"), "gap": F.lit(0.0)})
    for m in margins:
        weighted = weighted.join(goals[m].withColumnRenamed("goal", f"goal_{m}"), m, "left")
    weighted, step = scratch.save(weighted, "step-0"), 0
    errors: list[float] = []
    for _ in range(rounds):
        # A step reads its weights twice, for the sums and for the cells: each is written, else a round's plan has them eight times.
        for m in margins:
            sums = weighted.groupBy(m).agg(F.sum("weight").alias("held"), F.max(f"goal_{m}").alias("goal"))
            factor = sums.select(m, F.coalesce(F.when(F.col("held") > 0, F.col("goal") / F.col("held")), F.lit(0.0)).alias("factor"))
            gap = F.lit(0.0) if m == margins[0] else F.col("gap")
            moved = {"gap": F.when(F.col("weight") > 0, F.greatest(gap, F.abs(F.col("factor") - 1))).otherwise(gap), "weight": F.col("weight") * F.col("factor")}
            weighted = scratch.save(weighted.join(factor, m).withColumns(moved).drop("factor"), f"step-{step + 1}")
            scratch.drop(f"step-{step}")
            step += 1
        errors.append(weighted.agg(F.max("gap")).first()[0] or 0.0)
        if errors[-1] <= tolerance or len(errors) > STALLED and errors[-1] > 0.9 * errors[-1 - STALLED]:
            break
    weighted = weighted.select(*cells.columns, "weight")
    return weighted, errors[-1] if errors else 0.0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic=topic_of, targets: dict[str, DataFrame] | None = None, powers=POWERS, rounds: int = MOST_ROUNDS, seed: str = SEED, strict: bool = False) -> DataFrame:
    """The documents with topic, tokens, probability and sampled.

    ``topic`` is the name of a column that holds topics (of a classifier, or given), or
    a function of the text's column; the default reads simple signs in the text.
    Targets that cannot all be met are an error if ``strict``; else a warning names what
    is left, and the last margin is met.

    A null source or language is a value of its own, ``(none)``; a null text has no
    tokens and the topic prose.  Documents without tokens count in no cell and are never
    sampled (probability 0).  Repeated rows are drawn alike; null ids are drawn as one id.
    The columns of the documents are kept, but for any with the names that are added.  An
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of_topic = F.coalesce(F.col(topic).cast("string"), F.lit(NONE)) if isinstance(topic, str) else topic(text)
    docs = docs.withColumn(held := fresh("topic"), of_topic)
    of_topic = F.col(held)
    rows = docs.drop("topic", "tokens", "probability", "sampled", "cell_source", "cell_lang").withColumns({"topic": of_topic, "tokens": tokens_of(text), "cell_source": F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)), "cell_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE))})
    cells = rows.groupBy(F.col("cell_source").alias("source"), F.col("cell_lang").alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))
    cells = scratch.save(cells, "cells")
    weighted, error = rake(cells, scratch, targets=targets, powers=powers, rounds=rounds)
    if error > 1e-6:
        said = f"the target weights cannot all be met: margins still change by {error:.3g} of their size"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    ratio = F.col("weight") / F.col("tokens")
    most = weighted.agg(F.max(ratio)).first()[0] or 1.0
    chance = weighted.select(F.col("source").alias("cell_source"), F.col("lang").alias("cell_lang"), "topic", (ratio / most).alias("probability"))
    if chance.count() <= BROADCAST_ROWS:
        chance = F.broadcast(chance)
    out = rows.join(chance, ["cell_source", "cell_lang", "topic"], "left")
    p = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    kept = [c for c in docs.columns if c not in (held, "topic", "tokens", "probability", "sampled", "cell_source", "cell_lang")]
    return out.select(*kept, "topic", "tokens", p.alias("probability"), (draw(F.col(id_col), seed) < p).alias("sampled"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their sampling probabilities and draws, raked until no margin changes."""
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "sampled")


def _sql() -> str:
    topic = "CASE " + " ".join(f"WHEN regexp_matches(body, '{p}') THEN '{t}'" for t, p in TOPICS.items()) + " ELSE 'prose' END"
    steps = [
        "t AS (SELECT doc_id, source, lang, coalesce(text, '') AS body FROM documents)",
        f"d AS (SELECT doc_id, source, lang, coalesce(source, '{NONE}') AS s, coalesce(lang, '{NONE}') AS l, {topic} AS topic, CAST(len(list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM t)",
        "c AS (SELECT s, l, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
        "total AS (SELECT sum(tokens)::DOUBLE AS n FROM c)",
    ]
    names = dict(zip(MARGINS, ("s", "l", "topic"), strict=True))
    for m, c in names.items():
        steps.append(f"goal_{c} AS (SELECT {c}, g / sum(g) OVER () * (SELECT n FROM total) AS goal FROM (SELECT {c}, pow(sum(tokens)::DOUBLE, {POWERS[m]}) AS g FROM c GROUP BY {c}))")
    last = "w0"
    steps.append("w0 AS (SELECT *, tokens::DOUBLE AS w FROM c)")
    k = 0
    # All rounds, as SQL here does not stop: once the margins are met, a further round changes nothing.
    for _ in range(MOST_ROUNDS):
        for c in names.values():
            k += 1
            steps.append(f"w{k} AS MATERIALIZED (SELECT s, l, topic, tokens, w * goal / held AS w FROM {last} JOIN goal_{c} USING ({c}) JOIN (SELECT {c}, sum(w) AS held FROM {last} GROUP BY {c}) USING ({c}))")
            last = f"w{k}"
    steps.append(f"p AS (SELECT s, l, topic, w / tokens / max(w / tokens) OVER () AS p FROM {last})")
    steps.append(f"r AS (SELECT d.*, CASE WHEN d.tokens > 0 THEN coalesce(p.p, 0) ELSE 0 END AS p, ('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 13))::BIGINT / pow(2, 52) AS u FROM d LEFT JOIN p USING (s, l, topic))")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, tokens, round(p, 9) AS probability, u < p AS sampled FROM r"


OP3_SQL = _sql()
