"""Evidence packed into a hard token budget, query by query.

Candidates are what a search returned, a bounded list for each query: a query is one
group, and the queries are what is spread over the cluster.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Count = Callable[[str], int]

_TOKEN = re.compile(r"\w+|[^\w\s]")
_BREAK = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_SYMBOL = re.compile(r"(?:\w+[./\\])+\w+|::|->|\b[A-Za-z_]\w*\(\)")
# Words that ask for what lies between things, and words that limit what a sentence says.
BRIDGE = frozenset(["call", "calls", "called", "caller", "dependency", "depends", "flow", "graph", "impact", "path", "related", "relationship", "why"])
QUALIFIERS = frozenset(["cannot", "except", "if", "must", "never", "no", "not", "only", "unless", "until", "when", "without"])
CUT = " […]"


def regex_count(text: str) -> int:
    """Words and single marks."""
    return len(_TOKEN.findall(text or ""))


def terms(text: str) -> frozenset[str]:
    return frozenset(w.casefold() for w in re.findall(r"\w+", text or ""))


def families(keys: list[set[str]]) -> list[int]:
    """For each of several sets of keys the least index that it is linked to by shared keys, over any number of steps."""
    up = list(range(len(keys)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    first: dict[str, int] = {}
    for k, mine in enumerate(keys):
        for key in mine:
            a, b = sorted((top(k), top(first.setdefault(key, k))))
            up[b] = a
    return [top(k) for k in range(len(keys))]


def _keys(row: dict) -> set[str]:
    """What makes rows one family: their own id, the ids that they replace or digest, and the claim that they make."""
    out = {f"id\0{row['id']}"} | {f"id\0{x}" for x in row["supersedes"] if x}
    kind = (row["claim_kind"] or "").strip()
    for name in ("subject_key", "claim_key", "consolidation_family"):
        if value := (row[name] or "").strip():
            out.add("\0".join((name, value, kind) if name == "subject_key" else (name, value)))
    return out


def fitted(text: str, room: int, count: Count, fits: Callable[[str], bool] = lambda _: True) -> str:
    """The longest beginning of a text within ``room`` that keeps all its qualifiers, cut after a token, or within one if
    no token fits whole; empty if there is none.  Counters need not add up: every cut is counted as it is."""
    need = terms(text) & QUALIFIERS
    ends = [m.end() for m in _TOKEN.finditer(text)]
    if room <= 0 or not ends:
        return ""

    def cut(end: int, mark: bool) -> str:
        bare = text[:end].rstrip()
        return bare + CUT if mark and bare and count(bare + CUT) <= room else bare

    def good(s: str) -> bool:
        return bool(s) and count(s) <= room and fits(s)

    for k in range(min(len(ends), room), 0, -1):
        s = cut(ends[k - 1], k < len(ends) and room > 1)
        if good(s) and need <= terms(s):
            return s
    low, high, best = 1, len(text), ""
    while low <= high:
        mid = (low + high) // 2
        s = cut(mid, mid < len(text))
        if not s or good(s):
            best = s if s and need <= terms(s) else best
            low = mid + 1
        else:
            high = mid - 1
    return best


def best_sentences(text: str, asked: frozenset[str], room: int, count: Count) -> str:
    """The sentences that answer best, in their order.  Those with qualifiers go first, and others only if all of them are
    in: without its limits a text could say the opposite.  Left-out sentences leave a mark."""
    parts = [s.strip() for s in _BREAK.split(text) if s.strip()]
    if not parts:
        return ""
    of = [terms(s) for s in parts]
    order = sorted(range(len(parts)), key=lambda k: (-len(of[k] & asked), -len(of[k] & QUALIFIERS), k))
    held: list[int] = []
    for limited in (True, False):
        mine = [k for k in order if bool(of[k] & QUALIFIERS) is limited]
        for k in mine:
            tried = " ".join(parts[x] for x in sorted((*held, k)))
            if count(tried + CUT * (len(held) + 1 < len(parts))) <= room:
                held.append(k)
        if limited and len(held) < len(mine):
            break
    if not held:
        return fitted(parts[next((k for k in order if of[k] & QUALIFIERS), order[0])], room, count)
    out = " ".join(parts[k] for k in sorted(held))
    return out + CUT if len(held) < len(parts) and count(out + CUT) <= room else out


def _stands_for(summary: str, full: str, asked: frozenset[str]) -> bool:
    """Whether a summary keeps the text's qualifiers, and some of the query's words if the text has any."""
    whole, brief = terms(full), terms(summary)
    return not full or ((not whole & asked or bool(brief & whole & asked)) and whole & QUALIFIERS <= brief)


def excerpt(row: dict, asked: frozenset[str], room: int, count: Count) -> tuple[str, bool, str]:
    """What to show of a row within ``room``: text, whether something is left out, and why this text."""
    full, summary = (row["content"] or "").strip(), (row["summary"] or "").strip()
    bridge = row["arm"] in ("graph", "code")
    if summary and _stands_for(summary, full, asked):
        if count(summary) <= room:
            return summary, summary != full, "summary"
        some = best_sentences(summary, asked, room, count)
        if some and _stands_for(some, full, asked):
            return some, True, "summary_excerpt"
    if full and count(full) <= room:
        return full, False, "bridge_evidence" if bridge else "full"
    some = best_sentences(full or summary, asked, room, count)
    if some:
        return some, True, "bridge_excerpt" if bridge else "relevant_sentence_excerpt"
    some = fitted(full or summary, room, count)
    return some, bool(some), "token_boundary_excerpt"


def packed_query(rows: list[dict], query: str, budget: int, count: Count = regex_count) -> tuple[str, list[dict], int]:
    """The context of one query, what is in it, and the tokens of all that was found.

    Of each family the best row stays (ties: the greater id).  Each step takes the row of
    the greatest .7 score + .25 share of the query's words that are new + .2 for graph or
    code rows if the query asks for connections + .05 / sqrt(tokens); ties go to the
    greater score, then the lesser id.  A row that does not fit even as an excerpt is passed over.
    """
    source = sum(count(f"{r['title'] or ''}\n{r['content'] or ''}") for r in rows)
    best: dict[int, dict] = {}
    for r, family in zip(rows, families([_keys(r) for r in rows]), strict=True):
        if family not in best or (r["score"], r["id"]) > (best[family]["score"], best[family]["id"]):
            best[family] = r
    asked = terms(query)
    joins = bool(asked & BRIDGE or _SYMBOL.search(query))
    left = []
    for r in best.values():
        text = f"{r['title'] or ''} {r['summary'] or r['content'] or ''}"
        fixed = 0.7 * max(0.0, r["score"]) + (0.2 if joins and r["arm"] in ("graph", "code") else 0.0) + 0.05 / math.sqrt(max(1, count(text)))
        left.append((r, fixed, terms(text) & asked))
    context, out, covered = "", [], frozenset()
    while left and budget > 0:
        k = min(range(len(left)), key=lambda k: (-(left[k][1] + 0.25 * len(left[k][2] - covered) / max(1, len(asked))), -max(0.0, left[k][0]["score"]), left[k][0]["id"]))
        r = left.pop(k)[0]
        title = " ".join((r["title"] or "").split())[:120]
        base = "\n\n".join(x for x in (context, f"[{len(out) + 1}] {title}".strip()) if x) + "\n"
        room = budget - count(base)
        if room <= 0:
            continue
        shown, less, why = excerpt(r, asked, room, count)
        if shown and count(base + shown) > budget:
            shown, less, why = fitted(shown, room, count, lambda s, base=base: count(base + s) <= budget), True, "token_boundary_excerpt"
        if not shown:
            continue
        context = base + shown
        out.append({"id": r["id"], "position": len(out) + 1, "excerpt": shown, "tokens": count(shown), "truncated": less, "reason": why})
        covered |= terms(shown) & asked
    return context, out, source


_FIELDS = {"id": "string", "score": "double", "arm": "string", "title": "string", "content": "string", "summary": "string", "subject_key": "string", "claim_kind": "string", "claim_key": "string", "consolidation_family": "string", "supersedes": "array<string>"}
PACKED = {
    "query_id": "string", "context": "string", "packed": "array<struct<id: string, position: int, excerpt: string, tokens: int, truncated: boolean, reason: string>>",
    "budget_tokens": "int", "context_tokens": "int", "source_tokens": "int", "saved_tokens": "int", "savings_ratio": "double", "packed_count": "int", "omitted_count": "int",
}


def pack_context(candidates: DataFrame, queries: DataFrame, budget: int, count: Count = regex_count, most: int = 200) -> DataFrame:
    """One row for every query (query_id, query) with candidates: its context, what is in it, and what that saves.

    candidates have query_id, id, score and content; arm, title, summary, subject_key,
    claim_kind, claim_key, consolidation_family and supersedes (ids that a row replaces,
    or was made of) may be missing or null.  ``most`` is the length of a result list, the
    best by score and id: packing is a step after a top-k.  Scores that are no number
    count as 0.  ``count`` says how many tokens a text has; it need not add up.
    """
    have = [F.col(c).cast(t).alias(c) if c in candidates.columns else F.lit(None).cast(t).alias(c) for c, t in _FIELDS.items()]
    rows = candidates.filter(F.col("id").isNotNull()).select(F.col("query_id").cast("string").alias("query_id"), *have).withColumns({"score": F.nanvl(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), "supersedes": F.coalesce("supersedes", F.array().cast("array<string>"))})
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.coalesce("query", F.lit("")).alias("query")).dropDuplicates(["query_id"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        context, packed, source = packed_query(frame.astype(object).where(frame.notna(), None).to_dict("records"), frame["query"].iloc[0], budget, count)
        used = count(context)
        saved = max(0, source - used)
        return pd.DataFrame([(frame["query_id"].iloc[0], context, packed, budget, used, source, saved, saved / source if source else 0.0, len(packed), len(frame) - len(packed))], columns=list(PACKED))

    return top.join(asked, "query_id").groupBy("query_id").applyInPandas(solve, ", ".join(f"{k} {v}" for k, v in PACKED.items()))
