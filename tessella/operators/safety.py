"""Signs of poisoned payloads in canonical text, and the quarantine that follows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.text import once

POLICY = "deterministic-v3"

# Patterns of payload signals.
SIGNALS = {
    "instruction_override": r"(?i)\b(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+|any\s+|the\s+|previous\s+){0,3}(?:instructions?|rules?|prompts?|system\s+(?:messages?|prompts?))\b",
    "privilege_impersonation": r"(?i)(?:^|\s|;)\s*(?:system|developer|assistant)\s*(?:message|prompt|instructions?)\s*[:\-]",
    "secret_exfiltration": r"(?is)\b(?:reveal|exfiltrate|send|upload|export|print|display)\b.{0,96}?\b(?:secrets?|credentials?|passwords?|api[ _-]?keys?|tokens?|environment(?:\s+variables?)?|\.env)\b",
    "concealed_action": r"(?i)\b(?:do\s+not|don't|never)\s+(?:tell|inform|mention|show|notify)\s+(?:the\s+)?(?:user|owner|operator)\b",
    "deferred_instruction": r"(?is)\b(?:when|if)\s+(?:a\s+)?(?:later|future|next)\s+(?:session|agent|request)\b.{0,160}?\b(?:ignore|disregard|override)\b",
    "attack_canary_marker": r"(?i)\batk_[a-z0-9_]*canary\b",
}
#: Words of which a text with the signal has at least one: looked for before the pattern is tried.
NEEDED = {
    "instruction_override": ["instruction", "rule", "prompt", "message"],
    "privilege_impersonation": ["system", "developer", "assistant"],
    "secret_exfiltration": ["secret", "credential", "password", "api", "token", "environment", ".env"],
    "concealed_action": ["user", "owner", "operator"],
    "deferred_instruction": ["later", "future", "next"],
    "attack_canary_marker": ["canary"],
}
# Words that letters set apart by spaces are put together to.
SPACED_WORDS = [
    "ignore", "disregard", "forget", "override", "bypass", "all", "any", "the", "previous", "instruction", "instructions", "rule", "rules", "prompt", "prompts",
    "system", "message", "messages", "reveal", "exfiltrate", "send", "upload", "export", "print", "display", "secret", "secrets", "credential", "credentials",
    "password", "passwords", "api", "key", "keys", "token", "tokens", "environment", "variable", "variables", "do", "not", "dont", "never", "tell", "inform", "mention",
    "show", "notify", "user", "owner", "operator", "when", "if", "later", "future", "next", "session", "agent", "request",
]
# Letters of other scripts that look like ASCII ones.  Full-width, mathematical and ligature forms are no
# part of it: normal forms turn those into ASCII.
LOOKALIKES = {
    "a": "ɑαа", "b": "ƅьᏏβв", "c": "ᴄϲсⲥ", "d": "ԁᏧ", "e": "еҽꬲε", "f": "ꬵꞙẝք", "g": "ɡᶃƍց", "h": "һհᏂн", "i": "ıɩɪιіӏꙇ", "j": "ϳј", "k": "кκ", "l": "ǀاוןΙІⲒ",
    "m": "мμ", "n": "ոռη", "o": "ᴏᴑοσоօⲟסه", "p": "ρϱрⲣ", "q": "ԛգզ", "r": "ꭇꭈᴦⲅгꮁ", "s": "ꜱƽѕꮪ", "t": "тτ", "u": "ᴜꞟʋυսꭎꭒ", "v": "ᴠνѵטꮩ", "w": "ɯᴡѡԝաꮃ", "x": "хχ×", "y": "ɣᶌγуүყỿꭚ", "z": "ᴢꮓζ",
}
SPACED = re.compile(r"(?<!\w)(?:[a-z][ \t]+){2,}[a-z](?!\w)")
LONGEST = max(map(len, SPACED_WORDS))


class _Visible(dict):
    """For str.translate: what stays of a character; format characters become ``gap``, marks and controls go, space controls are spaces."""

    def __init__(self, gap: str):
        super().__init__()
        self.gap = gap

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf":
            out = self.gap
        elif kind == "Cc":
            out = " " if c.isspace() else ""
        else:
            out = "" if kind in ("Mn", "Mc", "Me") else c
        self[code] = out
        return out


_JOINED, _PARTED = _Visible(""), _Visible(" ")
_SKELETON = {ord(c): letter for letter, others in LOOKALIKES.items() for c in others}


def _spelled(letters: str, words: frozenset[str]) -> list[tuple[int, int]]:
    """Where words of the list are in letters: with as few letters left over as can be, then in as few words, each as long as can be.

    From the end: the best way on from a place is a word and the best way on from its end, or a letter that is left over.
    """
    n = len(letters)
    over = n + 1  # one letter left over counts more than any number of words
    cost = [0] * (n + 1)
    ends = lambda k: (e for e in range(min(n, k + LONGEST), k, -1) if letters[k:e] in words)
    for k in range(n - 1, -1, -1):
        cost[k] = min((cost[e] + 1 for e in ends(k)), default=cost[k + 1] + over)
        cost[k] = min(cost[k], cost[k + 1] + over)
    out, k = [], 0
    while k < n:
        e = next((e for e in ends(k) if cost[k] == cost[e] + 1), None)
        if e:
            out.append((k, e))
        k = e or k + 1
    return out


def segmented(letters: str, words: frozenset[str] = frozenset(SPACED_WORDS)) -> list[str] | None:
    """The letters as words of the list, all of them, in as few as can be, the first as long as can be; None if it cannot be done."""
    out = [letters[a:b] for a, b in _spelled(letters, words)]
    return out if sum(map(len, out)) == len(letters) else None


def _together(match: re.Match, words: frozenset[str] = frozenset(SPACED_WORDS)) -> str:
    """The words of a run of letters put together; letters of none, as those of the text before it, stay apart."""
    run = match[0]
    letters = "".join(run.split())
    at = [i for i, c in enumerate(run) if not c.isspace()]
    out, done, last = [], 0, None
    for a, b in _spelled(letters, words):
        out += [" " if a == last else run[done : at[a]], letters[a:b]]
        done, last = at[b - 1] + 1, b
    return "".join(out) + run[done:]


def canonical(text: str, visible: _Visible = _JOINED) -> str:
    """Text as it is read: compatibility forms and accents, marks, format and control characters undone, lookalikes as
    ASCII letters, and letters set apart by spaces put together where they make words of the list."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
    text = text.translate(visible)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold().translate(_SKELETON)
    return SPACED.sub(_together, text.casefold())


@F.pandas_udf(StructType([StructField("joined", StringType()), StructField("parted", StringType())]))
def _canonical_forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        joined = [None if t is None else canonical(t) for t in texts]
        parted = [None if t is None else canonical(t, _PARTED) for t in texts]
        yield pd.DataFrame({"joined": joined, "parted": [b if b != a else None for a, b in zip(joined, parted, strict=True)]})


def canonical_forms(text: Column) -> Column:
    """joined and parted: canonical text with format characters dropped, or as spaces (null where that is the same).

    Most texts are plain: those go without Python, as they only need lower case and no controls.
    """
    gap = r"[\x00-\x20\x7f]+"  # as controls go or become spaces
    odd = text.rlike(r"[^\x00-\x7F]") | text.rlike(f"(?i)(?<![a-z0-9_])[a-z]{gap}[a-z]{gap}[a-z](?![a-z0-9_])")
    plain = F.lower(F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", " " * 9), r"[\x00-\x1f\x7f]", ""))
    forms = _canonical_forms(F.when(odd, text))
    return F.when(odd, forms).otherwise(F.struct(plain.alias("joined"), F.lit(None).cast("string").alias("parted")))


def signals(text: Column) -> dict[str, Column]:
    """A column for every signal: whether canonical text (``canonical_forms``) has it in one of its forms."""

    def shown(form: Column, name: str) -> Column:
        some = F.lit(False)
        for word in NEEDED[name]:
            some |= F.contains(form, F.lit(word))
        return F.coalesce(some & form.rlike(SIGNALS[name]), F.lit(False))

    return {name: shown(text["joined"], name) | shown(text["parted"], name) for name in SIGNALS}


def assessed(rows: DataFrame, text_col: str, title_col: str | None = None, sticky: str | None = None) -> DataFrame:
    """rows with reasons (sorted codes, an empty array for none): the signals of title and text.

    A row whose boolean column ``sticky`` is true keeps its quarantine, whatever its text
    says now: its reason is inherited_quarantine.  Null texts have no signals.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.concat(F.coalesce(F.col(title_col), F.lit("")), F.lit("\n"), text) if title_col else F.concat(F.lit("\n"), text)
    shown = lambda forms: F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in signals(forms).items()])))
    codes = once(canonical_forms(raw), shown)  # a filter by reasons would otherwise make the forms anew at each of its uses
    if sticky:
        codes = F.when(F.coalesce(F.col(sticky), F.lit(False)), F.array(F.lit("inherited_quarantine"))).otherwise(codes)
    return rows.withColumn("reasons", codes)


def quarantined(rows: DataFrame, trusted: str = "trusted", review_state: str = "review_state") -> DataFrame:
    """Assessed rows with the records of their quarantine: whatever they claimed, rows with reasons are not trusted.

    provenance has trusted, quarantined, review_state, quarantine_policy and
    quarantine_reasons, quarantine has state, policy and reasons (null if there are none:
    such rows keep what they claimed).
    """
    bad = F.size("reasons") > 0
    none = F.lit(None).cast("string")
    provenance = F.struct(
        F.when(bad, False).otherwise(F.col(trusted)).alias("trusted"), bad.alias("quarantined"), F.when(bad, "quarantined").otherwise(F.col(review_state)).alias("review_state"),
        F.when(bad, POLICY).otherwise(none).alias("quarantine_policy"), F.when(bad, F.col("reasons")).alias("quarantine_reasons"),
    )
    record = F.when(bad, F.struct(F.lit("quarantined").alias("state"), F.lit(POLICY).alias("policy"), F.col("reasons")))
    return rows.withColumn("provenance", provenance).withColumn("quarantine", record)


def prompt_eligible(provenance: Column) -> Column:
    """Whether a record may be shown to a model: trusted, approved, and not quarantined; null is no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(provenance["trusted"]) & yes(provenance["review_state"] == "approved") & ~yes(provenance["quarantined"])


def inspection_eligible(provenance: Column) -> Column:
    """Whether a record may be found by search that no model reads: unless it is quarantined."""
    return ~F.coalesce(provenance["quarantined"], F.lit(False))


def edge_eligible(provenance: Column) -> Column:
    """Whether a walk for a prompt may use an edge: a claim that is there must be good, one that is missing is no objection."""
    return F.coalesce(provenance["trusted"], F.lit(True)) & inspection_eligible(provenance) & (F.coalesce(provenance["review_state"], F.lit("approved")) == "approved")
