"""Documents as chunks of whole blocks, by their places in the text.

A chunk is a piece of its text as it stands: ``text[first:last]`` (a piece of a code block
too long for one chunk also gets the fences that make it a block again).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP = 256, 32
#: Characters of a code block that one chunk may hold.
MOST_CODE = 100_000

_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*$")
_FENCE = re.compile(r"\s*(```+|~~~+)")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])\s+\S")
_ROW = re.compile(r"\s*\|.*\|\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


class Block(NamedTuple):
    kind: str  # heading, code, list, table, prose
    path: str
    first: int
    last: int


class Chunk(NamedTuple):
    kind: str
    path: str
    first: int
    last: int
    before: str = ""
    after: str = ""


def quarter(text: str) -> int:
    """A quarter of the characters after collapsing white space, at least 1; 0 for blank text."""
    n = len(" ".join(text.split()))
    return max(1, round(n / 4)) if n else 0


def blocks(text: str) -> Iterator[Block]:
    """The blocks of a text, line by line.

    The state is what the last line was in: a fence runs to one of its own mark (or the
    end), rows of a table and items of a list go on while lines are alike or indented,
    prose until a blank line, a heading, a fence, an item or a row.
    """
    stack: list[tuple[int, str]] = []
    state, fence, begin, end, at = "", "", 0, 0, 0
    for line in text.splitlines(keepends=True):
        here, at = at, at + len(line)
        path = " > ".join(t for _, t in stack)
        if state == "code":
            end = here + len(line.rstrip()) if line.strip() else end
            if line.strip().startswith(fence):
                yield Block("code", path, begin, end)
                state = ""
            continue
        opened, heading = _FENCE.match(line), _HEADING.match(line)
        if opened:
            new = "code"
        elif heading:
            new = "heading"
        elif not line.strip():
            new = ""
        elif _ROW.match(line):
            new = "table"
        elif _ITEM.match(line):
            new = "list"
        else:
            new = "list" if state == "list" and line[0] in " \t" else "prose"
        if state and new != state:
            yield Block(state, path, begin, end)
            state = ""
        if not new:
            continue
        if new == "heading":
            level = len(heading[1])
            stack = [x for x in stack if x[0] < level] + [(level, heading[2].strip())]
            yield Block("heading", " > ".join(t for _, t in stack), here, here + len(line.rstrip()))
            continue
        if not state:
            state, begin = new, here + len(line) - len(line.lstrip())
            if new == "code":
                fence = opened[1][:3]
        end = here + len(line.rstrip())
    if state:
        yield Block(state, " > ".join(t for _, t in stack), begin, end)


def _pieces(text: str, block: Block, target: int, count: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    """Parts of a block, none over the target: its lines (of tables and lists) or sentences, and of longer ones as many words as fit, or characters."""
    ends = [m.end() for m in (re.compile(r"\n") if block.kind in ("table", "list") else _SENTENCE).finditer(text, block.first, block.last)]
    at = block.first
    for end in (*ends, block.last):
        stop = end - (len(text[at:end]) - len(text[at:end].rstrip()))
        while stop > at and count(text[at:stop]) > target:
            low, high = at + 1, stop
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if count(text[at:mid]) <= target else (low, mid - 1)
            space = text.rfind(" ", at + 1, low + 1)
            cut = space if space > at and count(text[at:space]) <= target else low
            yield at, cut
            at = cut + len(text[cut:stop]) - len(text[cut:stop].lstrip())
        if stop > at:
            yield at, stop
        at = end


def _tail(text: str, first: int, last: int, overlap: int, count: Callable[[str], int]) -> int:
    """Where the last whole sentences of text[first:last] begin that are within the overlap; last if there are none."""
    out = last
    for begin in [m.end() for m in _SENTENCE.finditer(text, first, last)][::-1]:
        if count(text[begin:last]) > overlap:
            break
        out = begin
    return out


def _code(text: str, block: Block, most: int) -> Iterator[Chunk]:
    body = text[block.first : block.last]
    if len(body) <= most:
        yield Chunk("code", block.path, block.first, block.last)
        return
    head = body.find("\n") + 1 or len(body)
    mark = _FENCE.match(body)[1]
    closing = body.rfind("\n") + 1
    closed = closing > head - 1 and body[closing:].strip().startswith(mark[:3])
    opening = body[:head].rstrip("\n") if head < most // 2 else mark
    at, end = block.first + (head if head < most // 2 else 0), block.first + (closing if closed else len(body))
    room = max(1, most - len(opening) - len(mark) - 2)
    while at < end:
        stop = min(at + room, end)
        if stop < end and (line := text.rfind("\n", at, stop) + 1) > at:
            stop = line
        yield Chunk("code", block.path, at, stop, opening + "\n", ("" if text[stop - 1] == "\n" else "\n") + mark)
        at = stop


def chunks(text: str, target: int = TARGET, overlap: int = OVERLAP, count: Callable[[str], int] = quarter, most_code: int = MOST_CODE) -> Iterator[Chunk]:
    """Chunks of at most ``target`` tokens: the blocks under one heading are packed in their order, and a chunk begins with the
    last sentences of the one before, as far as ``overlap`` goes and room is.

    A heading begins a chunk; code is a chunk of its own, whatever its tokens, in fenced pieces of ``most_code``
    characters.  A block over the target is cut between its lines or sentences, a longer
    sentence between words, a longer word within.  Chunks together hold every character
    that is no white space.
    """
    overlap = min(overlap, target // 2)
    held: tuple[str, str, int, int] | None = None  # kind, path, first, last
    for block in blocks(text):
        if held and (block.kind in ("code", "heading") or block.path != held[1]):
            yield Chunk(*held)
            held = None
        if block.kind == "code":
            yield from _code(text, block, most_code)
            continue
        whole = [(block.first, block.last)] if count(text[block.first : block.last]) <= target else list(_pieces(text, block, target, count))
        for first, last in whole:
            if held and count(text[held[2] : last]) > target:
                yield Chunk(*held)
                tail = _tail(text, held[2], held[3], overlap, count)
                held = (block.kind, block.path, tail if tail < held[3] and count(text[tail:last]) <= target else first, last)
            else:
                held = (held[0] if held and held[0] != "heading" else block.kind, block.path, held[2] if held else first, last)
    if held:
        yield Chunk(*held)


COLUMNS = "chunk int, kind string, path string, title string, first int, last int, text string"


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP, count: Callable[[str], int] = quarter) -> DataFrame:
    """id, chunk (from 0), kind, path (of headings), title, first, last (in characters) and text of every chunk of every text.

    Null and blank texts have none; rows that repeat an id are chunked each.
    """
    if target < 1:
        raise ValueError("a chunk must hold a token")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, text in zip(frame["id"], frame["text"], strict=True):
                rows = []
                for k, c in enumerate(chunks(text or "", target, overlap, count)):
                    body = c.before + text[c.first : c.last] + c.after
                    line = next((x.strip().lstrip("#").strip() for x in body.splitlines() if x.strip().lstrip("#").strip()), "")
                    rows.append((i, k, c.kind, c.path, (c.path.split(" > ")[-1] or line)[:200], c.first, c.last, body))
                if rows:
                    yield pd.DataFrame(rows, columns=["id", *(x.split()[0] for x in COLUMNS.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)
