"""Packing token pieces into sequences: a configuration linear program over lengths.

Documents are tokenised and cut into pieces; only the histogram of piece lengths (at
most as many counts as the capacity) reaches the driver.  A configuration is a
multiset of lengths that fits one sequence.  The covering program

    minimise sum x_C   subject to   sum a(C, l) x_C >= n(l)

is solved by multiplicative weights: each round prices the lengths and finds, by dynamic
programming over the capacity (unbounded knapsack), the most valuable configuration that
contains each length.  Those of nearly the best value are used, in whole sequences and at
most half of what a length needs at a time, and the prices of what they cover fall.  Any
prices, divided by the value of their best configuration, are a feasible dual, which gives
a lower bound on the sequences.  Rounds go on until all but a small share of the tokens is
covered; that rest is packed best-fit-decreasing, by length classes rather than by items,
so that the work on the driver depends on the capacity and not on the number of documents.

Pieces are numbered within their length by task (counts per task and length, summed
over the tasks before), and a table of at most a few thousand classes maps a length
and a number to a sequence and an offset.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.common import Scratch, arrow_batches, documents

CAPACITY = 2048
#: Configurations within this share of the best value are used in the same round.
NEAR = 0.03
#: The share of the tokens that is left to best fit.
REST = 0.01
#: Distinct chunks whose ids a worker keeps.
CACHE = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True
_SEP = "~"


class ChunkTokenizer:
    """Token ids of whole texts from the ids of their distinct chunks.

    The tokenizer lower-cases, drops white space and splits letters from punctuation
    before it merges, so that text cut at ASCII white space, or between an ASCII
    letter and ASCII punctuation other than an apostrophe, has the ids of its parts
    one after another.  Each distinct chunk is encoded once per worker.  Texts that
    may hold the string of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        sep = self.tok.encode(_SEP, add_special_tokens=False).ids
        self.sep = sep[0] if len(sep) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1, np.uint32)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and their numbers; joined by a separator, which is faster."""
        groups = [chunks[i : i + 2000] for i in range(0, len(chunks), 2000)]
        flat, sizes = [], []
        for group, enc in zip(groups, self.tok.encode_batch_fast([f" {_SEP} ".encode().join(g).decode("utf-8", "replace") for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, np.uint32)
            cut = ids == self.sep
            ends = np.append(np.flatnonzero(cut), len(ids))
            if len(ends) != len(group):
                raise ValueError("a chunk held the separator")
            sizes.append(np.diff(ends, prepend=-1) - 1)
            flat.append(ids[~cut])
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = buf.tobytes()
        odd = np.concatenate(([0], np.cumsum(buf == ord(_SEP))))
        plain = odd[ends] == odd[starts] if self.sep is not None else np.zeros(len(starts), bool)
        order = np.argsort(~plain, kind="stable")
        hashes, starts, ends = hashes[order], starts[order], ends[order]
        k = int(plain.sum())
        chunks = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        flat, size = self._encode(chunks[:k]) if k else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        rest = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks[k:]], add_special_tokens=False)]
        size = np.concatenate((size, np.fromiter(map(len, rest), np.int64, len(rest))))
        at = len(self.flat) + np.concatenate(([0], np.cumsum(size)))[:-1]
        self.flat = np.concatenate([self.flat, flat, *rest])
        every = np.concatenate((self.hash, hashes))
        order = np.argsort(every, kind="stable")
        self.hash, self.at, self.size = every[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document ended by id 0, and the number of ids of each document."""
        low = K.lower_ascii(buf)
        starts, ends, count = K.words(low, off)
        if len(low) > 1:
            cut = np.zeros(len(low) + 1, bool)
            cut[1:-1] = _LETTER[low[:-1]] & _PUNCT[low[1:]]
            cut[off] = False
            cuts = np.flatnonzero(cut)
            starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
            count = np.diff(np.searchsorted(starts, off))
        hashes = K.range_hash(K.prefix_hash(low), starts, ends)
        if len(self.hash) > CACHE:
            self.clear()
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.hash, unique), max(len(self.hash) - 1, 0))
        new = self.hash[where] != unique if len(self.hash) else np.ones(len(unique), bool)
        if new.any():
            self._learn(unique[new], low, starts[first[new]], ends[first[new]])
            where = np.searchsorted(self.hash, unique)
        at, size = self.at[where][inverse], self.size[where][inverse]
        # One more chunk ends each document: the first place of ``flat`` holds id 0.
        close = np.cumsum(count)
        at, size = np.insert(at, close, 0), np.insert(size, close, 1)
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        per = np.diff(total[np.concatenate(([0], np.cumsum(count + 1)))])
        special = [i for i in range(len(off) - 1) if b"<|" in buf[off[i] : off[i + 1]].tobytes()] if (low == 0x7C).any() and b"<|" in low.tobytes() else []
        if special:
            parts = np.split(ids, np.cumsum(per)[:-1])
            for i in special:
                text = buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
                parts[i] = np.array([*self.tok.encode(text, add_special_tokens=False).ids, 0], np.uint32)
            ids, per = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, per


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int, with_ids: bool) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, by task, the number among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            buf, off = K.text_bytes(batch.column(1))
            for a, b in K.slices(off, 2 * K.SLICE_BYTES):
                ids, per = tok(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                n = (per + capacity - 1) // capacity
                doc = np.repeat(np.arange(b - a), n)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(capacity, per[doc] - start)
                order = np.argsort(length, kind="stable")
                run_at = np.searchsorted(length[order], length[order])
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - run_at
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(length)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task)), pa.array(rank)]
                names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long" + ", ids array<int>" * with_ids)


@dataclass
class Plan:
    """Classes of like sequences: (how many, ((length, copies), ...)), and a lower bound on the sequences."""

    classes: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)
    bound: float = 0.0
    #: So many classes, the first ones, come from the linear program, the others from best fit.
    solved: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.classes)

    def table(self) -> np.ndarray:
        """Sorted rows (length, first rank, first sequence, copies per sequence, offset)."""
        used: dict[int, int] = {}
        rows, base = [], 0
        for n, content in self.classes:
            at = 0
            for length, copies in content:
                rows.append((length, used.get(length, 0), base, copies, at))
                used[length] = used.get(length, 0) + n * copies
                at += length * copies
            base += n
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def best_values(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For each room the value of its best multiset of lengths, and the length to take first (0: leave one token free)."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = values
    best = np.zeros(capacity + 1)
    choice = [0] * (capacity + 1)
    dense = 3 * len(lengths) > capacity
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            total = worth[1 : c + 1] + best[c - 1 :: -1] if dense else best[c - lengths[:k]] + values[:k]
            i = int(np.argmax(total))
            if total[i] > best[c] + 1e-15:
                best[c], choice[c] = total[i], i + 1 if dense else int(lengths[i])
    return best, choice


def configuration(first: int, choice: list[int], lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration with the length ``first``, of what is left; the room of missing pieces goes to the longest that fit."""
    out = {first: 1}
    c = capacity - first
    while c > 0:
        if length := choice[c]:
            out[length] = out.get(length, 0) + 1
        c -= length or 1
    out = {length: k for length, copies in out.items() if (k := min(copies, int(left[length])))}
    room = capacity - sum(length * k for length, k in out.items())
    while room and (upto := int(np.searchsorted(lengths, room, "right"))):
        length = next((x for x in lengths[upto - 1 :: -1].tolist() if left[x] > out.get(x, 0)), 0)
        if not length:
            break
        k = min(room // length, int(left[length]) - out.get(length, 0))
        out[length] = out.get(length, 0) + k
        room -= k * length
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit decreasing by classes: equal lengths go to equally full sequences together."""
    open_: dict[int, list[list]] = {}  # room left -> [[how many, content]]
    full: list[list] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            classes, open_[room] = open_.get(room, []), []
            for k, (n, content) in enumerate(classes):
                if not left:
                    open_[room] += classes[k:]
                    break
                fit = room // length
                take = min(n, left // fit)
                placed = [(take, fit)] if take else []
                if take < n and (odd := min(left - take * fit, fit)):
                    placed.append((1, odd))
                for many, copies in placed:
                    left -= many * copies
                    n -= many
                    open_.setdefault(room - copies * length, []).append([many, (*content, (length, copies))])
                if n:
                    open_[room].append([n, content])
        if left:
            fit = capacity // length
            for many, copies in ((left // fit, fit), (1, left % fit)):
                if many and copies:
                    open_.setdefault(capacity - copies * length, []).append([many, ((length, copies),)])
        full += open_.pop(0, [])
        for room in [r for r, x in open_.items() if not x]:
            del open_[room]
    return [(n, c) for n, c in full] + [(n, c) for x in open_.values() for n, c in x]


def plan(counts: dict[int, int], capacity: int, rounds: int | None = None) -> Plan:
    """Sequences for pieces of the given lengths (length -> how many); without a limit, rounds go on until REST is left."""
    demand = {k: n for k, n in counts.items() if n}
    if not demand:
        return Plan()
    n = np.zeros(capacity + 1, np.int64)
    n[list(demand)] = list(demand.values())
    size = np.arange(capacity + 1)
    total = int((size * n).sum())
    # A little more than proportional prices use long pieces first and keep short ones to fill gaps.
    weight = (size / capacity) ** 1.05
    left = n.copy()
    amount: dict[tuple[tuple[int, int], ...], int] = {}
    out = Plan(bound=total / capacity)
    # A round covers at least one piece, so that this ends.
    while (rounds is None or rounds > 0) and (size * left).sum() > REST * total:
        rounds = None if rounds is None else rounds - 1
        live = np.flatnonzero(left)
        best, choice = best_values(weight[live], live, capacity)
        top = float(best[capacity])
        out.bound = max(out.bound, float((weight[live] * n[live]).sum()) / top)
        values = weight[live] + best[capacity - live]
        order = np.argsort(-values, kind="stable")
        used = False
        for first in live[order[values[order] >= (1 - NEAR) * top]].tolist():
            if not left[first]:
                continue
            config = configuration(first, choice, live, left, capacity)
            lengths, copies = np.array(list(config)), np.array(list(config.values()))
            if used and (weight[lengths] * copies).sum() < (1 - NEAR) * top:
                continue
            used = True
            many = max(1, min(int((left[lengths] // copies).min()), int((n[lengths] / copies).min() / 2)))
            left[lengths] -= many * copies
            weight[lengths] *= np.exp(-0.5 * many * copies / n[lengths])
            key = tuple(sorted(config.items(), reverse=True))
            amount[key] = amount.get(key, 0) + many
    out.classes = [(many, config) for config, many in sorted(amount.items(), key=lambda kv: (-kv[1], kv[0]))]
    out.solved = len(out.classes)
    out.classes += best_fit({k: int(left[k]) for k in np.flatnonzero(left).tolist()}, capacity)
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Place every document's token pieces in sequences of at most ``capacity`` tokens.

    ``path`` is the tokenizer's file.  A document is its ids followed by id 0 (a null
    text counts as empty, one id); only documents longer than the capacity are cut,
    into pieces of the capacity and a rest.  Returns, per piece: the id, piece, start,
    length, ids_crc32 (of the ids as little-endian 32-bit numbers), sequence_id and
    offset; with ``with_ids`` also the ids.  Rows that repeat an id, or have a null id,
    are packed like others; an empty table gives an empty result; other columns are
    ignored.
    """
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = scratch.save(pieces(base, path, capacity, with_ids), "pieces")
    held = scratch.save(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("held")), "held")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("held").alias("n")).collect()}
    rows = plan(counts, capacity).table()
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = cut.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"])
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    numbered = numbered.select(*columns, (F.col("rank") + F.col("before")).alias("rank"), *["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 44
        keys = rows[:, 0] * shift + rows[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            k = np.searchsorted(keys, length * shift + rank, "right") - 1
            over = rank - rows[k, 1]
            sequence = rows[k, 2] + over // rows[k, 3]
            offset = rows[k, 4] + over % rows[k, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset), *([batch.column(6)] if with_ids else [])], [*columns, "sequence_id", "offset", *["ids"] * with_ids])

    kind = base.schema["id"].dataType.simpleString()
    out = numbered.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised by the 49k word vocabulary, in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
