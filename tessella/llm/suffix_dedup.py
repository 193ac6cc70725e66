"""Removal of repeated byte strings with suffix arrays.

A start is a place from which at least ``length`` bytes of its document follow; it is
repeated if the same ``length`` bytes start anywhere else too.

1. Every start has an anchor: the least hash of the k-grams in its ``length`` bytes.
   Equal strings have equal anchors, and neighbouring starts mostly share one, so a
   document falls into runs of starts.  Anchor places are counted over the corpus;
   a start can only be repeated if its anchor occurs at two places or more.
2. Runs with such anchors are dealt by anchor, with the bytes that their starts cover,
   to shards.  All copies of a string meet there, whatever documents they are from.
   Within a shard, equal runs are recognised first and one of them stands for all.
3. Each shard gets a suffix array by Larsson-Sadakane refinement (ranks by 8 bytes,
   then doubled, sorting only groups that are still tied), and the common prefix of
   each start and its predecessor by Kasai's rule, which leaves few of them to be compared.
4. An anchor of very many places is dealt to several shards.  Each sends its distinct
   strings, as sorted 128-bit fingerprints packed by hash range, to be merged: the
   fingerprints of one shard are looked up in the others' by binary search.

Repeated starts become byte spans, which are removed from the documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.common import Scratch, arrow_batches, documents, pick

#: Bytes of an anchor gram: long ones are rarely shared by documents that share no long string.
GRAM = 192
#: Bytes of a shard that are sorted at once, and runs of one anchor in one shard.
SHARD_BYTES = 2_000_000
RUNS = 1000
#: Bytes of runs that a task should sort.
TASK_BYTES = 8_000_000
#: Hash ranges in which the shards of one anchor send their fingerprints (times the root of their number).
RANGES = 16


def _sliding(x: np.ndarray, w: int, best: np.ufunc, worst: np.uint64) -> np.ndarray:
    """best over x[i : i + w] for every i, by prefix and suffix bests of blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate((x, np.full(pad, worst, x.dtype))).reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).reshape(-1)
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[:n], ahead[w - 1 : w - 1 + n])


def anchor_runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with the same anchor: document, first and last start, anchor; and the anchors of all anchor places."""
    docs, firsts, lasts, keys, places = [], [], [], [], []
    w = length - gram + 1
    prefix = K.prefix_hash(buf)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for d in np.flatnonzero(np.diff(off) >= length):
        a, b = off[d], off[d + 1]
        at = np.arange(a, b - gram + 1)
        h = K.range_hash(prefix, at, at + gram)
        least = _sliding(h, w, np.minimum, top)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate(([0], cut))
        docs.append(np.full(len(first), d))
        firsts.append(first)
        lasts.append(np.concatenate((cut, [len(least)])) - 1)
        keys.append(least[first])
        # A gram is an anchor place if it is the least of some window, i.e. reaches the greatest least around it.
        around = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
        places.append(h[h <= _sliding(around, w, np.maximum, np.uint64(0))])
    if not docs:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    cat = np.concatenate
    return cat(docs), cat(firsts), cat(lasts), cat(keys).view(np.int64), cat(places).view(np.int64)


def words8(text: np.ndarray) -> np.ndarray:
    """At each place its next 8 bytes as a big-endian number, zeros after the end."""
    out = text.astype(np.uint64)
    for k in (1, 2, 4):
        ahead = out[k:]
        out = out << np.uint64(8 * k)
        out[: len(ahead)] |= ahead
    return out


def sorted_suffixes(key: np.ndarray, known: int, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of the suffixes that start there, and which places of that order begin a group of equal ones.

    Larsson-Sadakane: places are ranked by their key, which holds the next ``known``
    letters; then groups of equal rank, and only these, are sorted by the rank of the
    place as many letters further on, which doubles the letters that are compared, until
    no two ranks are equal (or ``depth`` letters are compared).
    """
    n = len(key)
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n, np.int64)
    rank[sa] = group
    at = np.arange(n)
    while depth is None or known < depth:
        # Places in groups of one keep their rank: only the tied ones of the last round can still be tied.
        tied = ~new[at]
        tied[:-1] |= tied[1:] & (at[1:] == at[:-1] + 1)
        at = at[tied]
        if not len(at):
            break
        places = sa[at]
        ahead = places + known
        further = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        combined = (group[at].astype(np.uint64) << np.uint64(32)) | further.astype(np.uint64)
        order = np.argsort(combined)
        combined = combined[order]
        sa[at] = places[order]
        new[at[1:]] = combined[1:] != combined[:-1]
        new[at[0]] = True
        group[at] = np.maximum.accumulate(np.where(new[at], at, 0))
        rank[sa[at]] = group[at]
        known *= 2
    return sa, new


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of bytes, ranked by 8 bytes first."""
    return sorted_suffixes(words8(text), 8)[0]


def common_prefixes(text: np.ndarray, sa: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the starts of each run: place, predecessor in the suffix array, and min(common prefix, length).

    Kasai: a place shares at least as much with its predecessor as the place before it
    does, less a byte; and exactly that if the same byte comes before the place and
    before its predecessor.  So only places where that byte differs (and the first of a
    run) are compared, eight bytes at once, up to the end of the run; the others follow.
    """
    where = np.empty(len(sa), np.int64)
    where[sa] = np.arange(len(sa))
    word = words8(text)
    count = last - first + 1
    begin = np.concatenate(([0], np.cumsum(count)))
    place = np.repeat(first - begin[:-1], count) + np.arange(begin[-1])
    before = sa[np.maximum(where[place] - 1, 0)]
    alone = where[place] == 0
    new = alone | (place == 0) | (before == 0) | (text[place - 1] != text[before - 1])
    new[begin[:-1][count > 0]] = True
    at = np.flatnonzero(new)
    i, j = place[at], before[at]
    most = np.minimum(np.repeat(last + length, count)[at], len(text) - np.maximum(j - i, 0)) - i
    most[alone[at]] = 0
    n = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        m = n[open_]
        diff = word[i[open_] + m] ^ word[j[open_] + m]
        same = diff == 0
        d = diff[~same]
        n[open_[~same]] += sum((d >> np.uint64(64 - 8 * k)) == 0 for k in range(1, 8))
        open_ = open_[same]
        n[open_] += 8
        open_ = open_[n[open_] < most[open_]]
    n = np.minimum(n, most)
    # Each place takes what the last compared one found, less the bytes between the two.
    since = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
    found = np.zeros(len(place), np.int64)
    found[at] = n
    return place, before, np.minimum(found[since] - (np.arange(len(place)) - since), length)


def _fingerprints(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for part in (text, text ^ np.uint8(0xA5)):
        out.append(K.range_hash(K.prefix_hash(part), at, at + length))
    return out[0], K.mix(out[1] + np.uint64(1))


def repeated_in_shard(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs (each the bytes that its starts cover): places in the joined text of the runs' starts, the run of each,
    whether it is repeated, the group of equal strings, and the joined text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # A byte that UTF-8 does not use ends each run, so that no string goes over the end.
    text = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    last = first + size - length
    sa = suffix_array(text)
    place, before, shared = common_prefixes(text, sa, first, last, length)
    is_start = np.zeros(len(text), bool)
    is_start[place] = True
    hit = (shared >= length) & is_start[before]
    twice = np.zeros(len(text), bool)
    twice[place[hit]] = True
    twice[before[hit]] = True
    # Equal strings follow one another in the suffix array.
    where = np.empty(len(sa), np.int64)
    where[sa] = np.arange(len(sa))
    order = np.argsort(where[place])
    group = np.empty(len(place), np.int64)
    group[order] = np.cumsum(~hit[order])
    return place, np.repeat(np.arange(len(texts)), last - first + 1), twice[place], group, text


def _intervals(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive starts (sorted by document and start): document, first, last."""
    if not len(doc):
        return doc, start, start
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(doc)])) - 1
    return doc[first], start[first], start[last]


SPANS = "id long, tag long, first long, last long"
#: A shard gives spans or, of an anchor that was dealt to several shards, fingerprints too.
FOUND = SPANS + ", anchor long, zone long, packed binary"


def _shards(length: int):
    """Spans of repeated starts of the shards in a partition; and packed fingerprints of the strings that occur once
    or more in the shard, if its anchor was dealt to several."""

    def solve(rows: list[tuple], spans: list, prints: list) -> None:
        kinds: dict[bytes, int] = {}
        owner: list[list[int]] = []
        for k, row in enumerate(rows):
            x = kinds.setdefault(row[5], len(kinds))
            if x == len(owner):
                owner.append([])
            owner[x].append(k)
        texts = list(kinds)
        many = np.array([len(x) > 1 for x in owner])
        parts = rows[0][2]
        if len(texts) == 1 and not many[0] and len(texts[0]) == length and parts == 1:
            return
        place, run, twice, group, text = repeated_in_shard(texts, length)
        twice = twice | many[run]
        begin = np.searchsorted(run, np.arange(len(texts)))
        mine = np.flatnonzero(twice)
        for x, f, e in zip(*(c.tolist() for c in _intervals(run[mine], mine - begin[run[mine]])), strict=True):
            for k in owner[x]:
                s = rows[k][4]
                spans.append((*rows[k][3], s + f, s + e))
        if parts == 1:
            return
        # One of each string, marked if repeated here; single ones say where they are.
        _, one = np.unique(group, return_index=True)
        a, b = _fingerprints(text, place[one], length)
        k = np.array([owner[x][0] for x in run[one]])
        start = np.array([r[4] for r in rows])[k] + one - begin[run[one]]
        ids, tags = (np.array([r[3][j] for r in rows], np.int64)[k] for j in (0, 1))
        zones = RANGES * math.isqrt(parts)
        zone = ((a >> np.uint64(32)) * np.uint64(zones) >> np.uint64(32)).astype(np.int64)
        packed = np.column_stack((a.view(np.int64), b.view(np.int64), ids, tags, start, twice[one].astype(np.int64)))
        order = np.lexsort((b, a))
        for z in range(zones):
            mine = order[zone[order] == z]
            if len(mine):
                prints.append((rows[0][0], z, packed[mine].tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, size = None, 0

        def flush() -> pa.RecordBatch:
            spans: list = []
            prints: list = []
            if held:
                solve(held, spans, prints)
            n, m = len(spans), len(prints)
            columns = [pa.array([*(x[j] for x in spans), *[None] * m], pa.int64()) for j in range(4)]
            columns += [pa.array([*[None] * n, *(x[j] for x in prints)], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["id", "tag", "first", "last", "anchor", "zone", "packed"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for anchor, part, parts, doc, tag, first, body in zip(*columns, batch.column(6), strict=True):
                # Small anchors are sorted together; a part of a large one is a shard of its own.
                if held and group != (anchor, part) and (size >= SHARD_BYTES or parts > 1 or held[0][2] > 1):
                    yield flush()
                    held, size = [], 0
                group = (anchor, part)
                raw = body.as_py()
                held.append((anchor, part, parts, (doc, tag), first, raw))
                size += len(raw)
        yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of single strings that another shard of the same anchor holds too.

    Each shard's list is sorted and has no string twice; in their merge, a string of
    several shards lies between two different places of a binary search.
    """
    held: list[np.ndarray] = []
    group = None

    def flush() -> pa.RecordBatch:
        rows = np.concatenate(held) if held else np.zeros((0, 6), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        low = np.searchsorted(rows[:, 0], rows[:, 0], "left")
        high = np.searchsorted(rows[:, 0], rows[:, 0], "right")
        several = high - low > 1
        equal = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        found = np.zeros(len(rows), bool)
        found[1:] |= equal
        found[:-1] |= equal
        rows = rows[found & several & (rows[:, 5] == 0)]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in (2, 3, 4, 4)], ["id", "tag", "first", "last"])

    for batch in batches:
        for anchor, zone, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if group != (anchor, zone):
                if held:
                    yield flush()
                held, group = [], (anchor, zone)
            held.append(np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, 6).copy())
    yield flush()


def _runs(length: int, gram: int):
    """Per document: id, tag, size, sha of the text and its runs; anchor places go out as rows with a null size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch.column(2))
            for a, b in K.slices(off):
                part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                raw = part.tobytes()
                doc, first, last, key, places = anchor_runs(part, o, length, gram)
                n = np.bincount(doc, minlength=b - a)
                at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                runs = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(key), pa.array(first), pa.array(last)], ["anchor", "first", "last"]))
                # How often each anchor occurs in this slice: the counts are added up later.
                anchors, count = np.unique(places, return_counts=True)
                empty = b - a
                places_of = pa.ListArray.from_arrays(pa.array([0] + [len(anchors)] * empty, pa.int32()), pa.StructArray.from_arrays([pa.array(anchors), pa.array(count)], ["anchor", "n"]))
                sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(o)), pa.array(sha, pa.string()), runs, places_of], ["id", "tag", "size", "sha", "runs", "places"])

    return run


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch.column(2))
            raw = buf.tobytes()
            runs = batch.column(3)
            doc = np.repeat(np.arange(len(runs)), runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            fields = runs.flatten()
            anchor, part, parts, first, last = (fields.field(k) for k in ("anchor", "part", "parts", "first", "last"))
            start = off[doc] + first.to_numpy()
            end = off[doc] + last.to_numpy() + length
            ids, tags = (batch.column(k).take(pa.array(doc)) for k in (0, 1))
            size = np.concatenate(([0], np.cumsum(end - start)))
            for a, b in K.slices(size, 4_000_000):
                body = pa.array([raw[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in (anchor, part, parts, ids, tags, first)), body], ["anchor", "part", "parts", "id", "tag", "first", "body"])

    return run


def _removed(length: int):
    """Per document with spans: what is removed and what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch.column(2))
            raw = buf.tobytes()
            out: list[tuple] = []
            for k, spans in enumerate(batch.column(3).to_pylist()):
                merged: list[list[int]] = []
                for s, e in sorted((x["first"], x["last"] + length) for x in spans):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                body, at, kept = raw[off[k] : off[k + 1]], 0, []
                for s, e in merged:
                    kept.append(body[at:s])
                    at = e
                kept.append(body[at:])
                rest = b"".join(kept)
                out.append((len(body) - len(rest), [{"first": s, "end": e} for s, e in merged], rest, hashlib.sha256(rest).hexdigest()))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "tag", "n_removed", "spans", "kept", "kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = GRAM, runs: int = RUNS, with_kept: bool = False) -> DataFrame:
    """Byte spans of every text that are covered by a repeated string of ``length`` bytes.

    Texts are taken as UTF-8 bytes (null as empty), each on its own; strings are judged
    on the input, overlapping repeats and those within one document included.  Returns,
    per row: the id, n_bytes, n_removed, spans (maximal, first and end), kept_sha256 (of
    the bytes that stay, joined) and, with ``with_kept``, those bytes (kept).  Rows that
    repeat an id and text count as different documents and get the same result; null
    ids are treated like others (and so is the id -2**63, which stands for null and is
    returned as null); an empty table gives an empty result; other columns
    are ignored.
    """
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    seen = base.select("id", "tag", "text").mapInArrow(_runs(length, gram), "id long, tag long, size long, sha string, runs array<struct<anchor: long, first: long, last: long>>, places array<struct<anchor: long, n: long>>")
    seen = scratch.save(seen, "runs")

    places = seen.filter("size(places) > 0").select(F.inline("places")).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    shared = places.select("anchor", F.expr(f"1 + (n - 1) div {runs}").alias("parts"))
    each = seen.filter("size(runs) > 0").select("id", "tag", F.inline("runs"))
    wanted = each.join(shared, "anchor").withColumn("part", F.expr("pmod(xxhash64(id, first), parts)"))
    of_doc = scratch.save(wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("anchor", "part", "parts", "first", "last")).alias("runs")), "wanted")
    pieces = pick(base, of_doc.select("id", "tag"), ["id", "tag"]).join(of_doc, ["id", "tag"]).select("id", "tag", "text", "runs")
    dealt = pieces.mapInArrow(_pieces(length), "anchor long, part long, parts long, id long, tag long, first long, body binary")
    # Sorting a byte costs far more than moving it: the tasks are counted by the bytes, not left to be merged by size.
    amount = of_doc.select(F.inline("runs")).agg(F.sum(F.expr(f"last - first + {length}")).alias("bytes"), F.max("parts").alias("parts")).first()
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil((amount["bytes"] or 0) / TASK_BYTES))
    dealt = dealt.repartition(tasks, "anchor", "part").sortWithinPartitions("anchor", "part")
    found = scratch.save(dealt.mapInArrow(_shards(length), FOUND), "found")
    spans = found.filter("packed is null").select("id", "tag", "first", "last")
    if (amount["parts"] or 1) > 1:
        packed = found.filter("packed is not null").select("anchor", "zone", "packed").repartition(tasks, "anchor", "zone").sortWithinPartitions("anchor", "zone")
        spans = spans.unionByName(scratch.save(packed.mapInArrow(_merge, SPANS), "merged"))
    of_doc = scratch.save(spans.groupBy("id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "document-spans")
    cut = pick(base, of_doc.select("id", "tag"), ["id", "tag"]).join(of_doc, ["id", "tag"]).select("id", "tag", "text", "spans").dropDuplicates(["id", "tag"])
    cut = cut.mapInArrow(_removed(length), "id long, tag long, n_removed long, spans array<struct<first: long, end: long>>, kept binary, kept_sha256 string")
    if not with_kept:
        cut = cut.drop("kept")
    out = seen.select("id", "tag", "size", "sha").join(cut, ["id", "tag"], "left")
    columns = [
        F.when((F.col("id") != -(1 << 63)), F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), F.col("size").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<first: long, end: long>>")).alias("spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    ]
    return out.select(*columns, *(["kept"] if with_kept else []))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all documents."""
    out = repeated_spans(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
