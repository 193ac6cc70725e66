"""Benchmark passages in training documents, found by suffix arrays.

1. The benchmark is read in blocks of bounded size.  A block is a vocabulary, the items
   as one sequence of word numbers, and the distinct windows of its sorted suffixes.
2. Documents are handled in shards.  The words of a shard become numbers of the
   vocabulary (0 for others, and between documents); a suffix array sorts the places
   where a window could start, in rounds that double the words compared.
3. Every window's suffix is looked up by binary search, word after word, all windows in
   step: what is left of the range of the array after the last word are its locations.
4. Locations that follow one another in a document and in an item are one verbatim
   match, as long as it goes.

A document is read, cut into words and searched in one task; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.common import BROADCAST_ROWS, Scratch, arrow_batches, documents, fresh
from tessella.llm.suffix_dedup import sorted_suffixes

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of the benchmark that are searched for in one pass, and of documents in a shard.
BLOCK_BYTES = 16_000_000
SHARD_BYTES = 4_000_000
#: Parts to which the rows of one text are dealt where the matches of several passes meet.
SALTS = 16

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and the words of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in K.slices(off):
        part = K.lower_ascii(buf[off[a] : off[b]])
        starts, ends, count = K.spans(_WORD[part], off[a : b + 1] - off[a])
        hashes.append(K.range_hash(K.prefix_hash(part), starts, ends))
        counts.append(count)
    return np.concatenate(hashes), np.concatenate(counts)


def _packed(code: np.ndarray, most: int, width: int) -> tuple[np.ndarray, int]:
    """At each place the next words as one number, and how many they are."""
    bits = max(int(most).bit_length(), 1)
    known = min(64 // bits, width)
    key = np.zeros(len(code), np.uint64)
    ahead = np.concatenate((code, np.zeros(known, code.dtype))).astype(np.uint64)
    for k in range(known):
        key = (key << np.uint64(bits)) | ahead[k : k + len(code)]
    return key, known


@dataclass
class Block:
    """Items of the benchmark: their words as numbers of a vocabulary, 0 after each item, and their distinct windows."""

    names: np.ndarray  # id of each item
    vocabulary: np.ndarray  # sorted hashes; the word of place k has number k + 1
    code: np.ndarray
    item: np.ndarray  # item of each place
    width: int
    first: np.ndarray  # one place of each distinct window
    size: np.ndarray  # its words
    begin: np.ndarray  # windows have the places places[begin[k] : begin[k + 1]]
    places: np.ndarray


def block_of(names: list[str], texts: pa.Array, width: int = WINDOW) -> Block:
    hashes, count = _words(*K.text_bytes(texts))
    vocabulary, number = np.unique(hashes, return_inverse=True)
    n_items = len(count)
    item = np.repeat(np.arange(n_items), count + 1)
    code = np.zeros(len(hashes) + n_items, np.int64)
    ends = np.cumsum(count + 1)
    inside = np.ones(len(code), bool)
    inside[ends - 1] = False
    code[inside] = number + 1
    left = (ends - 1)[item] - np.arange(len(code))
    size = np.minimum(count, width)[item]
    starts = (left >= size) & inside
    # Places of equal windows follow one another in the order of the suffixes.
    sa, new = sorted_suffixes(*_packed(code, len(vocabulary), width), width) if len(code) else (np.zeros(0, np.int64), np.zeros(0, bool))
    group = np.cumsum(new)
    mine = starts[sa]
    sa, group = sa[mine], group[mine]
    # A short item and a longer one may begin alike: windows are equal only if their sizes are.
    order = np.lexsort((size[sa], group))
    sa, group = sa[order], group[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(sa), 1), bool), (group[1:] != group[:-1]) | (size[sa][1:] != size[sa][:-1]))))
    return Block(np.array(names, object), vocabulary, code.astype(np.int32), item.astype(np.int32), width, sa[begin], size[sa[begin]], np.append(begin, len(sa)), sa)


def shard_suffixes(code: np.ndarray, most: int, least: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a shard (0: not in the vocabulary): those in runs of at least ``least``, with a 0 after each run;
    where they are in the shard; and their suffixes in order, as far as ``width`` words tell them apart."""
    known = np.concatenate(([0], (code > 0).astype(np.int8), [0]))
    begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = end - begin >= least
    begin, end = begin[long], end[long]
    n = end - begin + 1
    upto = np.concatenate(([0], np.cumsum(n)))
    where = np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])
    text = np.append(code, 0)[where]
    text[upto[1:] - 1] = 0
    sa, _ = sorted_suffixes(*_packed(text, most, width), width) if len(text) else (np.zeros(0, np.int64), None)
    return text, where, sa[text[sa] > 0]


def _bisect(letter: np.ndarray, sa: np.ndarray, ahead: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """In each range [lo, hi) of the array the first suffix whose word ``ahead`` is not below (``after``: above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        there = letter[sa[mid] + ahead]
        below = there <= wanted[open_] if after else there < wanted[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def locate(block: Block, text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that occur in a shard, and the range of the suffix array with all locations of each."""
    letter = np.concatenate((text, np.zeros(block.width, text.dtype)))
    found = np.arange(len(block.first))
    lo, hi = np.zeros(len(found), np.int64), np.full(len(found), len(sa))
    for k in range(block.width):
        more = np.flatnonzero(block.size[found] > k)
        if not len(more):
            break
        wanted = block.code[block.first[found[more]] + k]
        low = _bisect(letter, sa, k, lo[more], hi[more], wanted, False)
        hi[more] = _bisect(letter, sa, k, low, hi[more], wanted, True)
        lo[more] = low
        some = lo < hi
        found, lo, hi = found[some], lo[some], hi[some]
    return found, lo, hi


def matches(block: Block, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal verbatim matches of a shard's words: first word, number of words, item, first word in the block."""
    text, where, sa = shard_suffixes(code, len(block.vocabulary), int(block.size.min(initial=block.width)), block.width)
    window, lo, hi = locate(block, text, sa)
    # Every location with every place of the benchmark that has this window.
    n = hi - lo
    at = sa[np.repeat(lo - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())]
    window = np.repeat(window, n)
    n = block.begin[window + 1] - block.begin[window]
    place = block.places[np.repeat(block.begin[window] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())]
    at, size = np.repeat(at, n), np.repeat(block.size[window], n)
    # Windows of one match lie on a diagonal, one word after the other.
    order = np.lexsort((at, place - at))
    at, place, size = at[order], place[order], size[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1) | (block.item[place[1:]] != block.item[place[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return where[at[first]] if len(at) else at, at[last] - at[first] + size[last], block.item[place[first]], place[first]


MATCHES = "array<struct<start: long, words: long, item: string, item_start: long>>"


def _search(block):
    """Per document: number of words, verbatim matches, and the sha256 of the text if there are any."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        begins = np.concatenate(([0], np.flatnonzero(b.code == 0) + 1))
        for batch in batches:
            buf, off = K.text_bytes(batch.column(1))
            for x, y in K.slices(off, SHARD_BYTES):
                part = buf[off[x] : off[y]]
                hashes, count = _words(part, off[x : y + 1] - off[x])
                upto = np.concatenate(([0], np.cumsum(count)))
                # A word after each document, which is none, keeps matches from crossing over.
                code = np.zeros(len(hashes) + len(count), np.int64)
                if len(b.vocabulary):
                    place = np.minimum(np.searchsorted(b.vocabulary, hashes), len(b.vocabulary) - 1)
                    code[np.arange(len(hashes)) + np.repeat(np.arange(len(count)), count)] = np.where(b.vocabulary[place] == hashes, place + 1, 0)
                first, words, item, place = matches(b, code)
                doc = np.searchsorted(upto[:-1] + np.arange(len(count)), first, "right") - 1
                order = np.lexsort((item, first))
                first, words, item, place, doc = first[order], words[order], item[order], place[order], doc[order]
                lists = pa.StructArray.from_arrays([pa.array(first - upto[doc] - doc), pa.array(words), pa.array(b.names[item], pa.string()), pa.array(place - begins[item])], ["start", "words", "item", "item_start"])
                at = np.searchsorted(doc, np.arange(len(count) + 1))
                found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), lists).cast(kind)
                raw, o = part.tobytes() if len(doc) else b"", off[x : y + 1] - off[x]
                sha = [hashlib.sha256(raw[o[k] : o[k + 1]]).hexdigest() if at[k] < at[k + 1] else None for k in range(y - x)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(count), found, pa.array(sha, pa.string())], ["id", "n_words", "matches", "sha"])

    return run


def _pass(base: DataFrame, items: DataFrame) -> DataFrame:
    """The matches of all texts of base (id, text) with a block of items, which goes to every task."""
    block = items.toArrow()
    value = base.sparkSession.sparkContext.broadcast(block_of(block.column("name").to_pylist(), block.column("text")))
    return base.mapInArrow(_search(value), f"id {base.schema['id'].dataType.simpleString()}, n_words long, matches {MATCHES}, sha string")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, with_matches: bool = False) -> DataFrame:
    """What of the benchmark every document holds verbatim.

    Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and whatever is
    not ASCII.  Ten consecutive words of an item, or all words of a shorter one, are a
    window; a document word inside an occurrence of a window is hit.  Returns, per row:
    the id, n_words, n_hit, n_items (distinct items with windows in the document),
    items_sha256 (of their ids, sorted as strings, joined by commas), contaminated, and
    with ``with_matches`` the maximal verbatim matches (start, words, item, item_start,
    in words) and sha256 of the text of contaminated documents.  Words are compared by
    64-bit hashes.  A null text has no words; rows that repeat an id get a row each; a
    null item id counts as the empty one; empty tables are allowed (nothing is hit);
    other columns are ignored.

    The benchmark passes the driver in blocks of ``block_bytes`` at most (or one item),
    each of which is one pass over the documents; only documents with matches in a
    further block are joined to those of the first.
    """
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    name, text = F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("string").alias("text")
    items = benchmark.select(name, text).filter("text is not null")
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    body = F.col(text_col).cast("string").alias("text")
    base = docs.select(F.col(id_col).alias("id"), body)
    if parts == 1:
        out = _pass(base, items)
    else:
        # The same text has the same matches, whatever rows it is in.
        scratch = Scratch(spark)
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(body, F.lit("")), 256).alias("key")).alias("id"), body)
        block = F.pmod(F.xxhash64("name", "text"), F.lit(parts))
        passes = [scratch.save(_pass(keyed, items.filter(block == k)), f"block-{k}") for k in range(parts)]
        hits = reduce(DataFrame.unionByName, [x.filter("size(matches) > 0").select("id.key", "matches", "sha") for x in passes])
        hits = hits.dropDuplicates(["key", "matches"]).groupBy("key", "sha").agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
        deal = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = passes[0].select("id.id", "id.key", "n_words").withColumn("deal", F.pmod(F.hash("id"), F.lit(SALTS)))
        out = rows.join(hits.withColumn("deal", deal), ["key", "deal"], "left").select("id", "n_words", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"), "sha")
    covered = """aggregate(array_sort(transform(matches, x -> struct(x.start as a, x.start + x.words as b))), struct(0L as n, 0L as upto),
        (s, x) -> struct(s.n + greatest(0L, x.b - greatest(x.a, s.upto)) as n, greatest(s.upto, x.b) as upto), s -> s.n)"""
    out = out.withColumn("items", F.array_sort(F.array_distinct("matches.item")))
    columns = [
        F.col("id").alias(id_col), F.col("n_words"), F.expr(covered).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"),
    ]
    return out.select(*columns, *(["matches", F.col("sha").alias("text_sha256")] if with_matches else []))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that hold nothing of the benchmark, with all their columns.

    Affected texts are known by their sha256, so that rows with null or repeated ids are
    decided by their own text; a row with a null text stays.
    """
    key = fresh("key")
    hit = contamination(docs, benchmark, text_col=text_col, with_matches=True, **how).filter("contaminated").select(F.col("text_sha256").alias(key)).distinct()
    hit = Scratch(docs.sparkSession).save(hit, "affected")
    few = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return docs.join(few, F.sha2(F.col(text_col).cast("string"), 256) == F.col(key), "left_anti")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of all documents are in benchmark items."""
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
),
v AS (
  SELECT DISTINCT item_id, least(len(words), {WINDOW}) AS size, list_slice(words, i, i + least(len(words), {WINDOW}) - 1) AS words
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(words) > 0)
),
u AS (
  SELECT doc_id, i, s.size, list_slice(words, i, i + s.size - 1) AS words
  FROM (SELECT DISTINCT size FROM v) s, LATERAL (SELECT doc_id, words, unnest(range(1, len(words) - s.size + 2)) AS i FROM w WHERE len(words) >= s.size)
),
h AS (SELECT doc_id, i, u.size, item_id FROM u JOIN v ON u.size = v.size AND u.words = v.words),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
