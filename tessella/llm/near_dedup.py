"""MinHash near-duplicate groups: SuperMinHash signatures, banding, exact checks, union-find.

1. One pass over the texts makes each document's set of word shingles, a 128-bit
   name of the set, a SuperMinHash signature and its band keys.
2. Documents with the same set form a class; only the class's least id goes on, so
   that thousands of exact copies cost one row.
3. Within each bucket of a band, every member is checked against the bucket's least
   id on the full sets: a star, not all pairs.  The links are closed to components.
4. Buckets that still hold several components are completed: members outside the
   bucket's largest component are compared with every member of another component.
   The members are dealt to blocks of bounded size and the queries sent to each
   block; pairs whose signatures rule the threshold out (by 3.5 standard deviations)
   go no further, the others are checked on the full sets.  No bucket is capped.
5. The components are closed again by local union-find and distributed label
   propagation with pointer jumping.

Nothing is collected to the driver but counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.common import Scratch, arrow_batches, documents, pick

ROWS = 5
MISS = 1e-6
VALUES = 512
BLOCK = 512
CHUNK = 64


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands after which a pair at the threshold is missed with at most that chance."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def _binary(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Segments of an array as the bytes of one binary value each."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    off = np.concatenate(([0], np.cumsum(count))) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _sets(text: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = K.text_bytes(text)
    for a, b in K.slices(off):
        part = K.lower_ascii(buf[off[a] : off[b]])
        hashes, count = K.word_hashes(part, off[a : b + 1] - off[a])
        yield a, b, *K.shingle_sets(hashes, count, size)


def _names(sets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(K.segment_sums(K.mix(sets ^ np.uint64(salt)), n).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def signatures(docs: DataFrame, size: int, bands: int, rows: int = ROWS, values: int = VALUES) -> DataFrame:
    """id, n, hi, lo (name of the set), keys (one per band) and sketch (a byte per signature value)."""
    values = max(values, bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = K.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for a, b, sets, n in _sets(batch.column(1), size):
                hi, lo = _names(sets, n)
                sig = K.super_minhash(sets, n, values)
                mixed = K.mix(sig[:, : bands * rows])
                keys = (mixed.reshape(len(sig), bands, rows) * factor).sum(axis=2, dtype=np.uint64)
                keys = K.mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                some = (n > 0).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some))) * bands, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(hi), pa.array(lo), lists, _binary(K.mix(sig).astype(np.uint8), some), _binary(keys, some)], ["id", "n", "hi", "lo", "keys", "sketch", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, hi long, lo long, keys array<long>, sketch binary, bands binary")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) of the documents whose set has the name hi, lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want_hi, want_lo = (np.asarray(batch.column(k)) for k in (2, 3))
            for a, b, sets, n in _sets(batch.column(1), size):
                hi, lo = _names(sets, n)
                same = (hi == want_hi[a:b]) & (lo == want_lo[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _binary(sets, n)], ["id", "shingles"]).filter(pa.array(same))

    return docs.mapInArrow(run, "id long, shingles binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets reach the threshold.

    A popular ``a`` is dealt to chunks, each of which gets its set once and streams
    past the sets of its partners.
    """
    pairs = pairs.withColumn("part", F.expr(f"pmod(xxhash64(b), 1 + n_partners div {CHUNK})"))
    first = pairs.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    rest = pairs.select("a", "part", "b").join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, owner = np.zeros(0, np.uint64), None
        for batch in batches:
            found = ([], [])
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    mine, owner = own.copy(), a
                    continue
                assert owner == a
                at = np.searchsorted(mine, own)
                both = int((mine[np.minimum(at, len(mine) - 1)] == own).sum())
                if 100 * both >= percent * (len(mine) + len(own) - both):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    dealt = first.unionByName(rest).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """node, label (least node reachable) for every node of the undirected edges a, b.

    Union-find contracts the edges of each partition to stars first; then labels
    spread over the remaining edges with pointer jumping until none changes.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = [x for x in parent if root(x) != x]
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in some], pa.int64()), pa.array(some, pa.int64())], ["a", "b"])

    stars = scratch.save(edges.select("a", "b").mapInArrow(contract, "a long, b long"), f"{tag}-stars")
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), f"{tag}-0")
    for step in range(1, 200):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        merged = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        nxt = scratch.save(merged.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved")), f"{tag}-{step}")
        scratch.drop(f"{tag}-{step - 1}")
        labels = nxt.select("node", "label")
        if nxt.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("labels did not settle")
    return labels


def _residual(members: DataFrame, sketches: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs a, b of different components in the same bucket that the signatures do not rule out."""
    of = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("held"))
    top = of.groupBy("key").agg(F.max(F.struct("held", (-F.col("label")).alias("label"))).alias("top"), F.sum("held").alias("size"), F.count(F.lit(1)).alias("kinds"))
    top = top.filter("kinds > 1").select("key", (-F.col("top.label")).alias("major"), F.expr(f"1 + size div {BLOCK}").alias("blocks"))
    mixed = scratch.save(members.join(top, "key"), "mixed")
    sketches = scratch.save(sketches.join(mixed.select("rep").distinct(), "rep").dropDuplicates(["rep"]), "sketches")
    mixed = mixed.join(sketches, "rep")
    own = mixed.withColumn("block", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("query", F.lit(False))
    asked = mixed.filter("label <> major").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("query", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked = None, []
        for batch in batches:
            found = ([], [])
            key, block, query, rep, n, label = (batch.column(k).to_pylist() for k in range(6))
            sketch, bands = batch.column(6), batch.column(7)
            for i in range(len(batch)):
                if group != (key[i], block[i]):
                    group, asked, stacked = (key[i], block[i]), [], None
                own = np.frombuffer(sketch[i].as_buffer(), np.uint8)
                if query[i]:
                    asked.append((rep[i], n[i], label[i], own.copy(), np.frombuffer(bands[i].as_buffer(), np.int64).copy()))
                    continue
                if not asked:
                    continue
                if stacked is None:
                    stacked = tuple(np.array(x) for x in zip(*asked, strict=True))
                r, m, c, s, theirs = stacked
                size = s.shape[1]
                need = percent / 100 - 3.5 * math.sqrt(percent / 100 * (1 - percent / 100) / size)
                # A pair is taken in the first band that it shares, once.
                mine = np.frombuffer(bands[i].as_buffer(), np.int64)
                here = int(np.argmax(mine == key[i]))
                fit = (c != label[i]) & ~(theirs[:, :here] == mine[:here]).any(axis=1)
                fit &= (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i]))
                if fit.any():
                    like = np.flatnonzero(fit)[(s[fit] == own).sum(axis=1) >= need * size]
                    for x in r[like].tolist():
                        found[0].append(min(x, rep[i]))
                        found[1].append(max(x, rep[i]))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    columns = ("key", "block", "query", "rep", "n", "label", "sketch", "bands")
    dealt = own.select(*columns).unionByName(asked.select(*columns)).repartition("key", "block").sortWithinPartitions("key", "block", F.col("query").desc())
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Group near-duplicate documents.

    A document's set holds its distinct shingles of ``size`` words (ASCII lower case,
    words separated by ASCII white space); shorter ones have their whole sequence as
    the one shingle, and null, empty or blank texts have an empty set.  Documents are
    linked if 100 * intersection >= percent * union.  Returns, per row: the id,
    n_shingles, component_id (least id reachable) and kept (the id is the component's).
    Rows with an empty set or a null id are linked with nothing and kept (component_id
    is their own id); rows that repeat an id each get a row.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = scratch.save(signatures(base, size, bands_for(percent)), "signatures")

    named = sig.filter("n > 0 and id is not null")
    classes = scratch.save(named.groupBy("hi", "lo", "n").agg(F.min("id").alias("rep")), "classes")
    reps = named.select("hi", "lo", "n", F.col("id").alias("rep"), "keys").join(classes, ["hi", "lo", "n", "rep"])
    rows = reps.select("rep", "n", F.explode("keys").alias("key"))
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rep", "n")).alias("hub")).filter("size > 1").select("key", "hub")
    members = scratch.save(rows.join(crowded, "key"), "members")

    def partners(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("a", "b").distinct()
        return pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_partners")), "a")

    fits = F.expr(f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    stars = scratch.save(partners(members.filter("hub.rep <> rep").filter(fits).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))), "stars")

    names = classes.select(F.col("rep").alias("id"), "hi", "lo")

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        want = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(names, "id")
        return scratch.save(_full_sets(pick(base, want, ["id"]).select("id", "text", "hi", "lo"), size).dropDuplicates(["id"]), name)

    links = scratch.save(_confirm(stars, sets_of(stars, "star-sets"), percent), "star-links")
    scratch.drop("star-sets")
    labels = components(links, scratch, "first")
    known = members.select("key", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rest = scratch.save(partners(_residual(known, named.join(classes.withColumnRenamed("rep", "id"), ["hi", "lo", "n", "id"]).select(F.col("id").alias("rep"), "sketch", "bands"), scratch, percent)), "residual")
    more = scratch.save(_confirm(rest, sets_of(rest, "residual-sets"), percent), "residual-links")
    scratch.drop("residual-sets")
    if not more.isEmpty():
        star = labels.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
        labels = components(star.unionByName(more), scratch, "second")

    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", "n", F.coalesce("label", "rep").alias("component"))
    out = sig.select("id", "n", "hi", "lo").join(of_class, ["hi", "lo", "n"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("n") == 0) | (F.col("id") == F.col("component"))).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 85 percent or more."""
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)
