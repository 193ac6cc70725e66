"""Language identification with error-correcting output codes.

Each language has a codeword, a row of +1 and -1.  For each bit a binary classifier
over hashed byte n-grams (naive Bayes log-odds of the languages with +1 against those
with -1) gives a margin, scaled by logistic regression.  A text gets the language
whose codeword has the least loss, with each bit weighted by how reliable its
classifier is on the training texts; a small lead over the runner-up flags ambiguity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.common import BROADCAST_ROWS, Scratch, arrow_batches, crc_fold, documents, fresh

#: Training texts (or a few more), shared out evenly over the languages; they are chosen by a hash of the id.
SAMPLE = 20_000
ORDERS = (1, 2, 3, 4)
DIM = 1 << 15
#: Least lead of the best language's score over the second, below which a text is ambiguous.
LEAD = 0.2
UNKNOWN = "und"

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def letters_only(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, other ASCII bytes as spaces."""
    out = _CLEAN[buf]
    upper = np.zeros(len(buf), bool)
    upper[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    out[upper] += 32
    return out


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    some = np.diff(np.concatenate(([0], np.cumsum(ascii_letter)))[off]) > 0
    wide = np.diff(np.concatenate(([0], np.cumsum(buf >= 0x80)))[off]) > 0
    for i in np.flatnonzero(wide & ~some):
        some[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return some


def grams(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order: the bucket of the n-gram at each byte, or DIM for none (past the text's end, two spaces)."""
    code = letters_only(buf)
    space = code == 0x20
    double = np.zeros(len(code), bool)
    double[:-1] = space[:-1] & space[1:]
    length = np.diff(off)
    value = np.zeros(len(code), np.uint32)
    skip = np.zeros(len(code), bool)
    for k in range(max(ORDERS)):
        value[: max(len(code) - k, 0)] |= code[k:].astype(np.uint32) << np.uint32(8 * k)
        if 0 < k <= len(code):
            skip[: len(code) - k] |= double[k - 1 : len(code) - 1]
        n = k + 1
        if n in ORDERS:
            mixed = (value * np.uint32(0x9E3779B1)) ^ (value >> np.uint32(15))
            idx = ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int32)
            idx[skip | (space if n == 1 else False)] = DIM
            for j in range(1, n):
                at = off[1:] - j
                idx[at[length >= j]] = DIM
            yield n, idx


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: dict[int, np.ndarray]  # order -> (DIM + 1) x bits
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def margins(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros((len(off) - 1, self.code.shape[1]))
        some = off[:-1] < off[1:]
        if not some.any():
            return out
        for n, idx in grams(buf, off):
            used = np.add.reduceat((idx != DIM).astype(np.int64), off[:-1][some])
            total = np.add.reduceat(self.weights[n][idx], off[:-1][some], axis=0)
            out[some] += total / np.maximum(used, 1)[:, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score and its lead over the second."""
        if len(self.langs) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins)), np.ones(len(margins))
        z = margins * self.scale + self.shift
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None]) @ self.trust
        score = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score /= score.sum(axis=1, keepdims=True)
        best = score.argmax(axis=1)
        top = np.sort(score, axis=1)
        return best, top[:, -1], top[:, -1] - top[:, -2]


def codewords(k: int) -> np.ndarray:
    """The exhaustive code for up to 6 languages, else rows of a seeded dense code with distinct columns."""
    if k <= 6:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(columns, float).T.reshape(k, -1)
    rng = np.random.default_rng(k)
    bits = int(np.ceil(10 * np.log2(k)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        near = (bits - (code @ code.T - np.eye(k) * 2 * bits)).min() / 2
        if near > apart:
            best, apart = code, near
    return best


def _counts(sample: DataFrame) -> dict[str, np.ndarray]:
    """n-gram counts by language, summed on the executors: orders x (DIM + 1) numbers a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            buf, off = K.text_bytes(batch.column(0))
            for a, b in K.slices(off):
                o = off[a : b + 1] - off[a]
                for k, (_, idx) in enumerate(grams(buf[off[a] : off[b]], o)):
                    for x in set(lang[a:b]):
                        mine = np.repeat(lang[a:b] == x, np.diff(o))
                        held.setdefault(x, np.zeros((len(ORDERS), DIM + 1), np.int64))[k] += np.bincount(idx[mine], minlength=DIM + 1)
        for x, c in held.items():
            order, bucket = np.nonzero(c[:, :DIM])
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(order), pa.string()), pa.array(order, pa.int32()), pa.array(bucket, pa.int32()), pa.array(c[order, bucket])], ["lang", "k", "bucket", "n"])

    rows = sample.select("text", "lang").mapInArrow(run, "lang string, k int, bucket int, n long")
    table = rows.groupBy("lang", "k", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    out: dict[str, np.ndarray] = {}
    langs, k, bucket, n = (np.array(table[c]) for c in ("lang", "k", "bucket", "n"))
    for x in sorted(set(langs.tolist())):
        m = langs == x
        out[x] = np.zeros((len(ORDERS), DIM + 1))
        out[x][k[m], bucket[m]] = n[m]
    return out


def _apply_margins(sample: DataFrame, model: Model) -> tuple[list[str], np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch.column(0))
            for a, b in K.slices(off):
                z = model.margins(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), lists], ["lang", "z"])

    rows = sample.select("text", "lang").mapInArrow(run, "lang string, z array<double>").toArrow().to_pydict()
    return rows["lang"], np.array(rows["z"])


def fit(train: DataFrame, scratch: Scratch, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model | None:
    """A model from the rows of ``train`` (some ``sample`` of them, of each language alike, by a hash of the id); None without rows."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and text is not null")
    # As many texts of every language as of the others, where it has so many: rare ones are learned too.
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = per.count()
    if languages == 0:
        return None
    least = max(1, sample // languages)
    # Some 5 standard deviations more than the least number, so that a small share does not miss it.
    share = per.select("lang", F.least(F.lit(1.0), (least + 5 * F.sqrt(F.lit(least))) / F.col("n")).alias("share"))
    known = F.broadcast(share) if languages <= BROADCAST_ROWS else share
    chosen = rows.join(known, "lang").filter(F.expr(f"pmod(xxhash64(id), {1 << 20}) < share * {1 << 20}"))
    chosen = scratch.save(chosen.select("id", "text", "lang"), "language-sample")
    counts = _counts(chosen)
    if not counts:
        return None
    langs = sorted(counts)
    code = codewords(len(langs)) if len(langs) > 1 else np.ones((1, 1))
    weights = {}
    for k, order in enumerate(ORDERS):
        p = np.array([counts[x][k, :DIM] + 0.5 for x in langs])
        p /= p.sum(axis=1, keepdims=True)
        w = np.zeros((DIM + 1, code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            plus, minus = code[:, b] > 0, code[:, b] < 0
            if plus.any() and minus.any():
                w[:DIM, b] = np.log(p[plus].mean(axis=0)) - np.log(p[minus].mean(axis=0))
        weights[order] = w
    bits = code.shape[1]
    model = Model(langs, code, weights, np.ones(bits), np.zeros(bits), np.ones(bits))
    if len(langs) > 1:
        names, z = _apply_margins(chosen, model)
        truth = code[[langs.index(x) for x in names]]
        for b in range(bits):
            model.scale[b], model.shift[b] = _logistic(z[:, b], truth[:, b])
            right = ((z[:, b] * model.scale[b] + model.shift[b]) * truth[:, b] > 0).mean()
            model.trust[b] = max(0.05, 2 * right - 1)
        model.trust *= 2 / model.trust.sum() * np.log2(len(langs) + 1)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Scale and shift of a logistic regression of y (+1, -1) on x, by Newton steps."""
    sd = x.std() or 1.0
    a = np.column_stack((x / sd, np.ones(len(x))))
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - (y > 0)) / len(x) + ridge * np.array([w[0], 0.0])
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a / len(x) + np.diag([ridge, 1e-6])
        w -= np.linalg.solve(h, g)
    return float(w[0] / sd), float(w[1])


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, keep: tuple = ()) -> DataFrame:
    """Predict the language of every text with a model learned from ``train``.

    Returns the id, lang_pred, score (0 to 1), ambiguous and the columns of ``keep``.
    A text that is null or has no letter gets ``und`` with score 0, as does every text
    if there is nothing to learn from; with one language learned, other texts get it
    with score 1.  Null ids and repeated rows are predicted like others; an empty table
    gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    model = fit(train, scratch, id_col, text_col, lang_col, sample)
    base = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias(fresh("text")))
    names = base.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch.column(len(names)))
            for a, b in K.slices(off):
                part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                known = has_letter(part, o)
                if model is None:
                    lang, score, unsure = [UNKNOWN] * (b - a), np.zeros(b - a), np.ones(b - a, bool)
                else:
                    best, score, lead = model.decode(model.margins(part, o))
                    lang = [model.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
                    score, unsure = np.where(known, score, 0.0), ~known | (lead < LEAD)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*names, "lang_pred", "score", "ambiguous"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    train = docs.filter("not held_out and doc_id is not null")
    return identify(docs, train, keep=("held_out",))
