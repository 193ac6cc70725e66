"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled texts (a bounded sample) are dealt by a hash of the id.  Each half gives a
lexicon, words and word beginnings that toxic texts use far more often than others, and
gets its features from the lexicon of the other half, which has not seen it.  Five
sixths of these rows train the trees, one sixth calibrates their output to
probabilities; new texts are read with the lexicon of both halves.  Features are
densities of the learned and of a fixed lexicon, their nearness to second-person
words, capitals, punctuation, and signs of obfuscation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.common import Scratch, arrow_batches, crc_fold, documents, fresh
from tessella.llm.language_id import letters_only

#: Labelled rows at most; they are chosen by a hash of the id.
SAMPLE = 20_000
LEXICON = 3000
#: Toxic texts that a term of the lexicon is in, at least, however many labels there are.
LEAST = 3
PREFIXES = (4, 5, 6, 7)
NEAR = 5
TREES, DEPTH, RATE, BINS = 80, 3, 0.2, 32

# Common insults of four languages, and second-person words.
INSULTS = "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb ugly garbage filth jerk fool hate kill freak creep coward imbecile degenerate vermin dummkopf trottel abschaum widerlich arschloch idiota estúpido estúpida basura imbécil asqueroso inútil tonto connard imbécile ordure crétin débile dégoûtant nul"
SECOND_PERSON = "you your yours yourself yourselves u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"

_LEET = np.arange(256, dtype=np.uint8)
for _from, _to in zip(b"0134578@$!", b"oieastbasi", strict=True):
    _LEET[_from] = _to
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "*#$%&@!0134578+_^~"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in "!?"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True

FEATURES = (
    "log_bytes", "log_words", "lexicon_hits", "lexicon_density", "lexicon_weight", "lexicon_weight_density", "strongest",
    "fixed_hits", "fixed_density", "near_you", "you_density", "capital_letters", "capital_words", "exclaim_rate", "punctuation_rate",
    "symbol_rate", "inner_symbols", "single_letters", "repeated_letters", "hidden_hits", "word_length", "other_rate",
)


def hash_words(words: str) -> np.ndarray:
    """Sorted hashes of the words, as the features see them."""
    buf = letters_only(np.frombuffer(words.encode(), np.uint8))
    starts, ends, _ = K.spans(_LETTER[buf], np.array([0, len(buf)]))
    return np.unique(K.range_hash(K.prefix_hash(buf), starts, ends))


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[off]).astype(float)


def terms(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of letters: starts, ends, words per text; hashes of words and of their beginnings, with the word of each."""
    starts, ends, count = K.spans(_LETTER[low], off)
    prefix = K.prefix_hash(low)
    hashes, owner = [K.range_hash(prefix, starts, ends)], [np.arange(len(starts))]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        hashes.append(K.range_hash(prefix, starts[long], starts[long] + k) ^ np.uint64(0xABCD * k))
        owner.append(long)
    return starts, ends, count, hashes, owner


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x, at


@dataclass
class Lexicon:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    insults: np.ndarray = field(default_factory=lambda: hash_words(INSULTS))
    you: np.ndarray = field(default_factory=lambda: hash_words(SECOND_PERSON))


def features(buf: np.ndarray, off: np.ndarray, lex: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros, but 1 as its rate of other bytes."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    low = letters_only(buf)
    starts, ends, count, hashes, owner = terms(low, off)
    words = np.concatenate(([0], np.cumsum(count)))
    weight = np.zeros(len(starts))
    for h, o in zip(hashes, owner, strict=True):
        hit, at = _member(lex.keys, h)
        if hit.any():
            np.maximum.at(weight, o[hit], lex.weights[at[hit]])
    fixed, _ = _member(lex.insults, hashes[0])
    you, _ = _member(lex.you, hashes[0])
    bad = (weight > 0) | fixed
    seen = np.concatenate(([0], np.cumsum(you)))
    doc = np.repeat(np.arange(n), count)
    at = np.arange(len(starts))
    near = bad & (seen[np.minimum(at + NEAR + 1, words[1:][doc])] > seen[np.maximum(at - NEAR, words[:-1][doc])])
    capital = (buf >= 65) & (buf <= 90)
    letters = np.maximum(_per_doc(_LETTER[low], off), 1)
    caps = np.concatenate(([0], np.cumsum(capital)))
    all_caps = (ends - starts >= 3) & (caps[ends] - caps[starts] >= 0.8 * (ends - starts))
    # A symbol between two letters, and a letter three times in a row.
    symbol = _SYMBOL[buf]
    inner = np.zeros(len(buf), bool)
    if len(buf) > 2:
        inner[1:-1] = symbol[1:-1] & _LETTER[low[:-2]] & _LETTER[low[2:]]
    again = np.zeros(len(buf), bool)
    if len(buf) > 3:
        again[3:] = (low[3:] == low[2:-1]) & (low[3:] == low[1:-2]) & (low[3:] == low[:-3]) & _LETTER[low[3:]]
    # Neither reaches into the text before or after.
    begin, end = off[:-1][size > 0], off[1:][size > 0]
    inner[begin] = inner[end - 1] = False
    for k in range(3):
        again[np.minimum(begin + k, end - 1)] = False
    # Words after undoing common substitutions: hits that the plain reading misses.
    plain = letters_only(_LEET[buf])
    hidden = np.zeros(n)
    if symbol.any():
        s2, e2, _, h2, o2 = terms(plain, off)
        changed = np.concatenate(([0], np.cumsum(symbol)))
        odd = changed[e2] > changed[s2]
        found = _member(lex.insults, h2[0])[0]
        for h, o in zip(h2, o2, strict=True):
            found[o] |= _member(lex.keys, h)[0]
        hidden = np.bincount(np.searchsorted(off, s2[found & odd], "right") - 1, minlength=n)[:n].astype(float)
    sums = lambda x: np.bincount(doc, weights=x, minlength=n)[:n]
    strongest = np.zeros(n)
    np.maximum.at(strongest, doc, weight)
    w, b = np.maximum(count, 1), np.maximum(size, 1)
    hits, fixed_n = sums(weight > 0), sums(fixed)
    columns = (
        np.log1p(size), np.log1p(count), hits, hits / w, sums(weight), sums(weight) / w, strongest,
        fixed_n, fixed_n / w, sums(near), sums(you) / w, _per_doc(capital, off) / letters, sums(all_caps) / w, _per_doc(_END[buf], off) / b, _per_doc(_PUNCT[buf], off) / b,
        _per_doc(symbol, off) / b, _per_doc(inner, off) / w, sums(ends - starts == 1) / w, _per_doc(again, off) / b, hidden, sums(ends - starts) / w, 1 - _per_doc(_LETTER[low], off) / b * (size > 0),
    )
    return np.column_stack(columns)


@dataclass
class Trees:
    """Boosted trees for the log-odds of label 1; splits are on feature values."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                right = x[np.arange(len(x)), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Newton boosting of the logistic loss on quantile bins."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    f = np.full(len(y), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for d in range(DEPTH):
            for k in range(2**d - 1, 2 ** (d + 1) - 1):
                mine = np.flatnonzero(node == k)
                best = 1e-6
                if len(mine) >= 10:
                    gs, hs = g[mine].sum(), h[mine].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(bins[mine, j], g[mine], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(bins[mine, j], h[mine], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best:
                            best, feature[k], cut[k] = gain[i], j, c[i]
                node[mine] = 2 * k + 1 + (x[mine, feature[k]] > cut[k])
        at = node - (2**DEPTH - 1)
        leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        f += leaf[at]
        model.trees.append((feature, cut, leaf))
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw values and the non-decreasing rates at them."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # [sum of labels, rows, sum of raw]
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5 / len(y)) / (b[1] + 1 / len(y)) for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(features(buf, off, self.lexicon))
        smooth = 1 / (1 + np.exp(-raw))
        if self.knots is None:
            return smooth
        # A little of the uncalibrated score keeps the order within flat steps.
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 * smooth, 0, 1)


def _doc_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = K.text_bytes(batch.column(0))
        label = np.asarray(batch.column(1))
        for a, b in K.slices(off):
            _, _, count, hashes, owner = terms(letters_only(buf[off[a] : off[b]]), off[a : b + 1] - off[a])
            doc = np.repeat(np.arange(a, b), count)
            doc, term = np.concatenate([doc[o] for o in owner]), np.concatenate(hashes)
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(term[first].view(np.int64)), pa.array(label[doc[first]].astype(np.int32))], ["term", "toxic"])


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> Lexicon:
    """Terms of toxic texts: used by at least ``LEAST`` of them, and at a far higher rate than by others.

    The surest come first: those whose rate in toxic texts exceeds that in others by the most standard errors.
    """
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Lexicon()
    counts = rows.select("text", "toxic").mapInArrow(_doc_terms, "term long, toxic int").groupBy("term").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("a"))
    odds = F.log((F.col("b") + 0.5) / (n1 + 1)) - F.log((F.col("a") + 0.5) / (n0 + 1))
    # The standard error of log odds is about the root of 1 / b + 1 / a.
    sure = F.col("odds") / F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("a") + 0.5))
    top = counts.filter(F.col("b") >= LEAST).withColumn("odds", odds).filter("odds > 2").withColumn("sure", sure).filter("sure > 2").orderBy(F.desc("sure"), F.desc("b"), "term").limit(size).toArrow().to_pydict()
    keys = np.array(top["term"], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], np.array(top["odds"], float)[order])


def _features_of(rows: DataFrame, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch.column(0))
            for a, b in K.slices(off):
                x = features(buf[off[a] : off[b]], off[a : b + 1] - off[a], lex)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([lists, *(batch.column(k).slice(a, b - a) for k in (1, 2))], ["x", "toxic", "part"])

    t = rows.select("text", "toxic", "part").mapInArrow(run, "x array<double>, toxic int, part int").toArrow().to_pydict()
    return np.array(t["x"], float).reshape(-1, len(FEATURES)), np.array(t["toxic"], float), np.array(t["part"])


def fit(train: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """A model from rows (id, text, toxic 0 or 1); at most ``sample`` of them, by a hash of the id."""
    n = train.count()
    share = int((1 << 20) * min(1.0, sample / max(n, 1)))
    rows = train.filter(F.expr(f"pmod(xxhash64(id), {1 << 20}) < {share}")).withColumn("part", F.expr("cast(pmod(xxhash64(id, 7), 6) as int)"))
    rows = scratch.save(rows.select("text", F.col("toxic").cast("int").alias("toxic"), "part"), "toxicity-sample")
    folds = [learn_lexicon(rows.filter(f"part % 2 = {k}")) for k in (1, 0)]
    parts = [_features_of(rows.filter(f"part % 2 = {k}"), folds[k]) for k in (0, 1)]
    x, y, part = (np.concatenate([p[i] for p in parts]) for i in range(3))
    lex = learn_lexicon(rows)
    grow = part < 5
    if len(set(y[grow].tolist())) < 2 or grow.sum() < 20:
        rate = float(y.mean()) if len(y) else 0.0
        rate = min(max(rate, 1e-3), 0.499)
        return Model(lex, Trees(float(np.log(rate / (1 - rate)))), None)
    trees = boost(x[grow], y[grow])
    held = ~grow
    knots = isotonic(trees.raw(x[held]), y[held]) if len(set(y[held].tolist())) == 2 else None
    return Model(lex, trees, knots)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, learn=None, keep: tuple = ()) -> DataFrame:
    """Score every text for toxicity with a model learned from ``labels`` (id, label).

    ``learn`` is a condition on the id for the rows to learn from (all by default).
    Rows with a null id, a null label or without a document teach nothing; a document
    labelled more than once counts as toxic if any label says so.  Returns the id,
    score (0 to 1), predicted (1 if score >= 0.5) and the columns of ``keep``.  Null and
    empty texts are scored as texts without words; without labels of both kinds every
    text gets the same score below 0.5.  Repeated rows each get a row; an empty table
    gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    if learn is not None:
        marks = marks.filter(learn("id"))
    marks = marks.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = int((1 << 20) * min(1.0, 2 * sample / max(marks.count(), 1)))
    marks = marks.filter(F.expr(f"pmod(xxhash64(id), {1 << 20}) < {share}"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most about 2 * sample labels of 12 bytes are sent to every executor.
    train = scratch.save(texts.join(F.broadcast(marks), "id"), "labelled")
    model = fit(train, scratch, sample)
    base = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias(fresh("text")))
    names = base.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch.column(len(names)))
            for a, b in K.slices(off):
                s = model.score(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{fields}, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels whose crc32(doc_id) mod 5 is not 0."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, labels, learn=lambda c: crc_fold(c, 5) != 0, keep=("held_out",))
