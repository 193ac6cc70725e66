"""Spelling variants: words that one edit turns into much more frequent ones.

Words one insertion, deletion or replacement apart share what is before and what is
after the edit, so one of the halves of the shorter word is intact in both.

1. Tasks count words and sum them up before they are shuffled; the frequent ones are the
   dictionary.
2. The dictionary is sorted forward, and reversed.  A range of the forward one shares the
   first half of the shorter word, a range of the reversed one the last half.  Each word
   stands among those of its length and one longer, and those one shorter and its own.
3. Ranges are scanned and their pairs verified, in blocks of bounded size.  A larger block
   is subdivided: what its words do not share yet is halved in the same way, into
   blocks that share more at the front or more at the back, until they are small.  A
   block that leaves one place open holds no more words than the alphabet has ways to
   fill it.
4. Every pair is verified in one block only: a block that shares the back leaves out
   pairs whose common prefix makes them meet at the front.

Each word then takes its most frequent near word as its form, if that is frequent enough,
and the forms are followed to their roots by doubling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.common import Scratch, arrow_batches, documents, salted_join
from tessella.llm.terms import summed, term_array

#: Code points and occurrences that a word of the dictionary has at least.
LETTERS = 6
OCCURRENCES = 5
#: A form is at least so many times as frequent.
TIMES = 5
#: One in so many runs (by the crc32 of id and run) loses a code point.
SLIPS = 199
#: Words of a block whose pairs are verified as they are; pairs and words that are held, and letters of pairs that are verified, at once.
BLOCK = 100
PAIRS = 200_000
WORDS = 20_000
PAIR_LETTERS = 1_000_000
#: Bytes of text that are counted at once, and the longest run whose checksum is put together from tables.
COUNT_BYTES = 2_000_000
TABLE_BYTES = 48

_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_CRC = np.array([zlib.crc32(bytes([k])) for k in range(256)], np.uint32)
#: The crc32 of one byte after another state is table[state ^ byte] ^ state >> 8; feeding a zero byte shifts a state.
_SHIFT = _CRC ^ _CRC[0]


def _letters(buf: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which are C3 and the byte that follows."""
    lead = buf == 0xC3
    out = _ASCII[buf] | lead
    out[1:] |= lead[:-1]
    return out


def _shifted(state: np.ndarray) -> np.ndarray:
    """A checksum followed by one more byte, without that byte's own part."""
    return _SHIFT[(state & np.uint32(0xFF)).astype(np.int64)] ^ (state >> np.uint32(8))


def _slips(ids: list[str], doc: np.ndarray, code: np.ndarray, names: pa.Array) -> np.ndarray:
    """crc32 of ``<id>:<run>`` for every run: the checksum of the id, shifted by the run's bytes, and that of the run."""
    size = np.diff(np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1])
    own = np.fromiter((zlib.crc32(x.as_py().encode()) for x in names), np.uint32, len(names))
    state = np.fromiter((zlib.crc32(f"{x}:".encode()) for x in ids), np.uint32, len(ids))
    width = int(min(size.max(initial=0), TABLE_BYTES))
    table = np.empty((width + 1, len(ids)), np.uint32)
    table[0] = state
    for k in range(width):
        table[k + 1] = _shifted(table[k])
    out = table[np.minimum(size[code], width), doc] ^ own[code]
    for k in np.flatnonzero(size[code] > width):
        out[k] = zlib.crc32(names[int(code[k])].as_py().encode(), int(state[doc[k]]))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        ids = ["" if x is None else str(x) for x in batch.column(0).to_pylist()]
        buf, off = K.text_bytes(batch.column(1))
        for a, b in K.slices(off, COUNT_BYTES):
            part = K.lower_ascii(buf[off[a] : off[b]])
            runs, doc = term_array(part, _letters(part), off[a : b + 1] - off[a])
            runs = runs.dictionary_encode()
            names, code = runs.dictionary, runs.indices.to_numpy().astype(np.int64)
            h = _slips(ids[a:b], doc, code, names)
            slip = h % np.uint32(SLIPS) == 0
            n = np.bincount(code[~slip], minlength=len(names))
            cut = []
            for k in np.flatnonzero(slip):
                run = names[int(code[k])].as_py()
                at = int(h[k]) % len(run)
                cut.append(run[:at] + run[at + 1 :])
            words = pa.concat_arrays([names, pa.array(cut, pa.large_string())])
            yield pa.table({"word": words.cast(pa.string()), "n": np.concatenate((n, np.ones(len(cut), np.int64)))})


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the words of a task's documents (id, text), slips applied."""
    return summed(_counted(batches), ["word"], ["n"])


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """Words (column word) and their occurrences (n, long) in all texts."""
    base = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull())
    counts = base.mapInArrow(word_counts, "word string, n long").filter(F.char_length("word") >= letters).filter("n > 0")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


#: A word of a block: ``short`` is the length of the shorter word of its pairs, ``front`` and ``back`` what they are known
#: to share, and pairs with a common prefix of ``bar`` or more belong elsewhere.
STATE = ["side", "short", "front", "back", "bar"]
LINKS = "word string, n long, near string, near_n long"


def _started(words: DataFrame) -> DataFrame:
    """Every word in four blocks: first and last half of the shorter word, which it is or is one longer than."""
    size = F.char_length("word").cast("int")
    roles = F.explode(F.array(size, size - 1)).alias("short")
    half = "short div 2"
    out = words.select("word", "n", roles).filter("short >= 1")
    sides = f"inline(array(struct('f' as side, int({half}) as front, 0 as back, {1 << 30} as bar), struct('r' as side, 0 as front, int({half}) as back, int({half}) as bar)))"
    return _keyed(out.select("word", "n", "short", F.expr(sides)).filter("front < bar"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The key that sorts a word into its block: what it shares, from the front in the forward dictionary, from the back in the reversed one."""
    first, last = F.expr("substring(word, 1, front)"), F.reverse(F.expr("right(word, back)"))
    key = F.when(F.col("side") == "f", F.concat(first, F.lit("\0"), last)).otherwise(F.concat(last, F.lit("\0"), first))
    return rows.withColumn("key", key)


def _subdivided(rows: DataFrame) -> DataFrame:
    """What a block's words do not share yet is halved: its first half goes to the front, or its last half to the back."""
    half = "int(greatest((short - front - back) div 2, 1))"
    sides = f"""inline(array(struct('f' as side_, front + {half} as front_, back as back_, bar as bar_),
        struct('r' as side_, front as front_, back + {half} as back_, int(least(bar, front + {half})) as bar_)))"""
    out = rows.select("word", "n", "short", F.expr(sides))
    return _keyed(out.select("word", "n", "short", *(F.col(f"{c}_").alias(c) for c in ("side", "front", "back", "bar"))).filter("front < bar"))


def _verified(letters: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """Which pairs differ by one edit and belong to their block: prefix and suffix in common together cover the shorter word.

    ``letters`` and ``size`` are of what the words of a block do not share; ``bar`` counts from there.
    """
    x, y = letters[a], letters[b]
    width = letters.shape[1]
    short, apart = np.minimum(size[a], size[b]), np.abs(size[a] - size[b])
    same = x == y
    prefix = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
    # Letters stand from the left; the suffixes are compared from the right.
    at = np.arange(width)[None, :]
    back = np.take_along_axis(x, np.maximum(size[a][:, None] - 1 - at, 0), 1) == np.take_along_axis(y, np.maximum(size[b][:, None] - 1 - at, 0), 1)
    back &= at < short[:, None]
    suffix = np.where(back.all(axis=1), width, (~back).argmax(axis=1))
    prefix = np.minimum(prefix, short)
    edit = np.where(apart == 0, prefix + suffix >= short - 1, (apart == 1) & (prefix + suffix >= short))
    return edit & (prefix < bar)


def near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans sorted blocks (word, n, side, short, front, back, bar, key) and gives the near pairs of each, both ways round."""
    names = ["word", "n", "near", "near_n"]
    held: list[tuple] = []
    block, mark, pairs, words, widest = [], None, 0, 0, 1

    def flush() -> pa.RecordBatch:
        word = np.array([r[0] for b in held for r in b], object)
        n = np.array([r[1] for b in held for r in b], np.int64)
        # What a block's words share at the front and the back is left out: one edit between them is one between the rest.
        rest = [r[0][r[4] : len(r[0]) - r[5]] for b in held for r in b]
        size = np.array([len(w) for w in rest], np.int64)
        letters = np.zeros((len(word), int(size.max(initial=1))), np.uint32)
        for k, w in enumerate(rest):
            letters[k, : size[k]] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        left, right, bar, begin = [], [], [], 0
        for b in held:
            short = b[0][3] - b[0][4] - b[0][5]
            own = np.flatnonzero(size[begin : begin + len(b)] == short) + begin
            more = np.flatnonzero(size[begin : begin + len(b)] != short) + begin
            i, j = np.triu_indices(len(own), 1)
            left += [own[i], np.repeat(own, len(more))]
            right += [own[j], np.tile(more, len(own))]
            bar.append(np.full(len(i) + len(own) * len(more), b[0][6] - b[0][4]))
            begin += len(b)
        left, right, bar = (np.concatenate(x) for x in (left, right, bar))
        found, step = [np.zeros(0, np.int64)], max(1, PAIR_LETTERS // letters.shape[1])
        for k in range(0, len(left), step):
            cut = slice(k, k + step)
            found.append(k + np.flatnonzero(_verified(letters, size, left[cut], right[cut], bar[cut])))
        found = np.concatenate(found)
        a, b = np.concatenate((left[found], right[found])), np.concatenate((right[found], left[found]))
        return pa.RecordBatch.from_arrays([pa.array(word[a], pa.string()), pa.array(n[a]), pa.array(word[b], pa.string()), pa.array(n[b])], names)

    def close() -> Iterator[pa.RecordBatch]:
        """Holds the block that ends.  Held words take as many letters as the widest of them, so a wide block does not join many others."""
        nonlocal held, pairs, words, widest
        if len(block) < 2:
            return
        own = block[0][3] - block[0][4] - block[0][5] + 1
        more = words + len(block)
        if held and (pairs > PAIRS or more > WORDS or more * max(widest, own) > PAIR_LETTERS):
            yield flush()
            held, pairs, words, widest = [], 0, 0, 1
        held.append(tuple(block))
        pairs, words, widest = pairs + len(block) ** 2 // 2, words + len(block), max(widest, own)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if mark != (row[2], row[3], row[4], row[5], row[6], row[7]):
                yield from close()
                block, mark = [], (row[2], row[3], row[4], row[5], row[6], row[7])
            block.append(row)
    yield from close()
    if held:
        yield flush()


def near_words(words: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """All ordered pairs (word, n, near, near_n) of distinct words that one edit turns into each other.

    Words must be distinct.  A round counts the blocks, scans the small ones and
    subdivides the others; there are as many rounds as halvings of the longest word.
    """
    scratch = scratch or Scratch(words.sparkSession)
    on = [*STATE, "key"]
    rows, found, k = scratch.save(_started(words), "blocks-0"), [], 0
    while True:
        held = scratch.save(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("held"), F.max(F.col("short") - F.col("front") - F.col("back")).alias("open")).filter("held > 1"), f"sizes-{k}")
        total = held.agg(F.sum("held")).first()[0] or 0
        dealt = scratch.save(salted_join(rows, held, on, "held", total), f"dealt-{k}")
        small = (F.col("held") <= block) | (F.col("open") <= 1)
        scan = dealt.filter(small).select("word", "n", *on).repartitionByRange("side", "key", "short", "front", "back", "bar").sortWithinPartitions("side", "key", "short", "front", "back", "bar")
        found.append(scratch.save(scan.mapInArrow(near_in_blocks, LINKS), f"near-{k}"))
        rest = dealt.filter(~small)
        if rest.isEmpty():
            break
        k += 1
        rows = scratch.save(_subdivided(rest), f"blocks-{k}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def spelling_groups(words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """The form and root of every word of a dictionary (word, distinct; n).

    Two words are near if one inserted, deleted or replaced code point turns one into the
    other.  The form of a word is its near word of largest n (ties: the smallest in
    code-point order), if that n is at least ``times`` the word's; forms are followed to
    the root, the word itself if it has none.  Returns word, form, root, n, n_near and
    form_n.  An empty dictionary gives an empty result; other columns are ignored.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.save(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, block, scratch).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    best = F.when(-F.col("best.n") >= times * F.col("n"), F.col("best"))
    formed = scratch.save(words.join(near, "word", "left").select("word", best["near"].alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-best["n"]).alias("form_n")), "formed")
    # Each round doubles the way that a root is from its word; n grows with every step, so that no way is long or closed.
    ways, k = scratch.save(formed.filter("form is not null").select("word", F.col("form").alias("root")), "ways-0"), 0
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        k += 1
        met = scratch.save(met, f"ways-{k}")
        ways = met.drop("moved")
        if met.filter("moved").isEmpty():
            break
    out = formed.join(ways, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Spelling groups of the words of all texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; a null text has
    none, a null id counts as the empty one, and rows that repeat an id are counted each.
    An empty table gives an empty result; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    return spelling_groups(dictionary(docs, id_col, text_col), **how)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(documents(spark, sf_dir))
