"""NumPy kernels over Arrow text columns.

Every kernel works on the UTF-8 bytes of a whole batch at once: ``text_bytes``
exposes an Arrow string column as one byte buffer with document offsets, and the
others find words, hash them and build shingle sets without making a Python
string per word.  Callers feed bounded slices (see ``slices``), so the working
arrays stay small whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the kernels take at once (a longer document is taken alone).
SLICE_BYTES = 500_000

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 20)
        up, down = np.full(m, _MUL), np.full(m, _MULT_INV)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of documents of at most ``limit`` bytes together, or one document."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross documents: starts, ends, runs per document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    head[first] = inside[first]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    last = off[1:][off[:-1] < off[1:]] - 1
    tail[last] = inside[last]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.diff(np.searchsorted(starts, off))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the runs of bytes other than ``[\\x20\\x09-\\x0D]``: starts, ends, words per document."""
    return spans(~_WS[buf], off)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial byte hash (length n + 1), for ``range_hash``."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, independent of where they lie."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the number of words of each document."""
    starts, ends, count = words(buf, off)
    return range_hash(prefix_hash(buf), starts, ends), count


def shingle_sets(hashes: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document and their numbers.

    A shingle is ``size`` consecutive words; a document with fewer words, but at
    least one, has its whole sequence as its one shingle.
    """
    n_sh = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    word_at = np.concatenate(([0], np.cumsum(count)))[:-1]
    sh_off = np.concatenate(([0], np.cumsum(n_sh)))
    at = np.repeat(word_at - sh_off[:-1], n_sh) + np.arange(sh_off[-1])
    width = np.repeat(np.minimum(count, size), n_sh)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    out = width.astype(np.uint64)
    for k in range(size):
        word = padded[at + k]
        out = np.where(k < width, mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + word), out)
    for a, b in zip(sh_off[:-1], sh_off[1:], strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[sh_off[:-1][n_sh > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], np.diff(kept[sh_off])


def segment_sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, wrapping around for unsigned integers; empty ones give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    at = np.concatenate(([0], np.cumsum(count)))
    return total[at[1:]] - total[at[:-1]]


def super_minhash(sets: np.ndarray, count: np.ndarray, m: int, seed: int = 0, chunk: int = 100_000, cells: int = 1 << 23) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` 64-bit values for each non-empty set.

    Element ``d`` walks through the slots in the order of its own random
    permutation; its value at the slot of rank ``j`` is ``j + r`` with ``r`` from
    [0, 1), and a slot keeps the least value over the elements.  All elements take
    step ``j`` together, and a set stops as soon as each of its slots holds a
    value: a slot filled at rank ``j`` cannot be lowered by any later rank.  The
    permutations come from a Fisher-Yates shuffle driven by the element's hash.

    Sets are taken in the order of their size, so that those of one call stop after
    like numbers of steps.  Only sets of fewer than ``m`` elements are likely to need
    whole permutations: their calls hold at most ``cells`` numbers of permutations
    (16 MB), the others' at most ``chunk`` elements, or one set.
    """
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    some = count > 0
    begin, count = begin[some], count[some]
    out = np.empty((len(count), m), np.uint64)
    order = np.argsort(count, kind="stable")
    upto = np.concatenate(([0], np.cumsum(count[order])))
    k = 0
    while k < len(order):
        most = chunk if count[order[k]] >= m else min(chunk, max(cells // m, 1))
        end = min(max(int(np.searchsorted(upto, upto[k] + most, "right")) - 1, k + 1), len(order))
        mine = order[k:end]
        n = count[mine]
        at = np.repeat(begin[mine] - (upto[k:end] - upto[k]), n) + np.arange(upto[end] - upto[k])
        got = np.empty((len(mine), m), np.uint64)
        _walk(sets[at], n, m, seed, got)
        out[mine] = got
        k = end
    return out


#: Steps up to which a shuffle is kept as the swaps made so far; few sets go further.
_SWAPS = 10


def _walk(elements: np.ndarray, count: np.ndarray, m: int, seed: int, out: np.ndarray) -> None:
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out[:] = empty
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
    state = mix(elements ^ mix(np.full(1, seed + 1, np.uint64)))
    picks: list[np.ndarray] = []  # position that step i swapped with position i
    moved: list[np.ndarray] = []  # and the slot that it moved there
    perm: np.ndarray | None = None
    for j in range(m):
        if j:
            live = (out == empty).any(axis=1)[owner]
            if not live.any():
                return
            # A full set cannot change any more: it goes when enough others go with it.
            if live.mean() < 0.7:
                owner, state = owner[live], state[live]
                if perm is None:
                    picks, moved = [x[live] for x in picks], [x[live] for x in moved]
                else:
                    perm = perm[live]
        if j == _SWAPS:
            perm = np.tile(np.arange(m, dtype=np.int16), (len(owner), 1))
            rows = np.arange(len(owner))
            for pick, slot in zip(picks, moved, strict=True):
                perm[rows, pick] = slot
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        pick = (j + (state >> np.uint64(40)) % np.uint64(m - j)).astype(np.int16)
        if perm is None:
            slot, here = pick.copy(), np.full(len(pick), j, np.int16)
            for before, what in zip(picks, moved, strict=True):
                np.copyto(slot, what, where=before == pick)
                np.copyto(here, what, where=before == j)
            picks.append(pick)
            moved.append(here)
        else:
            rows = np.arange(len(owner))
            slot = perm[rows, pick]
            perm[rows, pick] = perm[:, j]
        value = (np.uint64(j) << np.uint64(56)) | (mix(state ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(8))
        np.minimum.at(flat, owner.astype(np.int64) * m + slot, value)
