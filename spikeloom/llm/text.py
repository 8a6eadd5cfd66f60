"""Vectorised byte, word and n-gram helpers that run inside Arrow tasks.

A slice of a record batch is one contiguous byte buffer plus document bounds,
so hashing costs a fixed number of numpy passes whatever the row count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in one task; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_powers = {"p": np.ones(1, _U), "i": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor, shift, multiply rounds)."""
    x = np.asarray(x, _U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
#: One odd multiplier for each place of a word in an n-gram.
PLACE = mix(np.arange(1, 65, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to words: `space` (all but blanks and controls 9-13) or `alnum` (0-9, a-z, non-ASCII)."""
    t = np.ones(256, bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:0x80] = False
        t[0x30:0x3A] = True
        t[0x61:0x7B] = True
    return t


def _grow(n: int) -> None:
    if len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("p", _BASE), ("i", _INV)):
            a = np.full(size, base, _U)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=_U)


def prefix_of(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any range of a sequence of hashes."""
    _grow(len(h) + 1)
    out = np.zeros(len(h) + 1, _U)
    np.cumsum(h * _powers["p"][: len(h)], dtype=_U, out=out[1:])
    return out


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any byte range."""
    return prefix_of(_BYTE[buf])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    return mix((prefix[end] - prefix[start]) * _powers["i"][start] + (end - start).astype(_U) * PLACE[63])


@dataclass
class Slice:
    """Documents lo..hi-1 of a batch: bytes of all, start and end of each."""

    lo: int
    hi: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 30) -> Iterator[Slice]:
    """Cut a string column into buffers of about max_bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(col), lo + max_rows)
        b = off[lo : hi + 1] - off[lo]
        yield Slice(lo, hi, data[off[lo] : off[hi]], b[:-1], b[1:])
        lo = hi


@dataclass
class Words:
    """Words of a slice in order: byte bounds, and for each document the range of its words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray


def words(s: Slice, table: np.ndarray, buf: np.ndarray) -> Words:
    """Maximal runs of word bytes inside each document."""
    m = table[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[s.start] = edge[s.end] = True
    before = np.empty_like(m)
    after = np.empty_like(m)
    if len(m):
        before[0], before[1:] = False, m[:-1]
        after[-1], after[:-1] = False, m[1:]
    ws = np.flatnonzero(m & (~before | edge[:-1]))
    we = np.flatnonzero(m & (~after | edge[1:])) + 1
    return Words(ws, we, np.searchsorted(ws, s.start), np.searchsorted(ws, s.end))


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 places wrap into zeros."""
    pad = np.concatenate([h, np.zeros(n, _U)])
    out = np.zeros(len(h), _U)
    for k in range(n):
        out += pad[k : k + len(h)] * PLACE[k]
    return mix(out)


def whole_hash(h: np.ndarray, n: int) -> np.uint64:
    """Hash of a sequence of fewer than n words, distinct from every n-gram's."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.sum(h * PLACE[: len(h)], dtype=_U) + PLACE[32 + len(h)]], _U))[0]


def shingle_sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-word shingle hashes) for each text, lower-cased in A-Z."""
    table = word_table("space")
    for s in slices(col):
        buf = LOWER[s.buf]
        w = words(s, table, buf)
        h = span_hash(prefix_hash(buf), w.start, w.end)
        g = ngram_hash(h, n)
        for k in range(s.hi - s.lo):
            a, b = w.first[k], w.last[k]
            if b - a >= n:
                yield s.lo + k, np.unique(g[a : b - n + 1])
            elif b > a:
                yield s.lo + k, np.array([whole_hash(h[a:b], n)], _U)
            else:
                yield s.lo + k, np.zeros(0, _U)


def gather(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of many ranges, one after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def blobs(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def whole_groups(batches, key: str, rows: int = 50_000, size: int = 1 << 25) -> Iterator[pa.Table]:
    """Tables of whole groups, of about `rows` rows or `size` bytes, from batches that come in order of key (sortWithinPartitions)."""
    held, n, held_bytes = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n, held_bytes = n + b.num_rows, held_bytes + b.nbytes
        if n < rows and held_bytes < size:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(k == k[-1])[0])  # the last group may go on
        if not cut and held[0].column(key)[0] == b.column(key)[-1]:
            continue
        if not cut:
            t = pa.Table.from_batches(held)
            all_ = t.column(key).to_numpy()
            cut = int(np.flatnonzero(all_ == all_[-1])[0])
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
        else:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held = [b.slice(cut)]
        n, held_bytes = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def each_group(batches, key: str) -> Iterator[pa.Table]:
    """The rows of one key after another, from batches that come in order of key."""
    for t in whole_groups(batches, key):
        k = t.column(key).to_numpy()
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        for lo, hi in zip(at, np.append(at[1:], len(k)), strict=True):
            yield t.slice(lo, hi - lo)
