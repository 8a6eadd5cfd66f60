"""Periodic runs of words, found with string synchronising sets.

At scale t = 1, 2, 4, ... a place is selected if, of the hashes of the t words
from each of the places i to i + t on, the least is that at i or that at i + t.
The choice depends on 2t words only, so copies of a passage choose alike, and
every 2t places hold a selected one unless all their t-word strings are highly
periodic (period of at most t / 4), which take no part. A run of period q from
t to 2t - 1 and four or more periods therefore has a selected place whose next
place with equal context (2t words) is exactly q further: such pairs propose
all periods. Highly periodic regions need no hashes: they are the runs found at
smaller scales. What is proposed is extended both ways and compared word by word.

Documents never depend on each other, so nothing is shuffled; a task works on
slices of about two million bytes, and on a longer document by itself.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import text as X

#: A reported run has at least this many words and periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_U = np.uint64
_TOP = _U((1 << 64) - 1)
_JOIN = (X.PLACE[11], X.PLACE[12])


def word_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word; equal for equal bytes only."""
    if not len(start):
        return np.zeros(0, np.int64)
    size = end - start
    off = np.append(0, np.cumsum(size)).astype(np.int64)
    data = buf[X.gather(size, start)]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i that has so many."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def selected(h: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set: places whose hash of t words, or that t places further, is the least of t + 1; periodic ones take no part."""
    key = np.where(periodic, _TOP, h)
    if len(key) <= t:
        return np.zeros(0, np.int64)
    low = sliding_min(key, t + 1)
    return np.flatnonzero((low != _TOP) & ((low == key[: len(low)]) | (low == key[t:])))


def proposals(place: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected places with the distance to the next one of equal context, where that is from t to 2t - 1."""
    order = np.argsort(context, kind="stable")
    c, p = context[order], place[order]
    q = p[1:] - p[:-1]
    ok = (c[1:] == c[:-1]) & (q >= t) & (q < 2 * t)
    return p[:-1][ok], q[ok]


def extend(ids: np.ndarray, prefix: np.ndarray, at: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest stretch around each place, inside [lo, hi), in which words q apart have equal hashes."""

    def search(most: np.ndarray, equal) -> np.ndarray:
        good, bad = np.zeros(len(most), np.int64), most + 1
        while len(go := np.flatnonzero(bad - good > 1)):
            mid = (good[go] + bad[go]) >> 1
            fits = equal(go, mid)
            good[go] = np.where(fits, mid, good[go])
            bad[go] = np.where(fits, bad[go], mid)
        return good

    left = search(at - lo, lambda k, n: X.span_hash(prefix, at[k] - n, at[k]) == X.span_hash(prefix, at[k] + q[k] - n, at[k] + q[k]))
    right = search(hi - at - q, lambda k, n: X.span_hash(prefix, at[k], at[k] + n) == X.span_hash(prefix, at[k] + q[k], at[k] + q[k] + n))
    return at - left, at + q + right


def exact(ids: np.ndarray, at: int, q: int, start: int, end: int, lo: int, hi: int) -> tuple[int, int]:
    """The stretch [start, end) of period q around at; sought word by word if a hash was mistaken."""
    if (ids[start : end - q] == ids[start + q : end]).all():
        return start, end
    differ = np.flatnonzero(ids[lo : hi - q] != ids[lo + q : hi]) + lo
    k = int(np.searchsorted(differ, at))
    if k < len(differ) and differ[k] == at:
        return at, at
    return (int(differ[k - 1]) + 1 if k else lo), (int(differ[k]) + q if k < len(differ) else hi)


def runs(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of four or more of their smallest periods in the documents ids[first:last].

    Starts are places in ids, in order of document, start and period.
    """
    found = [np.zeros(0, np.int64)] * 3
    if not len(ids):
        return tuple(found)
    # what lies between documents equals nothing
    gap = np.zeros(len(ids) + len(first), bool)
    gap[last + np.arange(len(last))] = True
    v = np.empty(len(gap), np.int64)
    v[~gap], v[gap] = ids, -1 - np.arange(len(first))
    lo = first + np.arange(len(first))
    hi = last + np.arange(len(first))
    h, t = X.mix(v.astype(_U)), 1
    prefix = X.prefix_of(h)
    home = np.arange(len(v))  # place in v of each entry of h
    while True:
        keep = hi - lo >= LEAST_PERIODS * t
        if not keep.any():
            break
        if keep.mean() < 1:  # shorter documents hold no period of this scale
            cells = (hi - lo + 1)[keep]
            at = X.gather(cells, lo[keep])
            place = np.searchsorted(home, at)
            ok = (place < len(home)) & (home[np.minimum(place, len(home) - 1)] == at)
            h, home = h[place[ok]], home[place[ok]]
            lo, hi = lo[keep], hi[keep]
        periodic = np.zeros(len(v) + 1, np.int64)
        s, e, q = found
        use = (LEAST_PERIODS * q <= t) & (e - s >= t)
        np.add.at(periodic, s[use], 1)
        np.add.at(periodic, e[use] - t + 1, -1)
        periodic = np.cumsum(periodic)[home] > 0
        place = selected(h, t, periodic)
        place = place[place + t < len(h)]
        wide = h[:-t] * _JOIN[0] + X.mix(h[t:]) * _JOIN[1] if len(h) > t else h[:0]  # hashes of 2t words
        at, q = proposals(place, X.mix(wide[place]), t)
        at = home[at]
        d = np.searchsorted(lo, at, "right") - 1
        ok = (d >= 0) & (at + q < hi[d])
        at, q, d = at[ok], q[ok], d[ok]
        if len(at):
            start, end = extend(v, prefix, at, q, lo[d], hi[d])
            _, one = np.unique(np.stack([start, q]), axis=1, return_index=True)
            kept = [(*exact(v, int(at[k]), int(q[k]), int(start[k]), int(end[k]), int(lo[d[k]]), int(hi[d[k]])), int(q[k])) for k in one[(end - start >= LEAST_PERIODS * q)[one]]]
            kept = np.array([r for r in dict.fromkeys(kept) if r[1] - r[0] >= LEAST_PERIODS * r[2]], np.int64).reshape(-1, 3)
            found = [np.concatenate([a, b]) for a, b in zip(found, kept.T, strict=True)]
        h, home = X.mix(wide), home[: len(wide)]
        t *= 2
    s, e, q = found
    order = np.lexsort((q, s))
    s, e, q = s[order], e[order], q[order]
    shift = np.cumsum(gap)[s] if len(s) else s
    return s - shift, e - shift, q


def _rewritten(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place, for the documents that the query makes periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def periodic_runs(docs: DataFrame, rewrite: bool = False, with_text: bool = False) -> DataFrame:
    """Runs of words of every text, and the text without what only repeats.

    Returns doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256 (and, with_text, runs as array of structs and collapsed as
    binary) per input row; null texts have no words, rows that repeat an id are
    independent, other columns are left aside. With rewrite, one document in ten
    (by crc32 of doc_id; never one without an id) is made periodic first.
    """

    def work(batches):
        table = X.word_table("space")
        for b in batches:
            own = b.column("doc_id")
            for s in X.slices(b.column("text")):
                w = X.words(s, table, s.buf)
                ids, at = word_ids(s.buf, w.start, w.end), np.arange(len(w.start))
                doc = [own[k].as_py() for k in range(s.lo, s.hi)]
                for k in range(len(doc)) if rewrite else ():
                    if (new := _rewritten(int(w.last[k] - w.first[k]), doc[k])) is not None:
                        at[w.first[k] : w.last[k]] = w.first[k] + new
                start, end, period = runs(ids[at], w.first, w.last)
                gone = np.zeros(len(at) + 1, np.int64)
                long = end - start >= LEAST_WORDS
                start, end, period = start[long], end[long], period[long]
                np.add.at(gone, start + period, 1)
                np.add.at(gone, end, -1)
                kept = np.cumsum(gone)[:-1] == 0
                cut = np.searchsorted(start, np.stack([w.first, w.last]))
                rows = []
                for k, d in enumerate(doc):
                    lo, hi = int(w.first[k]), int(w.last[k])
                    mine = [(int(x) - lo, int(y - x), int(q)) for x, y, q in zip(*(c[cut[0, k] : cut[1, k]] for c in (start, end, period)), strict=True)]
                    best = max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    use = at[lo:hi][kept[lo:hi]]
                    size = w.end[use] - w.start[use] + 1
                    data = s.buf[np.minimum(X.gather(size, w.start[use]), max(0, len(s.buf) - 1))]
                    data[np.cumsum(size) - 1] = 0x20
                    data = data[:-1].tobytes()
                    told = "".join(f"{x},{n},{q}\n" for x, n, q in mine)
                    row = (d, len(mine), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(data).hexdigest())
                    rows.append((*row, [{"start": x, "length": n, "period": q} for x, n, q in mine], data) if with_text else row)
                kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.binary()]
                names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds)], names[: len(rows[0])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(work, schema + ", runs array<struct<start:long,length:long,period:long>>, collapsed binary" * with_text)
