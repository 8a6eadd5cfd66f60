"""Benchmark decontamination by a broadcast set of normalised word n-grams.

Tasks hash all word windows of their documents, look them up in the broadcast
windows of the benchmark, and verify each hit on the words themselves. A
benchmark beyond BROADCAST_WINDOWS windows is dealt out in blocks: each is
broadcast and scanned for in a job of its own, whose few hits are written, so
that one block is alive at a time in the driver and in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import text as X
from spikeloom.llm.graph import written

BROADCAST_WINDOWS = 500_000
_U = np.uint64


def _normal(s: X.Slice):
    buf = X.LOWER[s.buf]
    w = X.words(s, X.word_table("alnum"), buf)
    return buf, w, X.span_hash(X.prefix_hash(buf), w.start, w.end)


def benchmark_windows(benchmark: DataFrame, words: int) -> DataFrame:
    """Distinct (item_id, length, hash, window): runs of `words` words of each item, or all words of a shorter one.

    window holds the words joined by blanks. Items without words, null or empty, have none.
    """

    def cut(batches):
        for b in batches:
            item, size, key, win = [], [], [], []
            for s in X.slices(b.column("text")):
                buf, w, h = _normal(s)
                for k in range(s.hi - s.lo):
                    a, e = int(w.first[k]), int(w.last[k])
                    n = min(words, e - a)
                    for i in range(a, e - n + 1 if n else a):
                        item.append(b.column("item_id")[s.lo + k].as_py())
                        size.append(n)
                        key.append(int(X.ngram_hash(h[i : i + n], n)[:1].view(np.int64)[0]))
                        win.append(b" ".join(buf[x:y].tobytes() for x, y in zip(w.start[i : i + n], w.end[i : i + n], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(size, pa.int32()), pa.array(key, pa.int64()), X.blobs(win)], ["item_id", "size", "hash", "window"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "item_id long, size int, hash long, window binary").distinct()


def _index(rows) -> dict[int, tuple[np.ndarray, dict]]:
    """By window length: sorted hashes, and the items and words behind each hash."""
    out: dict = {}
    for item, size, key, win in rows:
        out.setdefault(size, {}).setdefault(key, {}).setdefault(bytes(win), set()).add(item)
    return {size: (np.sort(np.array(list(d), np.int64).view(_U)), d) for size, d in out.items()}


def _search(s: X.Slice, index: dict) -> tuple[np.ndarray, X.Words, dict[int, set], np.ndarray]:
    """Words of a slice; by document the items with verified windows; which words are hit."""
    buf, w, h = _normal(s)
    mark = np.zeros(len(h) + 1, np.int64)
    found: dict[int, set] = {}
    for size, (keys, behind) in index.items():
        if len(h) < size:
            continue
        g = X.ngram_hash(h, size)[: len(h) - size + 1]
        for i in np.flatnonzero(_among(keys, g)):
            d = int(np.searchsorted(w.last, i, "right"))
            if i + size > w.last[d]:
                continue
            win = b" ".join(buf[x:y].tobytes() for x, y in zip(w.start[i : i + size], w.end[i : i + size], strict=True))
            if got := behind[int(g[i : i + 1].view(np.int64)[0])].get(win):
                found.setdefault(d, set()).update(got)
                mark[i] += 1
                mark[i + size] -= 1
    return buf, w, found, np.cumsum(mark[:-1]) > 0


def _runs(own: np.ndarray) -> np.ndarray:
    """Rows (first, end) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


_NO_RUNS = np.zeros((0, 2), np.int64)
_OUT = "doc_id long, n_words long, n_hit long, items array<long>, cut_text string"


class _Rows:
    """Result rows of a batch, document by document."""

    def __init__(self):
        self.cols: list[list] = [[], [], [], []]

    def add(self, s: X.Slice, w: X.Words, k: int, runs: np.ndarray, items) -> None:
        row = int(w.last[k] - w.first[k]), int((runs[:, 1] - runs[:, 0]).sum()), sorted(items), _without(s, w, runs, k) if len(runs) else None
        for c, v in zip(self.cols, row, strict=True):
            c.append(v)

    def batch(self, b: pa.RecordBatch, more: tuple[str, ...] = ()) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(self.cols, kinds, strict=True)), *(b.column(c) for c in more)], ["doc_id", "n_words", "n_hit", "items", "cut_text", *more])


def _out(docs: DataFrame) -> tuple[str, tuple[str, ...]]:
    """Schema of the result, with text and rest where docs brings a rest along; and these columns."""
    more = ("text", "rest") if "rest" in docs.columns else ()
    return _OUT + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more), more


def _whole(docs: DataFrame, rows: list) -> DataFrame:
    """All of the result in one pass: the whole benchmark is one block."""
    held = docs.sparkSession.sparkContext.broadcast(rows)
    state: dict = {}
    schema, more = _out(docs)

    def scan(batches):
        index = state.get("index") or state.setdefault("index", _index(held.value))
        for b in batches:
            out = _Rows()
            for s in X.slices(b.column("text")):
                _, w, found, hit = _search(s, index)
                for k in range(s.hi - s.lo):
                    out.add(s, w, k, _runs(hit[w.first[k] : w.last[k]]) if k in found else _NO_RUNS, found.get(k, ()))
            yield out.batch(b, more)

    return docs.mapInArrow(scan, schema)


def _block(docs: DataFrame, rows: list) -> DataFrame:
    """(row, spans, items) of the documents that one block of windows hits."""
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def scan(batches):
        index = _index(held.value)
        for b in batches:
            row, spans, items = [], [], []
            for s in X.slices(b.column("text")):
                _, w, found, hit = _search(s, index)
                for k in sorted(found):
                    row.append(b.column("row")[s.lo + k].as_py())
                    spans.append(_runs(hit[w.first[k] : w.last[k]]).astype(np.int64).tobytes())
                    items.append(sorted(found[k]))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), X.blobs(spans), pa.array(items, pa.list_(pa.int64()))], ["row", "spans", "items"])

    out = written(docs.mapInArrow(scan, "row long, spans binary, items array<long>"))
    held.destroy()
    return out


def _joined(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The result from the hits of all blocks."""
    schema, more = _out(docs)
    per = hits.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finish(batches):
        for b in batches:
            out, spans, items = _Rows(), b.column("spans").to_pylist(), b.column("items").to_pylist()
            for s in X.slices(b.column("text")):
                _, w, _ = _normal(s)
                for k in range(s.hi - s.lo):
                    own = spans[s.lo + k] or []
                    runs = _runs(np.cumsum(sum(_marks(x, int(w.last[k] - w.first[k])) for x in own))[:-1] > 0) if own else _NO_RUNS
                    out.add(s, w, k, runs, items[s.lo + k] or ())
            yield out.batch(b, more)

    return docs.join(per, "row", "left").select("doc_id", "text", "spans", "items", *more[1:]).mapInArrow(finish, schema)


def _marks(spans: bytes, n: int) -> np.ndarray:
    out = np.zeros(n + 1, np.int64)
    runs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    np.add.at(out, runs[:, 0], 1)
    np.add.at(out, runs[:, 1], -1)
    return out


def _among(keys: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether each hash is in the sorted keys; a bitmap of 2^22 places rules out nearly all first."""
    places = np.zeros(1 << 22, bool)
    places[keys >> _U(42)] = True
    out = places[g >> _U(42)]
    maybe = np.flatnonzero(out)
    out[maybe] = keys[np.minimum(np.searchsorted(keys, g[maybe]), len(keys) - 1)] == g[maybe]
    return out


def _without(s: X.Slice, w: X.Words, runs: np.ndarray, k: int) -> str:
    """The text of document k without the word runs."""
    a, parts, at = int(w.first[k]), [], int(s.start[k])
    for x, y in runs:
        parts.append(s.buf[at : w.start[a + x]].tobytes())
        at = int(w.end[a + y - 1])
    parts.append(s.buf[at : s.end[k]].tobytes())
    return b"".join(parts).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 10, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids), contaminated, cut_text (and its text and struct `rest`, with carry).

    Words are lower-cased in A-Z and made of digits, letters and non-ASCII. A
    word inside any verified window is hit. cut_text is the text without hit
    spans, null where nothing was hit. Null and empty texts have no words; an
    empty benchmark hits nothing. One row per input row, without a shuffle.
    """
    windows = benchmark_windows(benchmark, words)
    parts = -(-windows.count() // BROADCAST_WINDOWS) or 1
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *["rest"] * carry)
    columns = ("item_id", "size", "hash", "window")
    if parts == 1:
        out = _whole(out, [tuple(r) for r in windows.select(*columns).collect()])
    else:
        rows, windows, hits = written(out.withColumn("row", F.monotonically_increasing_id())), written(windows), None
        for p in range(parts):
            block = windows.where(F.pmod(F.xxhash64("size", "hash"), F.lit(parts)) == p)
            found = _block(rows, [tuple(r) for r in block.select(*columns).collect()])
            hits = found if hits is None else hits.union(found)
        out = _joined(rows, hits)
    return out.withColumn("contaminated", F.col("n_hit") > 0)
