"""Exact repeated-substring removal with logarithmic families of sparse suffix arrays.

A repeat of SPAN bytes always holds the same anchor: the 20-byte string of
least hash in it. Suffixes are sampled at anchors, so every long match is met at
one of them. Every batch of documents gets a suffix array: its sampled suffixes
in byte order of their first 20 bytes, each with a hash of all that windows
around the anchor can reach. Arrays are cut by hash ranges of these 20 bytes, so
that one task holds one range of all batches and suffixes that share 20 bytes
meet in it. A task keeps a family of levels: a new array is merge-scanned
against every level, which finds the neighbours in byte order with common
prefixes of 20 bytes and more, and is then merged with levels of its own size,
so sizes grow geometrically. Where surroundings differ only in part, the bytes
themselves are fetched, all windows around the anchor are compared and the
matches verified byte by byte. Levels can be kept in a folder: the next batch
is then scanned against all before it without their texts being indexed anew.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import text as X
from spikeloom.llm.graph import forget, told_apart, written

ANCHOR = 20
_U = np.uint64
#: Documents that one batch's suffix array covers at most, and entries that are gathered to one array of a task at least.
BATCH_DOCS, BATCH_ENTRIES = 20_000, 1 << 16
#: Bytes of text for each range of suffixes, about, so that a task's share doesn't grow with the input.
RANGE_BYTES = 12_000_000
#: Rows of one stored piece of a level, and ranges of kept levels.
PIECE, KEPT_RANGES = 50_000, 64
#: One indexed suffix: its first 20 bytes as numbers (in byte order), hash of the surroundings, row of the document table, place.
ENTRY = np.dtype([("w0", "<u8"), ("w1", "<u8"), ("w2", "<u4"), ("around", "<u8"), ("doc", "<u2"), ("pos", "<u4")])
WORDS = ("w0", "w1", "w2")


def anchors(s: X.Slice, prefix: np.ndarray, span: int) -> np.ndarray:
    """Positions of the leftmost least-hashed 20-byte string of each span-byte window inside a document."""
    n = len(s.buf)
    width = span - ANCHOR + 1
    if n < span:
        return np.zeros(0, np.int64)
    at = np.arange(n - ANCHOR + 1)
    h = (prefix[ANCHOR:] - prefix[:-ANCHOR]) * X._powers["i"][: len(at)]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    key = (h & _U(0xFFFFFFFF00000000)) | at.astype(_U)
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    place = (key & _U(0xFFFFFFFF)).astype(np.int64)
    room = np.zeros(n + 1, np.int64)
    np.add.at(room, s.start, 1)
    ends = np.maximum(s.end - span + 1, s.start)
    np.add.at(room, ends, -1)
    place = place[np.cumsum(room)[: len(place)] > 0]
    return place[np.append(True, place[1:] != place[:-1])] if len(place) else place


def edges(s: X.Slice, p: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each place, and bytes before and after its anchor that windows can reach."""
    d = np.searchsorted(s.end, p, "right")
    reach = span - ANCHOR
    return d, np.minimum(p - s.start[d], reach), np.minimum(s.end[d] - p - ANCHOR, reach)


def first_bytes(buf: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """The 20 bytes from each place on as three numbers whose order is byte order."""
    b = buf[p[:, None] + np.arange(ANCHOR)]
    return [np.ascontiguousarray(b[:, lo:hi]).view(kind).ravel().astype(kind[1:]) for lo, hi, kind in ((0, 8, ">u8"), (8, 16, ">u8"), (16, 20, ">u4"))]


def pack(c: dict[str, np.ndarray]) -> tuple[bytes, bytes]:
    """A sorted run of entries as (documents, entries); byte by byte planes, which a sorted run compresses."""
    used, doc = np.unique(c["doc"], return_inverse=True)
    planes = []
    for k in ENTRY.names:
        col = np.ascontiguousarray((doc if k == "doc" else c[k]).astype(ENTRY[k]))
        planes.append(col.view(np.uint8).reshape(len(doc), -1).T.tobytes())
    return used.astype(np.int64).tobytes(), pa.compress(b"".join(planes), "zstd", asbytes=True) + len(doc).to_bytes(8, "little")


def unpack(docs: bytes, entries: bytes) -> dict[str, np.ndarray]:
    n, at, c = int.from_bytes(entries[-8:], "little"), 0, {}
    raw = np.frombuffer(pa.decompress(entries[:-8], n * ENTRY.itemsize, "zstd", asbytes=True), np.uint8)
    for k in ENTRY.names:
        kind = ENTRY[k]
        c[k] = np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(-1, n).T).view(kind).ravel()
        at += n * kind.itemsize
    return c | {"doc": np.frombuffer(docs, np.int64)[c["doc"]], "pos": c["pos"].astype(np.int64)}


def byte_order(c: dict[str, np.ndarray]) -> np.ndarray:
    """Order of the first 20 bytes, surroundings and document: by eight bytes, and by the rest where these are equal."""
    order = np.argsort(c["w0"])
    w = c["w0"][order]
    new = np.append(True, w[1:] != w[:-1])
    tied = ~(new & np.append(new[1:], True))
    rows = order[tied]
    order[tied] = rows[np.lexsort((c["doc"][rows], c["around"][rows], c["w2"][rows], c["w1"][rows], np.cumsum(new)[tied]))]
    return order


def suffix_arrays(docs: DataFrame, span: int, ranges: int) -> DataFrame:
    """(bucket, level, docs, entries): for each batch of documents one sorted run of suffix entries per range; level is -1."""

    def build(batches):
        held, ids, n = [], [], 0

        def flush():
            c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            bucket = ((c.pop("range") >> _U(40)) * _U(ranges) >> _U(24)).astype(np.int64)
            order = byte_order(c)
            order = order[np.argsort(bucket[order].astype(np.uint16 if ranges < 1 << 16 else np.int64), kind="stable")]
            bucket = bucket[order]
            table = np.array(ids, np.int64)
            c = {k: x[order] for k, x in c.items()} | {"doc": table[c["doc"][order]]}
            cut = np.searchsorted(bucket, np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cut))
            rows = [pack({k: x[cut[b] : cut[b + 1]] for k, x in c.items()}) for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), -1, np.int32)), X.blobs([r[0] for r in rows]), X.blobs([r[1] for r in rows])], ["bucket", "level", "docs", "entries"])

        for b in batches:
            own = b.column("doc_id").to_numpy(zero_copy_only=False)
            for s in X.slices(b.column("text"), max_rows=BATCH_DOCS):
                if held and (len(ids) + s.hi - s.lo > BATCH_DOCS or n > 600_000):
                    yield flush()
                    held, ids, n = [], [], 0
                prefix = X.prefix_hash(s.buf)
                p = anchors(s, prefix, span)
                d, left, right = edges(s, p, span)
                shape = left * 64 + right
                around = X.mix(X.span_hash(prefix, p - left, p + ANCHOR + right) + shape.astype(_U) * X.PLACE[5])
                words = dict(zip(WORDS, first_bytes(s.buf, p), strict=True))
                held.append(words | {"around": around, "doc": (d + len(ids)).astype(np.int64), "pos": p - s.start[d], "range": X.span_hash(prefix, p, p + ANCHOR)})
                ids += own[s.lo : s.hi].tolist()
                n += len(p)
        if held and n:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(build, "bucket int, level int, docs binary, entries binary")


def common_prefix(c: dict[str, np.ndarray]) -> np.ndarray:
    """Of each row with the row before it: how many of the first 20 bytes are equal."""
    out, going = np.zeros(len(c["w0"]), np.int64), np.ones(max(0, len(c["w0"]) - 1), bool)
    for k, size in (("w0", 8), ("w1", 8), ("w2", 4)):
        x = (c[k][1:] ^ c[k][:-1]).astype(np.uint64)
        equal = np.zeros(len(x), np.int64)
        for j in range(1, size + 1):
            equal += (x >> _U(8 * (size - j))) == 0
        out[1:] += np.where(going, equal, 0)
        going &= x == 0
    return out


class Array:
    """A suffix array: entries in order of bytes, surroundings and document.

    Each entry knows the least document met so far with its surroundings
    (first) and with its 20 bytes (least), and whether other surroundings of
    these 20 bytes have been met (many).
    """

    def __init__(self, c: dict[str, np.ndarray], own: bool = True):
        if "first" not in c:
            c = c | {"first": c["doc"].copy(), "least": c["doc"].copy(), "many": np.zeros(len(c["doc"]), bool), "new": np.full(len(c["doc"]), own)}
        order = byte_order(c)
        self.c = {k: x[order] for k, x in c.items()}
        new_g = common_prefix(self.c) < ANCHOR
        new_k = new_g | np.append(True, self.c["around"][1:] != self.c["around"][:-1])
        self.new_k, self.klass, self.group = new_k, np.cumsum(new_k) - 1, np.cumsum(new_g) - 1
        self.k_at, self.g_at = np.flatnonzero(new_k), np.flatnonzero(new_g)
        self.k_group = self.group[self.k_at]
        # states of classes and groups of equal bytes
        self.first = np.minimum.reduceat(self.c["first"], self.k_at)
        self.least = np.minimum.reduceat(self.c["least"], self.g_at)
        self.many = np.logical_or.reduceat(self.c["many"], self.g_at) | (np.add.reduceat(new_k.astype(np.int64), self.g_at) > 1)

    def __len__(self) -> int:
        return len(self.klass)

    def columns(self) -> dict[str, np.ndarray]:
        return self.c | {"first": self.first[self.klass], "least": self.least[self.group], "many": self.many[self.group]}


def merge_scan(x: Array, y: Array) -> None:
    """Walk two arrays in common order; suffixes of both that share 20 bytes or more tell each other what they have met."""
    both = {k: np.concatenate([a.c[k][a.g_at] for a in (x, y)]) for k in WORDS}
    n = len(x.g_at)
    order = np.lexsort((np.arange(len(both["w0"])) >= n, *(both[k] for k in reversed(WORDS))))
    long = np.flatnonzero(common_prefix({k: v[order] for k, v in both.items()}) >= ANCHOR)
    i, j = order[long - 1], order[long] - n
    x.least[i] = y.least[j] = np.minimum(x.least[i], y.least[j])
    # classes of the groups that meet
    pair = np.full(len(y.g_at), -1)
    pair[j] = i
    kx, ky = np.flatnonzero(np.isin(x.k_group, i)), np.flatnonzero(pair[y.k_group] >= 0)
    g = np.concatenate([x.k_group[kx], pair[y.k_group[ky]]])
    around = np.concatenate([x.c["around"][x.k_at[kx]], y.c["around"][y.k_at[ky]]])
    order = np.lexsort((np.arange(len(g)) >= len(kx), around, g))
    same = np.flatnonzero((g[order][1:] == g[order][:-1]) & (around[order][1:] == around[order][:-1]))
    a, b = kx[order[same]], ky[order[same + 1] - len(kx)]
    x.first[a] = y.first[b] = np.minimum(x.first[a], y.first[b])
    # a group has seen other surroundings unless both sides have one class and it is the same
    alike = np.zeros(len(x.g_at), bool)
    alike[x.k_group[a]] = True
    x.many[i] = y.many[j] = x.many[i] | y.many[j] | ~alike[i]


class Levels:
    """A logarithmic family of suffix arrays."""

    def __init__(self, levels: list[Array] = ()):
        self.levels = list(levels)

    def add(self, new: Array) -> None:
        """Scan a new array against every level, then merge it with levels that are no larger, as carries of a binary counter."""
        for level in self.levels:
            merge_scan(level, new)
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            x, y = self.levels.pop().columns(), new.columns()
            new = Array({k: np.concatenate([x[k], y[k]]) for k in y})
        self.levels.append(new)

    def found(self, span: int = 1):
        """For each level: its entries, which have an earlier document with equal surroundings, and which must be compared byte by byte."""
        for a in self.levels:
            doc, first = a.c["doc"] // span, a.first[a.klass] // span
            same = doc > first
            # of the first document of a class one place is enough, unless a document before it shares a part
            part = ~same & (a.new_k | (doc > a.least[a.group] // span) | (a.c["doc"] > a.first[a.klass])) & a.many[a.group]
            yield a.c, same, part


def _rows(cols: list[np.ndarray], names: list[str], step: int = 100_000):
    for k in range(0, len(cols[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + step]) for c in cols], names)


def matches(runs: DataFrame, ranges: int, keep: bool = False, ids: int = 1) -> DataFrame:
    """(doc_id, pos, anchor): places with equal surroundings in an earlier document, and, with anchor set, places to compare.

    runs has new arrays (level -1) and levels of earlier jobs. With keep, the
    levels after it come as rows too (bucket, level, docs, entries; doc_id null).
    """

    def merge(batches):
        kept, new, n = {}, {}, {}
        family: dict[int, Levels] = {}

        def flush(bucket):
            parts = new.pop(bucket, [])
            if parts:
                if bucket not in family:
                    family[bucket] = Levels([Array({k: np.concatenate([c[k] for c in cs]) for k in cs[0]}, False) for _, cs in sorted(kept.pop(bucket, {}).items())])
                family[bucket].add(Array({k: np.concatenate([c[k] for c in parts]) for k in parts[0]}))
            n[bucket] = 0

        waiting = []
        for b in batches:
            for bucket, level, docs, entries in zip(*(b.column(k).to_pylist() for k in ("bucket", "level", "docs", "entries")), strict=True):
                if level >= 0:
                    kept.setdefault(bucket, {}).setdefault(level, []).append(unpack(docs, entries))
                elif keep:
                    waiting.append((bucket, docs, entries))  # levels come first
                else:
                    c = unpack(docs, entries)
                    new.setdefault(bucket, []).append(c)
                    n[bucket] = n.get(bucket, 0) + len(c["doc"])
                    if n[bucket] >= BATCH_ENTRIES:
                        flush(bucket)
        for bucket, docs, entries in waiting:
            new.setdefault(bucket, []).append(unpack(docs, entries))
        for bucket in list(new):
            flush(bucket)
        for bucket, levels in family.items():
            for k, (c, same, part) in enumerate(levels.found(ids)):
                told = same & c["new"]
                anchor = X.mix(c["w0"] ^ X.mix(c["w1"] ^ X.mix(c["w2"].astype(_U)))).view(np.int64) & np.int64((1 << 63) - 1)
                for use, mark in ((told, np.full(int(told.sum()), -1, np.int64)), (part, anchor[part])):
                    for r in _rows([c["doc"][use], c["pos"][use], mark], ["doc_id", "pos", "anchor"]):
                        yield pa.RecordBatch.from_arrays([*r.columns, *(pa.nulls(r.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary()))][: 7 if keep else 3], ["doc_id", "pos", "anchor", "bucket", "level", "docs", "entries"][: 7 if keep else 3])
                for lo in range(0, len(c["doc"]), PIECE) if keep else ():
                    docs, entries = pack({x: c[x][lo : lo + PIECE] for x in ENTRY.names})
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([bucket], pa.int32()), pa.array([k], pa.int32()), X.blobs([docs]), X.blobs([entries])], ["doc_id", "pos", "anchor", "bucket", "level", "docs", "entries"])
        for bucket, levels in kept.items() if keep else ():  # nothing new in this range
            for k, (_, cs) in enumerate(sorted(levels.items())):
                for c in cs:
                    docs, entries = pack(c)
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([bucket], pa.int32()), pa.array([k], pa.int32()), X.blobs([docs]), X.blobs([entries])], ["doc_id", "pos", "anchor", "bucket", "level", "docs", "entries"])

    schema = "doc_id long, pos long, anchor long" + ", bucket int, level int, docs binary, entries binary" * keep
    return runs.repartitionById(ranges, F.col("bucket")).mapInArrow(merge, schema)


def _newest(spark, folder: str) -> str | None:
    """The last complete version of the kept levels."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    done = [int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return f"{folder}/{max(done)}" if done else None


def _by_doc(rows: DataFrame, cols: str) -> DataFrame:
    """One row per document with its packed places (int64 columns one after another)."""
    names = cols.split()

    def pack(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        doc = t.column("doc_id").to_numpy()
        c = [t.column(k).to_numpy() for k in names]
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        end = np.append(at[1:], len(doc))
        c = [x[order] for x in c]
        for k in range(0, len(at), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(doc[at[k : k + 5000]]), X.blobs([b"".join(x[i:j].tobytes() for x in c) for i, j in zip(at[k : k + 5000], end[k : k + 5000], strict=True)])], ["doc_id", "packed"])

    return rows.repartition("doc_id").mapInArrow(pack, "doc_id long, packed binary")


def surroundings(docs: DataFrame, parts: DataFrame, span: int, ranges: int, ids: int = 1) -> DataFrame:
    """(bucket, rows): the bytes around each place to compare, by anchor range."""
    reach = span - ANCHOR
    kind = np.dtype([("anchor", "<i8"), ("doc", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", 2 * reach + ANCHOR)])

    def fetch(batches):
        for b in batches:
            held = []
            for s in X.slices(b.column("text")):
                for k in range(s.lo, s.hi):
                    pos, anchor = np.frombuffer(b.column("packed")[k].as_py(), np.int64).reshape(2, -1)
                    n = int(s.end[k - s.lo] - s.start[k - s.lo])
                    ok = pos + ANCHOR <= n
                    pos, anchor = pos[ok], anchor[ok]
                    padded = np.zeros(n + 2 * reach, np.uint8)
                    padded[reach : reach + n] = s.buf[s.start[k - s.lo] : s.end[k - s.lo]]
                    e = np.zeros(len(pos), kind)
                    e["anchor"], e["doc"], e["pos"] = anchor, b.column("doc_id")[k].as_py(), pos
                    e["left"], e["right"] = np.minimum(pos, reach), np.minimum(n - pos - ANCHOR, reach)
                    e["bytes"] = padded[pos[:, None] + np.arange(2 * reach + ANCHOR)]
                    held.append(e)
            if held:
                e = np.concatenate(held)
                bucket = (X.mix(e["anchor"].view(_U)) % _U(ranges)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), X.blobs([e[order[cut[i] : cut[i + 1]]].tobytes() for i in some])], ["bucket", "rows"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(_by_doc(parts, "pos anchor"), "doc_id")

    def compare(batches):
        got = [np.frombuffer(r, kind) for b in batches for r in b.column("rows").to_pylist()]
        if not got:
            return
        e = np.concatenate(got)
        del got
        e = e[np.argsort(e["anchor"], kind="stable")]
        at = np.flatnonzero(np.append(True, e["anchor"][1:] != e["anchor"][:-1]))
        for lo, hi in _chunks(at, len(e)):
            low, high = windows_covered(e[lo:hi], reach, ids)
            hit = high >= 0
            p = e["pos"][lo:hi][hit].astype(np.int64)
            yield from _rows([e["doc"][lo:hi][hit], p - high[hit], p - low[hit] + span], ["doc_id", "start", "end"])

    out = rows.mapInArrow(fetch, "bucket int, rows binary").repartitionById(ranges, F.col("bucket"))
    return out.mapInArrow(compare, "doc_id long, start long, end long")


def _chunks(at: np.ndarray, n: int, size: int = 200_000):
    """Ranges of whole groups with about `size` rows."""
    lo = 0
    while lo < n:
        k = int(np.searchsorted(at, lo + size))
        hi = int(at[k]) if k < len(at) else n
        yield lo, hi
        lo = hi


def windows_covered(e: np.ndarray, reach: int, ids: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of the anchor in a window that an earlier document has too (-1: none).

    Windows meet by a rolling hash, offset by offset; each is then compared, byte by byte, with the one that it met.
    """
    span = reach + ANCHOR
    base, byte = X._BASE, X._BYTE
    ctx = e["bytes"]
    top = _U(pow(int(base), span - 1, 1 << 64))
    h = np.zeros(len(e), _U)
    for j in range(span - 1, -1, -1):
        h = h * base + byte[ctx[:, reach + j]]
    low, high = np.full(len(e), -1), np.full(len(e), -1)
    for o in range(reach + 1):
        if o:
            h = byte[ctx[:, reach - o]] + base * (h - byte[ctx[:, reach + span - o]] * top)
        ok = np.flatnonzero((e["left"] >= o) & (e["right"] >= reach - o))
        if len(ok) < 2:
            continue
        key = X.mix(h[ok] ^ X.mix(e["anchor"][ok].view(_U)))
        order = np.lexsort((e["doc"][ok], key))
        k, d = key[order], e["doc"][ok][order]
        new = np.append(True, k[1:] != k[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero(d // ids > d[first] // ids)
        hit, with_ = ok[order[later]], ok[order[first[later]]]
        at = slice(reach - o, reach - o + span)
        hit = hit[(ctx[hit, at] == ctx[with_, at]).all(1)]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


def remove_repeats(docs: DataFrame, span: int = 50, with_text: bool = False, levels: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Remove every byte covered by a span-byte string that also starts in a document of smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary)
    per input row. Strings are judged on the input, overlaps count, and nothing
    is matched across documents. Null counts as empty; rows with one doc_id
    never count against each other, whatever their texts; a null doc_id keeps all its bytes.

    levels is a folder that all executors share: docs are then the next batch
    of a growing corpus, scanned against the levels kept there, which take it
    in afterwards. earlier must hold the documents of the batches before, whose
    texts are read again only where matches have to be compared.
    """
    if not 2 * ANCHOR <= span <= ANCHOR + 63:
        raise ValueError(f"span must be from {2 * ANCHOR} to {ANCHOR + 63}")
    docs, ids = docs.select("doc_id", "text"), 1
    if not levels and earlier is None and (apart := told_apart(docs)):
        new, old, ids = apart
        out = _removed(written(new.select(F.col("_new").alias("doc_id"), "text")), span, with_text, None, None, ids)
        return out.withColumnRenamed("doc_id", "_new").join(old, "_new", "left").select("doc_id", *out.columns[1:])
    return _removed(docs, span, with_text, levels, earlier, ids)


def _removed(docs: DataFrame, span: int, with_text: bool, levels: str | None, earlier: DataFrame | None, ids: int) -> DataFrame:
    """remove_repeats of documents with ids of their own, of which `ids` in a row may stand for one doc_id."""
    spark = docs.sparkSession
    if levels:
        ranges = KEPT_RANGES
    else:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    runs = suffix_arrays(docs, span, ranges)
    if levels:
        now = _newest(spark, levels)
        if now:
            runs = runs.union(spark.read.parquet(now).select("bucket", "level", "docs", "entries"))
        found = written(matches(runs, ranges, True, ids))
        found.where("doc_id is null").select("bucket", "level", "docs", "entries").write.parquet(f"{levels}/{0 if now is None else int(now.rpartition('/')[2]) + 1}")
        found = found.where("doc_id is not null")
    else:
        found = written(matches(runs, ranges, False, ids))
    forget(spark)
    all_ = docs if earlier is None else docs.union(earlier.select("doc_id", "text"))
    cover = written(surroundings(all_, found.where("anchor >= 0").select("doc_id", "pos", "anchor"), span, ranges, ids))
    forget(spark)
    whole = found.where("anchor < 0").select("doc_id", F.col("pos").alias("start"), F.lit(-1).cast("long").alias("end"))
    spans = _by_doc(whole.union(cover), "start end")
    reach = span - ANCHOR

    def cut(batches):
        for b in batches:
            n, gone, runs, sha, kept = [], [], [], [], []
            for t, packed in zip(b.column("text"), b.column("packed"), strict=True):
                data = (t.as_py() or "").encode()
                n.append(len(data))
                lo = hi = np.zeros(0, np.int64)
                if packed.is_valid and len(data) >= span:
                    lo, hi = np.frombuffer(packed.as_py(), np.int64).reshape(2, -1)
                    full = hi < 0
                    hi = np.where(full, np.minimum(lo + ANCHOR + reach, len(data)), np.minimum(hi, len(data)))
                    lo = np.where(full, np.maximum(lo - reach, 0), lo)
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.append(True, lo[1:] > hi[:-1])
                    lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                left = b"".join(data[x:y] for x, y in zip(np.append(0, hi), np.append(lo, len(data)), strict=True)) if len(lo) else data
                gone.append(len(data) - len(left)), runs.append(len(lo)), sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left)
            cols = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha, pa.string()), *[X.blobs(kept)] * with_text]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(spans, "doc_id", "left").select("doc_id", "text", "packed")
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
