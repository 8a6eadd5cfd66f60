"""Exact deduplication by Grace hashing.

Texts are equal when identical without blanks. A scan task keeps an
open-addressing table of whole contents and gives one record for each content
that it has met (with the rows it stands for), so that a text that fills a
third of the corpus is a few records of each task. Records are dealt into
buckets by hash; the shuffle's files are the spill files. A task reads its
bucket into a table of bounded size, which compares complete contents. A bucket
that fits is settled. One that doesn't is emptied into records again, equal ones
now combined, which are dealt by another hash at the next level; copies of one
text always fit, as they are one entry. Records of texts that are frequent in a
task meet in salted buckets first. Only numbers go back to the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import text as X
from spikeloom.llm.graph import forget, written

#: Bytes of contents for each bucket, about, and those that a table holds at most (a single content may be larger).
BUCKET_BYTES, TABLE_BYTES = 16_000_000, 48_000_000
#: Rows that one record of a scan stands for at most; from HOT_ROWS on, records of a content meet in SALTS buckets before they all meet in one.
RECORD_ROWS, HOT_ROWS, SALTS = 50_000, 16, 64

RECORD = "rid long, h long, n_bytes long, rows long, cp long, doc long, content binary"
_COLS = tuple(x.split()[0] for x in RECORD.split(", "))
_U = np.uint64


def normalised(s: X.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a slice without blanks, bounds of each document in them, and code points of each original text."""
    word = X.word_table("space")[s.buf]
    at = np.append(0, np.cumsum(word))
    points = np.append(0, np.cumsum((s.buf & 0xC0) != 0x80))
    return s.buf[word], np.append(at[s.start], at[s.end[-1:]]), points[s.end] - points[s.start]


class Table:
    """An open-addressing table with linear probing; an entry is a whole content, and hashes only say where to look."""

    def __init__(self):
        self.slots, self.hashes, self.contents = [-1] * 1024, [], []
        self.bytes, self.members = 0, 0
        self.rows, self.best = [], []

    def __len__(self) -> int:
        return len(self.contents)

    def entry(self, h: int, content: bytes) -> int:
        """Number of the entry with this content, new if there is none."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        slots[at] = k = len(self.contents)
        self.hashes.append(h), self.contents.append(content), self.rows.append(0), self.best.append(None)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return k

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def put(self, h: int, content: bytes, rows: int, cp: int, doc: int | None, member: int) -> int:
        """Count rows of a content; the best has most code points, then the smallest doc_id (null last), then came first."""
        k = self.entry(h, content)
        self.rows[k] += rows
        self.members += 1
        mine = (-cp, doc is None, doc or 0, member)
        if self.best[k] is None or mine < self.best[k]:
            self.best[k] = mine
        return k

    def of(self, k: int) -> tuple[int, int | None]:
        """Code points and doc_id of an entry's best row."""
        cp, null, doc, _ = self.best[k]
        return -cp, None if null else doc


def _first_rid(step: int) -> int:
    """Where a task's numbers of records begin; no two tasks of a run share any."""
    return step << 55 | TaskContext.get().partitionId() << 32


def _record_arrays(rids: list[int], t: Table) -> list[pa.Array]:
    cp, doc = zip(*(t.of(k) for k in range(len(t))), strict=True)
    longs = (rids, t.hashes, [len(c) for c in t.contents], t.rows, cp, doc)
    return [*(pa.array(x, pa.int64()) for x in longs), pa.array(t.contents, pa.binary())]


def _pieces(arrays: list[pa.Array], names: list[str], step: int = 2000):
    for k in range(0, len(arrays[0]), step):
        yield pa.RecordBatch.from_arrays([a.slice(k, step) for a in arrays], names)


def scan(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Records of the contents that each task has met, with the ids of their rows and which of them is best."""

    def work(batches):
        rid = _first_rid(0)

        def flush(t, members):
            nonlocal rid
            rids = list(range(rid, rid + len(t)))
            rid += len(t)
            best = [t.best[k][3] for k in range(len(t))]
            return _pieces([*_record_arrays(rids, t), pa.array(members, pa.list_(pa.int64())), pa.array(best, pa.int32())], [*_COLS, "members", "best_at"])

        t, members = Table(), []
        for b in batches:
            own = b.column("doc_id").to_pylist()
            for s in X.slices(b.column("text")):
                data, off, cp = normalised(s)
                h = (X.span_hash(X.prefix_hash(data), off[:-1], off[1:]) & _U((1 << bits) - 1)).view(np.int64).tolist()
                for k in range(s.hi - s.lo):
                    e = t.entry(h[k], data[off[k] : off[k + 1]].tobytes())
                    if e == len(members):
                        members.append([])
                    t.put(h[k], t.contents[e], 1, int(cp[k]), own[s.lo + k], len(members[e]))
                    members[e].append(own[s.lo + k])
                    if t.bytes > TABLE_BYTES or t.members >= RECORD_ROWS:
                        yield from flush(t, members)
                        t, members = Table(), []
        if len(t):
            yield from flush(t, members)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"{RECORD}, members array<long>, best_at int")


LEVEL = f"kind string, {RECORD}, parent long, best boolean, keep_id long, group_size long, sha string"


def level(dealt: DataFrame, step: int, table_bytes: int, settle: bool = True) -> DataFrame:
    """Read each bucket into a table.

    Rows of kind `done` tell a record its group (if the bucket fitted), those of
    kind `link` the record of the next level that has taken it in, and those of
    kind `rest` are these records. best: the group's best row is in this record.
    """
    names = [x.split()[0] for x in LEVEL.split(", ")]
    kinds = {"kind": pa.string(), "best": pa.bool_(), "sha": pa.string(), "content": pa.binary()}

    def told(kind, **cols):
        n = len(next(iter(cols.values())))
        arrays = [pa.array([kind] * n) if c == "kind" else cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], kinds.get(c, pa.int64())) if c in cols else pa.nulls(n, kinds.get(c, pa.int64())) for c in names]
        return _pieces(arrays, names)

    def work(batches):
        rid, over = _first_rid(step), not settle

        def empty(t, child, entry):
            nonlocal rid
            best = [t.best[k][3] for k in range(len(t))]
            yield from told("link", rid=child, parent=[rid + k for k in entry], best=[best[k] == c for c, k in zip(child, entry, strict=True)])
            yield from told("rest", **dict(zip(_COLS, _record_arrays(list(range(rid, rid + len(t))), t), strict=True)))
            rid += len(t)

        t, child, entry, alike = Table(), [], [], True
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("rid", "h", "rows", "cp", "doc")]
            content = b.column("content")
            for k, (r, h, rows, cp, doc) in enumerate(zip(*cols, strict=True)):
                if t.bytes > table_bytes and not alike:
                    over = True
                    yield from empty(t, child, entry)
                    t, child, entry, alike = Table(), [], [], True
                entry.append(t.put(h, content[k].as_py(), rows, cp, doc, r))
                child.append(r)
                alike &= h == t.hashes[0]
        if over and len(t):
            yield from empty(t, child, entry)
        elif len(t):
            sha = [hashlib.sha256(c).hexdigest() for c in t.contents]
            keep = [t.of(k)[1] for k in range(len(t))]
            yield from told("done", rid=child, best=[t.best[k][3] == c for c, k in zip(child, entry, strict=True)], keep_id=[keep[k] for k in entry], group_size=[t.rows[k] for k in entry], sha=[sha[k] for k in entry])

    return dealt.select(*_COLS).mapInArrow(work, LEVEL)


def _followed(out: DataFrame, known: DataFrame) -> DataFrame:
    """What is known of the records that a level has taken into others."""
    link = out.where("kind = 'link'").select("rid", F.col("parent").alias("at"), F.col("best").alias("mine"))
    return link.join(known.withColumnRenamed("rid", "at"), "at").select("rid", (F.col("mine") & F.col("best")).alias("best"), "keep_id", "group_size", "sha")


def _members(records: DataFrame, known: DataFrame) -> DataFrame:
    """Each record's rows with its group."""
    rows = records.select("rid", "members", "best_at").join(known, "rid")
    rows = rows.select("best", "best_at", "keep_id", "group_size", "sha", F.posexplode("members").alias("at", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("at") == F.col("best_at"))).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, table_bytes: int = TABLE_BYTES, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per input row.

    Texts are equal when identical after deleting blanks and the controls 9 to
    13; null counts as empty. Of equal texts the row with most code points stays,
    then the smallest doc_id; a null id comes last, and of rows that tie in both
    exactly one stays (then keep_id is also the id of rows that go). Other columns are left aside.
    bits: of the hash that deals records out; results don't depend on it.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = written(scan(docs, bits))
    forget(spark)
    hot = F.col("rows") >= HOT_ROWS
    salted = written(level(records.where(hot).select(*_COLS).repartition(n, F.col("h"), F.pmod(F.col("rid"), F.lit(SALTS))), 1, table_bytes, settle=False))
    rest = records.where(~hot).select(*_COLS).union(salted.where("kind = 'rest'").select(*_COLS))
    links, done = [salted], []
    while (size := rest.agg(F.sum("n_bytes")).first()[0]) is not None:
        step = len(links) + 1
        buckets = max(n, -(-size // bucket_bytes)) * (1 if step == 2 else 2)
        out = written(level(rest.repartition(buckets, F.xxhash64("h", F.lit(step))), step, table_bytes))
        forget(spark)
        links.append(out)
        done.append(out.where("kind = 'done'").select("rid", "best", "keep_id", "group_size", "sha"))
        rest = out.where("kind = 'rest'").select(*_COLS)
    if not done:
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    known = done.pop()
    links.pop()  # the last level settles all
    while done:
        known = done.pop().union(_followed(links.pop(), known))
    return _members(records, known.union(_followed(salted, known)))
