"""N-gram Jaccard self-join with count-vector R-trees.

Shingles are hashed into groups; a document is the point of its group counts,
and two sets can share at most the sum of the coordinate minima. The number of
groups follows the size of a set, so that the bound is as tight for long texts
as for short ones; finer counts fold into coarser ones. Spark deals the
documents out by the shingles of an exact prefix (two sets that reach the
threshold share one of them, and at the first one that they share the places in
both prefixes bound the overlap too), each block of documents gets R-trees whose
nodes are pruned by these bounds, and surviving pairs are verified on whole sets.

Two rounds keep dense groups cheap without losing a link: first each block is
covered by stars (every document against the first one it can match), then only
pairs whose ends are in different components are searched in the trees. Blocks
beyond TILE documents are dealt out in tiles. Links inside a component are
counted around a pivot: two sets within half the distance of it must link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.llm import text as X
from spikeloom.llm.graph import components, forget, saved, told_apart

#: Least and most groups; between them the power of two from half the set size on. Larger sets are bounded less tightly.
GROUPS = (16, 1 << 16)
LEAF = 32
#: Most documents of a block that one tree holds, and of each side of a tile in which links are counted.
TILE, COUNTED = 4096, 512
#: A shingle of more than this share of the documents goes to the end of every prefix.
#: Each document has at most (mean set size / share) such shingles among all, so the broadcast list is bounded.
COMMON = 1 / 500
_U = np.uint64
#: A coordinate that bounds nothing.
OPEN = 60_000


def prefix_size(n, percent: int):
    """Shingles to index so that two sets with Jaccard >= percent / 100 share one."""
    return n - (n * percent + 99) // 100 + 1


def needed(a, b, percent: int):
    """Least intersection of sets of sizes a and b that reach the threshold."""
    return ((a + b) * percent + 99 + percent) // (100 + percent)


def groups_of(n: int) -> int:
    """Groups for a set of n shingles."""
    return int(np.clip(1 << max(0, (n + 1) // 2 - 1).bit_length(), *GROUPS))


def group_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes fall into each group (the document's point); all 255, which bounds nothing, if one doesn't fit."""
    groups = groups_of(len(h))
    c = np.bincount((h >> _U(40)).astype(np.int64) & (groups - 1), minlength=groups)
    return (c if c.max() < 255 else np.full(groups, 255)).astype(np.uint8)


def folded(x: np.ndarray, groups: int) -> np.ndarray:
    """Points of more groups as points of fewer; full ones become open in all coordinates."""
    full = (x == 255).all(1)
    x = x.astype(np.uint16)
    while x.shape[1] > groups:
        x = x[:, : x.shape[1] // 2] + x[:, x.shape[1] // 2 :]
    x[full] = OPEN
    return x


class Points:
    """Group counts of many documents, each with as many groups as its size asks for."""

    def __init__(self, counts: list[bytes]):
        self.groups = np.array([len(c) for c in counts], np.int64)
        self.at = np.cumsum(self.groups) - self.groups
        self.flat = np.frombuffer(b"".join(counts), np.uint8)

    def of(self, rows: np.ndarray, groups: int) -> np.ndarray:
        """Points of some rows over the same number of groups, no more than any of them has."""
        out = np.empty((len(rows), groups), np.uint16)
        for g in np.unique(self.groups[rows]):
            own = np.flatnonzero(self.groups[rows] == g)
            out[own] = folded(self.flat[self.at[rows[own]][:, None] + np.arange(g)], groups)
        return out


def shared_at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the coordinate minima of each point of x with each of y."""
    if len(x) * len(y) * x.shape[1] <= 1 << 20:
        return np.minimum(x[:, None], y[None]).sum(2, dtype=np.int64)
    return np.stack([np.minimum(p, y).sum(1, dtype=np.int64) for p in x])


class CountTree:
    """R-tree over group-count vectors, packed by recursive median splits of the widest coordinate.

    rest: how many shingles of a set can be shared at most, by its place in the
    prefix. own: pairs need an own row at one end. side: pairs need ends on
    different sides, unless the sides are 2.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int, leaf: int = LEAF, rest=None, own=None, side=None):
        self.x, self.n, self.percent = points, sizes.astype(np.int64), percent
        self.rest = self.n if rest is None else rest
        self.own = np.ones(len(sizes), bool) if own is None else own
        self.side = np.full(len(sizes), 2) if side is None else side
        self.hi, self.size, self.most, self.has_own, self.kids, self.rows = [], [], [], [], [], []
        stack = [(np.arange(len(sizes)), -1)]
        while stack:
            rows, parent = stack.pop()
            me = len(self.rows)
            p = self.x[rows]
            self.hi.append(p.max(0))
            self.size.append((int(self.n[rows].min()), int(self.n[rows].max())))
            self.most.append(int(self.rest[rows].max()))
            self.has_own.append(bool(self.own[rows].any()))
            self.kids.append([])
            self.rows.append(rows if len(rows) <= leaf else None)
            if parent >= 0:
                self.kids[parent].append(me)
            if len(rows) > leaf:
                wide = np.append(self.hi[me].astype(np.int64) - p.min(0), self.size[me][1] - self.size[me][0])
                d = int(wide.argmax())
                order = np.argsort(self.n[rows] if d == len(wide) - 1 else p[:, d], kind="stable")
                half = len(rows) // 2
                stack += [(rows[order[:half]], me), (rows[order[half:]], me)]

    def can(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each row of a with each of b, whether the bounds and the sizes allow a link."""
        m, n = self.n[a][:, None], self.n[b][None]
        bound = np.minimum(shared_at_most(self.x[a], self.x[b]), np.minimum(self.rest[a][:, None], self.rest[b][None]))
        ok = (bound >= needed(m, n, self.percent)) & (100 * np.minimum(m, n) >= self.percent * np.maximum(m, n))
        s, t = self.side[a][:, None], self.side[b][None]
        return ok & (self.own[a][:, None] | self.own[b][None]) & ((s != t) | (s == 2))

    def may(self, u: int, v: int) -> bool:
        (ul, uh), (vl, vh) = self.size[u], self.size[v]
        if 100 * uh < self.percent * vl or 100 * vh < self.percent * ul or not (self.has_own[u] or self.has_own[v]):
            return False
        least = needed(ul, vl, self.percent)
        return min(self.most[u], self.most[v]) >= least and int(np.minimum(self.hi[u], self.hi[v]).sum(dtype=np.int64)) >= least

    def around(self, row: int) -> np.ndarray:
        """Rows that can link with one row."""
        out, stack, q, n = [], [0], self.x[row], int(self.n[row])
        while stack:
            u = stack.pop()
            lo, hi = self.size[u]
            least = needed(lo, n, self.percent)
            if 100 * hi < self.percent * n or 100 * n < self.percent * lo or self.most[u] < least or int(np.minimum(self.hi[u], q).sum(dtype=np.int64)) < least:
                continue
            if self.rows[u] is None:
                stack += self.kids[u]
            else:
                r = self.rows[u]
                out.append(r[self.can(np.array([row]), r)[0]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def stars(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cover the rows by stars: a first row not covered yet and what it can link with."""
        free = np.ones(len(self.n), bool)
        for row in range(len(self.n)):
            if free[row]:
                near = self.around(row)
                near = near[free[near] & (near > row)]
                free[row] = free[near] = False
                if len(near):
                    yield np.full(len(near), row), near

    def pairs(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows with different labels that can link."""
        one = [None] * len(self.rows)
        for u in range(len(self.rows) - 1, -1, -1):
            seen = {int(label[self.rows[u][0]])} if self.rows[u] is not None and (label[self.rows[u]] == label[self.rows[u][0]]).all() else {one[k] for k in self.kids[u]} or {None}
            one[u] = seen.pop() if len(seen) == 1 else None
        stack = [(0, 0)]
        while stack:
            u, v = stack.pop()
            if (one[u] is not None and one[u] == one[v]) or not self.may(u, v):
                continue
            ku, kv = self.kids[u], self.kids[v]
            if u == v and ku:
                stack += [(ku[0], ku[0]), (ku[1], ku[1]), (ku[0], ku[1])]
            elif ku and (not kv or self.size[u][1] >= self.size[v][1]):
                stack += [(k, v) for k in ku]
            elif kv:
                stack += [(u, k) for k in kv]
            else:
                a, b = self.rows[u], self.rows[v]
                ok = self.can(a, b) & (label[a][:, None] != label[b][None])
                if u == v:
                    ok &= a[:, None] < b[None]
                i, j = np.nonzero(ok)
                if len(i):
                    yield a[i], b[j]


def block_pairs(points: Points, rows: np.ndarray, n: np.ndarray, rest: np.ndarray, side: np.ndarray, comp: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that can link; without comp only stars, else those with different comp.

    Sets that can link differ in size by less than a factor of two, so by one
    step in the number of groups at most: there is one tree for each number of
    groups, with the next larger sets folded.
    """
    groups = points.groups[rows]
    for g in np.unique(groups):
        own = groups == g
        use = np.flatnonzero(own | ((groups == 2 * g) & (100 * n[rows[own]].max() >= percent * n[rows])))
        if len(use) < 2:
            continue
        r = rows[use]
        tree = CountTree(points.of(r, int(g)), n[r], percent, LEAF, rest[r], own[use], side[r])
        for a, b in tree.stars() if comp is None else tree.pairs(comp[r]):
            yield r[a], r[b]


def common_shingles(docs: DataFrame, words: int, share: float) -> np.ndarray:
    """Sorted hashes of shingles that are frequent in some task and in more than `share` of all documents."""

    def count(batches):
        held, docs_held, n = [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(8, share * docs_held)
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], ["h", "c"])

        for b in batches:
            for _, s in X.shingle_sets(b.column(0), words):
                held.append(s)
                docs_held, n = docs_held + 1, n + len(s)
                if n > 4_000_000:
                    yield flush()
                    held, docs_held, n = [], 0, 0
        if held:
            yield flush()

    least = max(8, int(docs.count() * share))
    rows = docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(_U))


def signatures(docs: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """Per document: set size n, a 128-bit signature of the set, its prefix of shingles and its group counts."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches):
        often = held.value
        for b in batches:
            n, s1, s2, pre, cnt = [], [], [], [], []
            for _, h in X.shingle_sets(b.column("text"), words):
                k = len(h)
                n.append(k)
                if not k:
                    s1.append(None), s2.append(None), pre.append(None), cnt.append(None)
                    continue
                s1.append(int(h.sum(dtype=_U).view(np.int64)))
                s2.append(int(X.mix(h).sum(dtype=_U).view(np.int64)))
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
                    first = np.concatenate([h[~late], h[late]])
                else:
                    first = h
                pre.append(first[: prefix_size(k, percent)].tobytes())
                cnt.append(group_counts(h).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), X.blobs(pre), X.blobs(cnt)], ["doc_id", "n", "s1", "s2", "prefix", "counts"])

    return _narrow(docs).mapInArrow(sign, "doc_id long, n long, s1 long, s2 long, prefix binary, counts binary")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def blocks(reps: DataFrame) -> DataFrame:
    """(block, size, doc_id, place): documents that share a prefix shingle, and the first place of such a shingle in each prefix.

    Equal sets of documents are one block. A block is named by a hash over its
    documents; should two have one name, they are searched as one.
    """

    def explode(batches):
        for b in batches:
            pre = b.column("prefix").to_pylist()
            many = np.array([len(p) // 8 for p in pre], np.int64)
            ids, h = np.repeat(b.column("doc_id").to_numpy(), many), np.frombuffer(b"".join(pre), np.int64)
            place = X.gather(many, np.zeros(len(many), np.int64)).astype(np.int32)
            for k in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in (h, ids, place)], ["token", "doc_id", "place"])

    flat = reps.select("doc_id", "prefix").mapInArrow(explode, "token long, doc_id long, place int")
    token = W.partitionBy("token")
    held = flat.withColumn("size", F.count("*").over(token)).withColumn("block", F.bit_xor(F.xxhash64("doc_id")).over(token)).where("size > 1")
    return held.groupBy("block", "doc_id").agg(F.max("size").alias("size"), F.min("place").alias("place"))


def candidates(members: DataFrame, percent: int, stars: bool) -> DataFrame:
    """Distinct pairs (a < b) that the R-trees of the blocks let through; members has block, doc_id, n, place, counts, side, comp."""

    def search(batches):
        for t in X.whole_groups(batches, "block"):
            yield from _searched(t, percent, stars)

    rows = members.select("block", "doc_id", "n", "place", "counts", "side", "comp").repartition("block").sortWithinPartitions("block", "doc_id")
    return rows.mapInArrow(search, "a long, b long").distinct()


def _searched(t: pa.Table, percent: int, stars: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of whole blocks that the trees let through; rows come in order of block and doc_id."""
    block, doc, n, comp, side = (t.column(c).to_numpy() for c in ("block", "doc_id", "n", "comp", "side"))
    rest = n - t.column("place").to_numpy()
    points = Points(t.column("counts").to_pylist())
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    size = np.diff(np.append(at, len(block)))
    found = []
    i = at[size == 2]
    j = i + 1
    big, small, least = np.maximum(n[i], n[j]), np.minimum(n[i], n[j]), needed(n[i], n[j], percent)
    ok = (np.minimum(rest[i], rest[j]) >= least) & (100 * small >= percent * big) & ((side[i] != side[j]) | (side[i] == 2)) & (stars | (comp[i] != comp[j]))
    i, j, least = i[ok], j[ok], least[ok]
    low = np.minimum(points.groups[i], points.groups[j])
    for g in np.unique(low):
        own = np.flatnonzero(low == g)
        for k in range(0, len(own), step := max(1, (1 << 22) // int(g))):
            p, q = i[own[k : k + step]], j[own[k : k + step]]
            fit = np.minimum(points.of(p, int(g)), points.of(q, int(g))).sum(1, dtype=np.int64) >= least[own[k : k + step]]
            found.append((doc[p[fit]], doc[q[fit]]))
    for k, m in zip(at[size > 2], size[size > 2], strict=True):
        if stars or (comp[k : k + m] != comp[k]).any():
            found += ((doc[a], doc[b]) for a, b in block_pairs(points, np.arange(k, k + m), n, rest, side, None if stars else comp, percent))
    if found:
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        for k in range(0, len(both), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[k : k + 100_000, c].copy()) for c in (0, 1)], ["a", "b"])


def _tile(tiles) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), tiles)


def first_round(held: DataFrame) -> DataFrame:
    """Blocks to cover by stars; a large one goes tile by tile."""
    tiles = F.ceil(F.col("size") / TILE)
    block = F.when(F.col("size") > TILE, F.xxhash64("block", _tile(tiles))).otherwise(F.col("block"))
    return held.select(block.alias("block"), "doc_id", "place", F.lit(2).alias("side"), F.col("doc_id").alias("comp"))


def second_round(held: DataFrame, comp: DataFrame) -> DataFrame:
    """Blocks in which different components meet. Of a large one, the tiles of its largest component meet only the tiles of the rest."""
    rows = held.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    both = W.partitionBy("block")
    mixed = saved(rows.withColumn("low", F.min("comp").over(both)).withColumn("high", F.max("comp").over(both)).where("low <> high").drop("low", "high"))
    whole = mixed.where(F.col("size") <= TILE).select("block", "doc_id", "place", F.lit(2).alias("side"), "comp")
    large = mixed.where(F.col("size") > TILE)
    each = large.groupBy("block", "comp").agg(F.count("*").alias("c"))
    top = each.groupBy("block").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("n_top"), F.sum("c").alias("n_all"))
    dealt = large.join(top, "block").withColumn("is_top", F.col("comp") == F.col("top")).withColumn("tops", F.ceil(F.col("n_top") / TILE)).withColumn("rests", F.ceil((F.col("n_all") - F.col("n_top")) / TILE))
    dealt = dealt.withColumn("tile", _tile(F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = dealt.where("is_top").withColumn("j", upto("rests")).select(F.xxhash64("block", F.lit(0), "tile", "j").alias("block"), "doc_id", "place", F.lit(0).alias("side"), "comp")
    b = dealt.where("not is_top").withColumn("j", upto("tops")).select(F.xxhash64("block", F.lit(0), "j", "tile").alias("block"), "doc_id", "place", F.lit(1).alias("side"), "comp")
    c = dealt.where("not is_top").withColumn("j", upto("rests")).select(F.xxhash64("block", F.lit(1), F.least("tile", "j"), F.greatest("tile", "j")).alias("block"), "doc_id", "place", F.when(F.col("tile") == F.col("j"), 2).otherwise((F.col("tile") > F.col("j")).cast("int")).alias("side"), "comp")
    return whole.union(a).union(b).union(c)


def shingles(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, hashes): whole sets of the documents in ids."""

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), X.blobs([h.tobytes() for _, h in X.shingle_sets(b.column("text"), words)])], ["doc_id", "hashes"])

    return _narrow(docs).join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, hashes binary")


def intersections(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(a, b, na, nb, both) of pairs of documents: sizes of their sets and of the intersection."""

    def test(batches):
        for b in batches:
            sizes, last, left = [], None, None
            for a, p, q in zip(b.column("a").to_pylist(), b.column("ha"), b.column("hb"), strict=True):
                if a != last:
                    last, left = a, np.frombuffer(p.as_buffer(), _U)
                right = np.frombuffer(q.as_buffer(), _U)
                sizes.append((len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array([s[k] for s in sizes], pa.int64()) for k in range(3))], ["a", "b", "na", "nb", "both"])

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    h = shingles(docs, ids, words)
    joined = pairs.join(h.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b").join(h.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")
    return joined.select("a", "b", "ha", "hb").mapInArrow(test, "a long, b long, na long, nb long, both long")


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold."""
    return intersections(pairs, docs, words).where(F.col("both") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b", "na", "nb", "both")


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sets, links): per document n and its class (smallest doc_id with an equal set, null for empty sets),
    and verified links between classes that span every component of the link graph.

    docs needs doc_id and text; other columns are ignored. Null and empty texts
    have no shingles and link with nothing; a text of fewer words is one
    shingle. Repeated rows with one doc_id count as one document with equal
    sets; a row without a doc_id can't be named in a link and has no class.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    sets = saved(signatures(docs, words, percent, common_shingles(docs, words, COMMON)))
    first = sets.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "prefix", "counts")).alias("r"))
    first = saved(first.select("n", "s1", "s2", "r.doc_id", "r.prefix", "r.counts"))
    classes = saved(sets.select("doc_id", "n", "s1", "s2").join(first.select("n", "s1", "s2", F.col("doc_id").alias("class_id")), ["n", "s1", "s2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")))
    del sets
    forget(spark)
    reps = first.select("doc_id", "n", "counts")
    held = saved(blocks(first))
    forget(spark)
    tested = saved(candidates(first_round(held).join(reps, "doc_id"), percent, True))
    forget(spark)
    links = saved(verified(tested, docs, words, percent))
    forget(spark)
    rest = second_round(held, components(links))
    more = saved(candidates(rest.join(reps, "doc_id"), percent, False).join(tested, ["a", "b"], "left_anti"))
    del held, rest, reps, first
    forget(spark)
    if not more.isEmpty():
        links = links.union(saved(verified(more, docs, words, percent)))
    return classes, links


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every document (see jaccard_links).

    component_id is the smallest doc_id reachable by links, itself included
    (null without a doc_id); one row per input row. Several texts of one doc_id
    are documents of their own, under that id.
    """
    if apart := told_apart(docs):
        return _under_old(jaccard_components(_under_new(apart[0]), words, percent), apart[1])
    classes, links = jaccard_links(docs, words, percent)
    return _out(classes, components(links))


def _under_new(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("_new").alias("doc_id"), "text")


def _under_old(out: DataFrame, ids: DataFrame) -> DataFrame:
    """Results for new ids (see told_apart) as those of the doc_ids they stand for."""
    for c in ("doc_id", "class_id", "component_id"):
        if c in out.columns:
            out = out.withColumnRenamed(c, "_new").join(ids, "_new", "left").drop("_new").withColumnRenamed("doc_id", f"_{c}")
    return out.select(*(F.col(f"_{c}").alias(c) if f"_{c}" in out.columns else F.col(c) for c in ("doc_id", "n_shingles", "class_id", "component_id", "n_links") if c in out.columns or f"_{c}" in out.columns))


def _out(classes: DataFrame, comp: DataFrame) -> DataFrame:
    out = classes.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id", "doc_id").alias("component_id"))


def count_links(members: DataFrame, links: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, n): documents of other classes that each class links with; members has node, component, copies.

    In a component of two classes they link. In larger ones the least node is
    the pivot; Jaccard distance is a metric, so classes within half of the
    allowed distance from it (inner ones) all link with each other and are only
    counted. The others (outer ones) are compared with all of their component,
    in tiles of whole sets.
    """
    spark = docs.sparkSession
    per = members.groupBy("component").agg(F.count("*").alias("classes"), F.sum("copies").alias("all"))
    members = saved(members.join(per, "component"))
    pairs = members.where("classes = 2").select("node", (F.col("all") - F.col("copies")).alias("n"))
    more = members.where("classes > 2")
    spokes = more.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    known = links.join(spokes, ["a", "b"], "left_semi").select("a", "b", "na", "nb", "both")
    spokes = known.union(intersections(saved(spokes.join(links, ["a", "b"], "left_anti")), docs, words))
    near = saved(spokes.where(200 * F.col("both") >= F.lit(100 + percent) * (F.col("na") + F.col("nb") - F.col("both"))).select(F.col("b").alias("node"), F.lit(True).alias("near")))
    forget(spark)
    more = more.join(near, "node", "left").withColumn("inner", (F.col("node") == F.col("component")) | F.col("near").isNotNull()).drop("near")
    sums = more.groupBy("component").agg(F.sum(F.when(F.col("inner"), F.col("copies")).otherwise(0)).alias("in_copies"), F.count_if("inner").alias("inners"), F.count_if(~F.col("inner")).alias("outers"))
    more = saved(more.join(sums, "component").select("node", "component", "copies", "inner", "in_copies", "inners", "outers"))
    inner = more.where("inner").select("node", (F.col("in_copies") - F.col("copies")).alias("n"))
    mixed = more.where("outers > 0").withColumn("ins", F.ceil(F.col("inners") / COUNTED)).withColumn("outs", F.ceil(F.col("outers") / COUNTED))
    mixed = mixed.withColumn("tile", F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs"))))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = mixed.where("inner").withColumn("j", upto("outs")).select(F.xxhash64("component", F.lit(0), "tile", "j").alias("group"), "node", "copies", F.lit(0).alias("side"))
    b = mixed.where("not inner").withColumn("j", upto("ins")).select(F.xxhash64("component", F.lit(0), "j", "tile").alias("group"), "node", "copies", F.lit(1).alias("side"))
    c = mixed.where("not inner").withColumn("j", upto("outs")).select(F.xxhash64("component", F.lit(1), F.least("tile", "j"), F.greatest("tile", "j")).alias("group"), "node", "copies", F.when(F.col("tile") == F.col("j"), 2).otherwise((F.col("tile") > F.col("j")).cast("int")).alias("side"))
    dealt = saved(a.union(b).union(c))
    forget(spark)
    sets = shingles(docs, dealt.select(F.col("node").alias("doc_id")).distinct(), words).withColumnRenamed("doc_id", "node")

    def count(batches):
        for t in X.each_group(batches, "group"):
            copies, side = t.column("copies").to_numpy(), t.column("side").to_numpy()
            near = linked([np.frombuffer(x.as_buffer(), _U) for x in t.column("hashes")], percent)
            near &= (side[:, None] != side[None]) | (side[:, None] == 2)
            yield pa.RecordBatch.from_arrays([pa.array(t.column("node").to_numpy()), pa.array(near @ copies)], ["node", "n"])

    outer = dealt.join(sets, "node").select("group", "node", "copies", "side", "hashes").repartition("group").sortWithinPartitions("group").mapInArrow(count, "node long, n long")
    outer = saved(outer)
    forget(spark)
    return pairs.union(inner).union(outer).groupBy("node").agg(F.sum("n").alias("n"))


def linked(sets: list[np.ndarray], percent: int, cells: int = 1 << 22) -> np.ndarray:
    """Which of the sets link with which, none with itself; intersections are sums over slices of the vocabulary."""
    n = np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    both, wide = np.zeros((len(sets), len(sets))), max(64, cells // len(sets))
    for lo in range(0, int(word[-1]) + 1, wide):
        i, j = np.searchsorted(word, (lo, lo + wide))
        x = np.zeros((len(sets), wide), np.float32)
        x[owner[i:j], word[i:j] - lo] = 1
        both += x @ x.T
    both = np.rint(both).astype(np.int64)
    near = 100 * both >= percent * (n[:, None] + n[None] - both)
    np.fill_diagonal(near, False)
    return near


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """jaccard_components with n_links: how many other documents (by doc_id) each one links with, copies included."""
    if apart := told_apart(docs):
        return _under_old(jaccard_join(_under_new(apart[0]), words, percent), apart[1])
    classes, links = jaccard_links(docs, words, percent)
    comp = saved(components(links))
    ids = classes.where("class_id is not null").select("class_id", "doc_id").distinct()
    copies = saved(ids.groupBy("class_id").agg(F.count("*").alias("copies")))
    members = comp.join(copies, F.col("node") == F.col("class_id")).select("node", "component", "copies")
    forget(docs.sparkSession)
    others = count_links(members, links, docs, words, percent).withColumnRenamed("node", "class_id")
    per = copies.join(others, "class_id", "left").select("class_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return _out(classes, comp).join(per, "class_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
