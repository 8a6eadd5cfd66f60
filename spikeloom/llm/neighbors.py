"""Embedding near-duplicates by NN-descent.

Random hyperplane blocks give every vector a first neighbour list; lists are
refined by joins of neighbours with neighbours of neighbours. A list whose last
entry still reaches the threshold is saturated and grows. Whatever links a block
or a join has seen, inside a list or not, is kept for the components, as one
edge to the least member for each vector. Every round draws new hyperplanes;
rounds go on until one has joined no more components, and an audit of a sample of
all vectors against brute force finds enough of their links. Only a label whose
audit still fails after the last round is searched exactly (column `search`).
Links are then counted inside components: vectors within half of the allowed
angle from a pivot all link and are only counted, the others are compared in
tiles, so no partner is capped and no pair is written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.llm import text as X
from spikeloom.llm.graph import components, saved

#: Length of neighbour lists and of saturated ones at most, tables of hyperplanes, aimed size of a block, most rows of one matrix.
LIST, LONGEST, TABLES, BLOCK, TILE = 8, 32, 6, 64, 512
#: Sampled queries of an audit, recall to reach, rounds at most.
AUDIT, RECALL, ROUNDS = 512, 0.995, 8
#: Marks an edge between a vector and the least one that it is joined with by links of its block.
JOINED = 2.0
#: Bytes of vectors that one pass of the exact search broadcasts, cells of each kind among them at most, places of one matrix.
HELD, CELLS, PLACES = 16_000_000, 64, 2_000_000


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, kind, vec): rows with a label and a finite vector that isn't zero; kind tells label and dimension apart."""

    def pack(batches):
        for b in batches:
            ids, kinds, raw = [], [], []
            for i, label, v in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding"), strict=True):
                if i is None or label is None or not v.is_valid or not len(v):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float32)
                if np.isfinite(x).all() and x.any():
                    ids.append(i), kinds.append(f"{label}/{len(x)}"), raw.append((x + np.float32(0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(raw, pa.binary())], ["vec_id", "kind", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(pack, "vec_id long, kind string, vec binary")


def _best(ids: np.ndarray, x: np.ndarray, most: int, threshold: float):
    """Each row's `most` nearest other rows, (u, v, sim), and the components of all links among the rows."""
    n = len(ids)
    if n < 2:
        return
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(most, n - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    yield np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()
    near = s >= threshold
    some = np.flatnonzero(near.any(1))
    if not len(some):
        return
    near = near[np.ix_(some, some)]
    least, ids = np.arange(len(some)), ids[some]
    while True:  # the least row each can reach
        new = np.minimum(least, np.where(near, least[None], len(some)).min(1))
        new = new[new]
        if (new == least).all():
            break
        least = new
    far = np.flatnonzero(least != np.arange(len(some)))
    yield ids[far], ids[least[far]], np.full(len(far), JOINED)


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    raw = t.column("vec").to_pylist()
    return t.column("vec_id").to_numpy(), _unit(raw, len(raw[0]) // 4)


def _edges(found):
    found = list(found)
    if found:
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        for k in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in cols], ["u", "v", "sim"])


def first_lists(reps: DataFrame, n: int, threshold: float, draw: int = 0) -> DataFrame:
    """Neighbours inside blocks of the draw-th set of hyperplanes; a block over TILE rows is dealt out anew by a hash of the id, another one in each table."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n) / BLOCK)), 0, 48))

    def code(batches):
        for b in batches:
            kinds = np.array(b.column("kind").to_pylist(), object)
            raw = b.column("vec").to_pylist()
            out = np.zeros((b.num_rows, TABLES), np.int64)
            for dim in {len(r) // 4 for r in raw}:
                rows = np.flatnonzero([len(r) == 4 * dim for r in raw])
                planes = np.random.default_rng([dim, draw]).normal(size=(dim, TABLES * bits))
                sign = (_unit([raw[r] for r in rows], dim) @ planes > 0).reshape(len(rows), TABLES, bits)
                out[rows] = sign @ (1 << np.arange(bits, dtype=np.int64)) if bits else 0
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([f"{k}/{t}/{c}" for k, c in zip(kinds, out[:, t], strict=True)]), b.column("vec")], ["vec_id", "block", "vec"])

    coded = reps.mapInArrow(code, "vec_id long, block string, vec binary")
    size = coded.groupBy("block").agg(F.count("*").alias("size"))
    dealt = coded.join(size, "block").select("vec_id", "vec", F.concat_ws("/", "block", F.when(F.col("size") > TILE, F.pmod(F.xxhash64("vec_id", "block", F.lit(draw)), F.ceil(F.col("size") / TILE)))).alias("block"))

    def search(batches):
        for t in X.each_group(batches, "block"):
            name = t.column("name").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.append(True, name[1:] != name[:-1]))  # blocks whose names share a hash
            for lo, hi in zip(at, np.append(at[1:], len(name)), strict=True):
                yield from _edges(_best(*_matrix(t.slice(lo, hi - lo)), LIST, threshold))

    return dealt.select(F.xxhash64("block").alias("block"), "vec_id", "vec", F.col("block").alias("name")).repartition("block").sortWithinPartitions("block", "name").mapInArrow(search, "u long, v long, sim double")


def shortest(edges: DataFrame, size: int, threshold: float) -> DataFrame:
    """The LIST nearest of each list, each neighbour once; up to `size` of those that reach the threshold."""
    one = edges.where(F.col("sim") < JOINED).groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = W.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return ranked.where((F.col("rank") <= LIST) | (F.col("sim") >= threshold)).drop("rank")


def descend(lists: DataFrame, reps: DataFrame, size: int, threshold: float) -> DataFrame:
    """Edges of one refinement: at every vector, its neighbours (of both directions) are compared with each other."""
    back = lists.select(F.col("v").alias("hub"), F.col("u").alias("vec_id"), "sim")
    fewer = back.withColumn("rank", F.row_number().over(W.partitionBy("hub").orderBy(F.desc("sim"), F.xxhash64("vec_id")))).where(F.col("rank") <= 2 * size)
    own = lists.select(F.col("u").alias("hub"), F.col("v").alias("vec_id")).union(fewer.select("hub", "vec_id")).distinct()

    def join(batches):
        for t in X.each_group(batches, "hub"):
            yield from _edges(_best(*_matrix(t), max(4, size // 2), threshold))

    return own.join(reps.select("vec_id", "vec"), "vec_id").select("hub", "vec_id", "vec").repartition("hub").sortWithinPartitions("hub").mapInArrow(join, "u long, v long, sim double")


def recall(reps: DataFrame, comp: DataFrame, threshold: float) -> dict[str, tuple[int, int]]:
    """By label: direct links of a sample (brute force against all vectors), and how many of them have both ends in one component.

    The sample is AUDIT vectors, drawn by hash from all vectors, linked or not.
    Links are counted exactly inside components, so the latter are the links that
    a result keeps. Labels without a link in the sample are left out.
    """
    all_ = reps.join(comp, "vec_id", "left").select("vec_id", "kind", "vec", F.coalesce("component", "vec_id").alias("component"))
    sample = all_.orderBy(F.xxhash64("vec_id", F.lit(5))).limit(AUDIT).collect()
    held = reps.sparkSession.sparkContext.broadcast([(r.vec_id, r.kind, bytes(r.vec), r.component) for r in sample])

    def test(batches):
        for b in batches:
            kinds, raw = np.array(b.column("kind").to_pylist(), object), b.column("vec").to_pylist()
            ids, comps = b.column("vec_id").to_numpy(), b.column("component").to_numpy()
            out = []
            for kind in {q[1] for q in held.value}:
                rows = np.flatnonzero(kinds == kind)
                qs = [q for q in held.value if q[1] == kind]
                if len(rows):
                    dim = len(qs[0][2]) // 4
                    hit = _unit([raw[r] for r in rows], dim) @ _unit([q[2] for q in qs], dim).T >= threshold
                    hit &= ids[rows][:, None] != np.array([q[0] for q in qs])
                    out.append((kind, int(hit.sum()), int((hit & (comps[rows][:, None] == np.array([q[3] for q in qs]))).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], ["kind", "links", "found"])

    found = all_.mapInArrow(test, "kind string, links long, found long").groupBy("kind").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
    return {r.kind: (r.links, r.found) for r in found.where("links > 0").collect()}  # labels of the sample: AUDIT at most


def _cells(t: pa.Table) -> dict[str, tuple]:
    """By kind: pivots, and the vectors and components in order of the nearest pivot, with the cuts between cells."""
    kinds, out = np.array(t.column("kind").to_pylist(), object), {}
    raw, comp = t.column("vec").to_pylist(), t.column("component").to_numpy()
    for kind in set(kinds):
        rows = np.flatnonzero(kinds == kind)
        x = _unit([raw[r] for r in rows], len(raw[rows[0]]) // 4)
        n = int(np.clip(np.sqrt(len(x)), 1, CELLS))
        pivots = x[np.random.default_rng(n).choice(len(x), n, replace=False)]
        cell = (x @ pivots.T).argmax(1)
        order = np.argsort(cell, kind="stable")
        out[kind] = pivots, [raw[r] for r in rows[order]], comp[rows[order]], np.searchsorted(cell[order], np.arange(n + 1))
    return out


def _bridges(x: np.ndarray, own: np.ndarray, cells: tuple, threshold: float):
    """Pairs of components that links between x and the vectors of the cells join, as a forest."""
    pivots, raw, comp, cuts = cells
    y, comp = _unit(raw, x.shape[1]), comp.copy()
    # nearest pivots of u and v are p and q: u.(p - q) >= 0, and a link moves v.(q - p) by |p - q| |u - v| at most
    far = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    c = x @ pivots.T
    best = c.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    may = c[np.arange(len(x)), best][:, None] - c <= far * apart[best] + 1e-6
    top: dict[int, int] = {}

    def root(k):
        while k in top:
            k = top[k]
        return k

    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        rows = np.flatnonzero(may[:, k]) if hi > lo else []
        step = max(1, PLACES // max(1, hi - lo))
        for at in range(0, len(rows), step):
            q = rows[at : at + step]
            near = x[q] @ y[lo:hi].T >= threshold
            if not near.any():
                continue
            i, j = np.nonzero(near & (own[q][:, None] != comp[lo:hi]))
            if not len(i):
                continue
            ends = np.unique(np.stack([own[q[i]], comp[lo + j]], 1), axis=0)
            for a, b in ends.tolist():
                a, b = sorted((root(a), root(b)))
                if a != b:
                    top[b] = a
                    yield a, b
            old = np.unique(ends)
            new = np.array([root(z) for z in old.tolist()])
            for labels in (own, comp):
                place = np.minimum(np.searchsorted(old, labels), len(old) - 1)
                labels[:] = np.where(old[place] == labels, new[place], labels)


def completed(reps: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """comp with all components joined that have a link between them; exact, whatever the lists have missed.

    Passes of HELD bytes of vectors are broadcast, and each is compared with the rows of its own and later passes.
    """
    passes = -(-(reps.agg(F.sum(F.length("vec"))).first()[0] or 0) // HELD)
    rows = saved(reps.join(comp, "vec_id", "left").select("vec_id", "kind", "vec", F.coalesce("component", "vec_id").alias("component"), F.col("component").isNotNull().alias("linked"), F.pmod(F.xxhash64("vec_id"), F.lit(max(1, passes))).alias("pass")))
    edges = rows.sparkSession.createDataFrame([], "a long, b long")
    for k in range(passes):
        held = rows.sparkSession.sparkContext.broadcast(_cells(rows.where(F.col("pass") == k).select("kind", "vec", "component").toArrow()))

        def test(batches, held=held):
            for b in batches:
                kinds, raw, own = np.array(b.column("kind").to_pylist(), object), b.column("vec").to_pylist(), b.column("component").to_numpy()
                found = []
                for kind in set(kinds) & set(held.value):
                    at = np.flatnonzero(kinds == kind)
                    found += _bridges(_unit([raw[r] for r in at], len(raw[at[0]]) // 4), own[at], held.value[kind], threshold)
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["a", "b"])

        edges = edges.union(saved(rows.where(F.col("pass") >= k).select("kind", "vec", "component").mapInArrow(test, "a long, b long").distinct()))
        held.unpersist()
    joined = components(edges).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return rows.join(joined, "component", "left").where(F.col("linked") | F.col("least").isNotNull()).select("vec_id", F.coalesce("least", "component").alias("component"))


def count_links(reps: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, links): linked vectors of each, with their copies, inside its component.

    The least vector of a component is its pivot. Angles obey the triangle
    inequality, so vectors within half of the allowed angle from it (inner ones)
    all link. The others (outer ones) are compared with all, tile by tile.
    """
    rows = reps.join(comp, "vec_id").select("vec_id", "vec", "copies", "component")
    pivots = reps.join(comp.where("vec_id = component"), "vec_id").select("component", F.col("vec").alias("pivot"))
    half = np.cos(np.arccos(threshold) / 2) + 1e-9

    def tell(batches):
        for b in batches:
            raw, piv = b.column("vec").to_pylist(), b.column("pivot").to_pylist()
            inner = np.zeros(b.num_rows, bool)
            for dim in {len(r) // 4 for r in raw}:
                at = np.flatnonzero([len(r) == 4 * dim for r in raw])
                inner[at] = (_unit([raw[k] for k in at], dim) * _unit([piv[k] for k in at], dim)).sum(1) >= half
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), b.column("copies"), b.column("component"), pa.array(inner)], ["vec_id", "vec", "copies", "component", "inner"])

    rows = saved(rows.join(pivots, "component").select("vec_id", "vec", "copies", "component", "pivot").mapInArrow(tell, "vec_id long, vec binary, copies long, component long, inner boolean"))
    sums = rows.groupBy("component").agg(F.sum(F.when(F.col("inner"), F.col("copies")).otherwise(0)).alias("in_copies"), F.count_if("inner").alias("inners"), F.count_if(~F.col("inner")).alias("outers"))
    rows = rows.join(sums, "component")
    counted = rows.where("inner").select("vec_id", (F.col("in_copies") - F.col("copies")).alias("links"))
    mixed = rows.where("outers > 0").withColumn("ins", F.ceil(F.col("inners") / TILE)).withColumn("outs", F.ceil(F.col("outers") / TILE))
    mixed = mixed.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs"))))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    row = ("vec_id", "vec", "copies", "component")
    a = mixed.where("inner").withColumn("j", upto("outs")).select(F.xxhash64("component", F.lit(0), "tile", "j").alias("group"), *row, F.lit(0).alias("side"))
    b = mixed.where("not inner").withColumn("j", upto("ins")).select(F.xxhash64("component", F.lit(0), "j", "tile").alias("group"), *row, F.lit(1).alias("side"))
    c = mixed.where("not inner").withColumn("j", upto("outs")).select(F.xxhash64("component", F.lit(1), F.least("tile", "j"), F.greatest("tile", "j")).alias("group"), *row, F.when(F.col("tile") == F.col("j"), 2).otherwise((F.col("tile") > F.col("j")).cast("int")).alias("side"))

    def count(batches):
        for t in X.each_group(batches, "group"):
            ids, x = _matrix(t)
            copies, side, own = (t.column(k).to_numpy() for k in ("copies", "side", "component"))
            near = (x @ x.T >= threshold) & ((side[:, None] != side[None]) | (side[:, None] == 2)) & (own[:, None] == own[None])
            np.fill_diagonal(near, False)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ copies)], ["vec_id", "links"])

    outer = a.union(b).union(c).repartition("group").sortWithinPartitions("group").mapInArrow(count, "vec_id long, links long")
    return counted.union(outer).groupBy("vec_id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept, search of every row of vectors (vec_id, embedding, label).

    Vectors link when label and dimension are equal and the cosine, in double
    precision, reaches the threshold. Null or zero vectors, null or non-finite
    components, null labels and null ids link with nothing. Equal vectors are
    one class during the search and count one by one in n_links. search tells
    what found a vector's component: `lists`, or `exact` for labels whose audit failed.
    """
    rows = saved(usable(vectors))
    classes = rows.groupBy("kind", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = saved(classes.select(F.col("rep").alias("vec_id"), "kind", "vec", "copies"))
    most = reps.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    size, lists, comp, mark, short = LIST, None, None, None, []
    for draw in range(ROUNDS):
        fresh = saved(first_lists(reps, most, threshold, draw))
        lists = saved(shortest(fresh if lists is None else lists.union(fresh), size, threshold))
        found = saved(descend(lists, reps, size, threshold))
        links = fresh.union(found).where(F.col("sim") >= threshold).select("u", "v")
        lists = saved(shortest(lists.union(found), size, threshold))
        if comp is not None:
            links = links.union(comp.select(F.col("vec_id").alias("u"), F.col("component").alias("v")))
        comp = saved(components(links, "u", "v").select(F.col("node").alias("vec_id"), "component"))
        last, mark = mark, comp.agg(F.count("*"), F.count_distinct("component")).first()
        full = not lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("last")).where((F.col("n") >= size) & (F.col("last") >= threshold)).isEmpty()
        if mark == last:
            short = [k for k, (n, got) in recall(reps, comp, threshold).items() if got < RECALL * n]
            if not short:
                break
        if full:
            size = min(2 * size, LONGEST)
    else:
        short = [k for k, (n, got) in recall(reps, comp, threshold).items() if got < RECALL * n]
    if short:
        comp = saved(comp.join(reps.where(F.col("kind").isin(short)).select("vec_id"), "vec_id", "left_anti").union(completed(reps.where(F.col("kind").isin(short)), comp, threshold)))
    counted = count_links(reps, comp, threshold)
    how = F.when(F.col("kind").isin(short), "exact").otherwise("lists") if short else F.lit("lists")
    found = reps.join(comp, "vec_id", "left").join(counted, "vec_id", "left").select("kind", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), how.alias("search"))
    own = rows.join(found, ["kind", "vec"]).select("vec_id", "n_links", "component_id", "search").distinct()
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(own, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce("search", F.lit("lists")).alias("search")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
