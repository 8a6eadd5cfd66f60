"""Delay embedding, covariance, whitening and source estimation on frames (recording_id, grid, sample, x array<double>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.operators.units import block_peaks, clustered, places, series_peaks, stored, variability

GRID = ("recording_id", "grid")
#: Samples of a block of vectors.
PACK = 1024
#: Contrast functions with their derivatives.
CONTRASTS = {"skew": (lambda v: v * v, lambda v: 2 * v), "kurtosis": (lambda v: v**3, lambda v: 3 * v * v), "logcosh": (np.tanh, lambda v: 1 - np.tanh(v) ** 2)}


def frames(samples: DataFrame) -> DataFrame:
    """One row per sample with the values of all channels in channel order."""
    pairs = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return samples.groupBy(*GRID, "sample").agg(pairs.alias("_p")).select(*GRID, "sample", F.col("_p.value").alias("x"))


def delay_embed(frames_: DataFrame, r: int, block: int = 4096) -> DataFrame:
    """Each vector followed by those of the r - 1 samples before it (zeros before the start, and for samples that are missing).

    Dealt out in blocks of samples with a halo, so a long recording is many
    tasks; a block is one matrix, which is shifted r times.
    """
    own, after = F.floor(F.col("sample") / block), F.floor((F.col("sample") + r - 1) / block)
    parts = F.array_distinct(F.array(own, after)) if r <= block else F.sequence(own, after)
    dealt = frames_.withColumn("_b", F.explode(parts)).groupBy(*GRID, "_b").agg(F.collect_list(F.struct("sample", "x")).alias("part"))

    def embed(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at, x, lo = np.array([p["sample"] for p in row.part]), np.array([p["x"] for p in row.part], float), row[2] * block
                mine = np.sort(at[at >= lo])
                if not len(mine):
                    continue
                flat = np.zeros((block + r - 1, x.shape[1]))
                flat[at - lo + r - 1] = x
                here = mine - lo + r - 1
                for k in range(0, len(here), 256):
                    out = np.hstack([flat[here[k : k + 256] - m] for m in range(r)])
                    yield pd.DataFrame({"recording_id": row.recording_id, "grid": row.grid, "sample": mine[k : k + 256], "x": list(out)})

    return dealt.mapInPandas(embed, "recording_id string, grid int, sample long, x array<double>")


def covariance_matrix(samples: DataFrame, ddof: int = 0) -> DataFrame:
    """(i, j, cov) of each pair of channels i <= j by partial Gram matrices of packed blocks: sums of a grid's blocks in a task go on together. Samples may be packed already."""
    schema = pa.schema({"recording_id": pa.string(), "grid": pa.int32(), "i": pa.int32(), "j": pa.int32(), "n": pa.int64(), "si": pa.float64(), "sj": pa.float64(), "p": pa.float64()})

    def table(sums: dict) -> pa.RecordBatch:
        upper = [np.triu_indices(len(s)) for _, s, _ in sums.values()]
        sizes = [len(i) for i, _ in upper]
        names = [pa.array(np.repeat(np.array([k[c] for k in sums], dtype=object), sizes), t) for c, t in enumerate(schema.types[:2])]
        cells = [(i, j, np.full(len(i), n), s[i], s[j], p[i, j]) for (i, j), (n, s, p) in zip(upper, sums.values(), strict=True)]
        return pa.RecordBatch.from_arrays(names + [pa.array(np.concatenate(c), t) for c, t in zip(zip(*cells, strict=True), schema.types[2:], strict=True)], schema=schema)

    def gram(batches):
        sums, held = {}, 0
        for batch in batches:
            for row, _, x in matrices(batch):
                key = (row["recording_id"], row["grid"])
                held += 0 if key in sums else x.shape[1] ** 2
                n, s, p = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(x), s + x.sum(0), p + x.T @ x)
                if held > 1 << 20:
                    yield table(sums)
                    sums, held = {}, 0
        if sums:
            yield table(sums)

    part = packed(samples if "part" in samples.columns else frames(samples)).select(*GRID, "part").mapInArrow(gram, "recording_id string, grid int, i int, j int, n long, si double, sj double, p double")
    t = part.groupBy(*GRID, "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "si", "sj", "p")))
    return t.select(*GRID, "i", "j", ((F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - ddof)).alias("cov"))


def eigen_cut(values: np.ndarray) -> float:
    """Where to cut descending eigenvalues: half way from the last one over the floor (mean of the lower half) to the next."""
    half = values[len(values) // 2 :]
    floor = max(0.0, float(half.mean())) if len(half) else 0.0
    above = values[values > floor]
    below = values[values <= floor]
    return (above[-1] + below[0]) / 2 if len(above) and len(below) else floor


def symmetric_whitening(c: np.ndarray) -> tuple[np.ndarray, int]:
    """Symmetric whitening matrix of a covariance from the eigenvalues above the cut, and their number."""
    d, e = np.linalg.eigh(c)
    d, e = d[::-1], e[:, ::-1]
    keep = d > eigen_cut(d)
    return (e[:, keep] / np.sqrt(d[keep])) @ e[:, keep].T, int(keep.sum())


def whitening_basis(cov: DataFrame) -> DataFrame:
    """Symmetric whitening matrix (row-major) and rank of each grid's covariance."""

    def solve(batches):
        for batch in batches:
            matrix, rank = [], []
            for cells in batch["cells"]:
                i, j, v = (cells.values.field(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "cov"))
                c = np.zeros((j.max() + 1, j.max() + 1))
                c[i, j] = c[j, i] = v
                m, r = symmetric_whitening(c)
                matrix.append(m.ravel())
                rank.append(r)
            yield pa.RecordBatch.from_arrays([batch[c] for c in GRID] + [pa.array(matrix, pa.list_(pa.float64())), pa.array(rank, pa.int32())], [*GRID, "matrix", "rank"])

    cells = cov.groupBy(*GRID).agg(F.collect_list(F.struct("i", "j", "cov")).alias("cells"))
    return cells.mapInArrow(solve, "recording_id string, grid int, matrix array<double>, rank int")


def whiten(frames_: DataFrame, basis: DataFrame) -> DataFrame:
    """Every vector times its grid's whitening matrix, block by block."""

    schema = pa.schema({"recording_id": pa.string(), "grid": pa.int32(), "sample": pa.int64(), "x": pa.list_(pa.float64())})

    def table(rows: list) -> pa.RecordBatch:
        sizes = [len(at) for _, at, _ in rows]
        keys = [np.repeat(np.array([row[c] for row, _, _ in rows], dtype=object), sizes) for c in GRID]
        width = np.concatenate([np.full(len(x), x.shape[1]) for _, _, x in rows])
        x = pa.ListArray.from_arrays(pa.array(np.append(0, width.cumsum()), pa.int32()), np.concatenate([x.ravel() for _, _, x in rows]))
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(np.concatenate([at for _, at, _ in rows]), pa.int64()), x], schema=schema)

    def apply(batches):
        for batch in batches:
            out, n = [], 0
            for row, at, x in matrices(batch):
                out.append((row, at, x @ row["matrix"].reshape(x.shape[1], -1)))
                n += out[-1][2].size
                if n > 1 << 20:
                    yield table(out)
                    out, n = [], 0
            if out:
                yield table(out)

    return packed(frames_).join(basis.select(*GRID, "matrix"), list(GRID)).select(*GRID, "part", "matrix").mapInArrow(apply, "recording_id string, grid int, sample long, x array<double>")


def packed(frames_: DataFrame, block: int = PACK) -> DataFrame:
    """One row per block of samples with its vectors (part), so that what is joined to a grid travels once a block and not with each sample. What is packed stays as it is."""
    if "part" in frames_.columns:
        return frames_.select(*GRID, "block", "part")
    return frames_.groupBy(*GRID, F.floor(F.col("sample") / block).alias("block")).agg(F.collect_list(F.struct("sample", "x")).alias("part"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(other columns, samples in order, their vectors as a matrix) of each packed row, from Arrow's buffers: no object is made for a number."""
    names = [c for c in batch.schema.names if c != "part"]
    rest = [[v.values.to_numpy() for v in batch[c]] if batch.schema.field(c).type == pa.list_(pa.float64()) else batch[c].to_pylist() for c in names]
    for row, part in zip(zip(*rest, strict=True), batch["part"], strict=True):
        at, x = part.values.field("sample").to_numpy(), part.values.field("x")
        flat, sizes = x.flatten().to_numpy(zero_copy_only=False), x.value_lengths()
        if sizes.null_count or len(pc.unique(sizes)) > 1:
            raise ValueError("the vectors of a grid differ in length")
        order = at.argsort(kind="stable")
        yield dict(zip(names, row, strict=True)), at[order], flat.astype(float, copy=False).reshape(len(at), -1)[order]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _projected(blocks: DataFrame, filters: DataFrame) -> DataFrame:
    """(keys, unit_uid, sample, s): products of packed vectors with all filters of their grid, a block times a matrix at once."""
    kind = filters.schema["unit_uid"].dataType.simpleString()
    units = filters.groupBy(*GRID).agg(F.collect_list(F.struct("unit_uid", "filter")).alias("units"))

    def multiply(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, w = np.array([p["x"] for p in row.part], float), np.array([u["filter"] for u in row.units], float)
                s = (x @ w.T).T
                ids, at = [u["unit_uid"] for u in row.units], [p["sample"] for p in row.part]
                yield pd.DataFrame({"recording_id": row.recording_id, "grid": row.grid, "unit_uid": [u for u in ids for _ in at], "sample": at * len(ids), "s": s.ravel()})

    return blocks.join(units, list(GRID)).mapInPandas(multiply, f"recording_id string, grid int, unit_uid {kind}, sample long, s double")


def pulse_train(frames_: DataFrame, filters: DataFrame) -> DataFrame:
    """Signed square of each vector's product with each unit's filter, block by block: no vector is copied for a unit."""
    return _projected(packed(frames_), filters).select("recording_id", "grid", "unit_uid", "sample", (F.col("s") * F.abs("s")).alias("value"))


def apply_filters(frames_: DataFrame, filters: DataFrame, totals: DataFrame, block: int = 1024) -> DataFrame:
    """Pulses of every unit over the whole recording from all windows of its grid: later windows win, zeros where there is none.

    frames_ also has win, totals (recording_id, total_samples). Of a sample's
    vectors the last window's is taken before any product.
    """
    last = frames_.groupBy(*GRID, "sample").agg(F.max_by("x", "win").alias("x"))
    s = _projected(packed(last, block), filters)
    return places(filters.select(*GRID, "unit_uid").join(totals, "recording_id")).join(s, [*GRID, "unit_uid", "sample"], "left").select(*GRID, "unit_uid", "sample", F.coalesce(F.col("s") * F.abs("s"), F.lit(0.0)).alias("value"))


def unit_spikes(frames_: DataFrame, filters: DataFrame, distance: int) -> DataFrame:
    """(unit_uid, spikes, sil, cov): upper peaks of each unit's pulse train without outliers, how well they are told apart, and the variability of their intervals (null under two spikes).

    The rules of find_peaks, two_means_split, reject_high_peaks, silhouette and
    isi_cov. A block of vectors is multiplied and searched where it lies; what
    is left of its peaks, and the runs at its borders, meet in one row a unit, as its spikes do.
    """
    key, kind = [*GRID, "unit_uid"], filters.schema["unit_uid"].dataType.simpleString()
    units = filters.groupBy(*GRID).agg(F.collect_list(F.struct("unit_uid", "filter")).alias("units"))
    arrays = {"at": pa.int64(), "value": pa.float64(), "a": pa.int64(), "b": pa.int64(), "level": pa.float64(), "end": pa.bool_()}

    def search(batches):
        for batch in batches:
            name = batch.schema.field("units").type.value_type.field("unit_uid").type
            schema = pa.schema([batch.schema.field(c) for c in (*GRID, "block")] + [pa.field("unit_uid", name)] + [pa.field(c, pa.list_(t)) for c, t in arrays.items()])
            out = []
            for row, at, x in matrices(batch):
                s = x @ np.array([u["filter"] for u in row["units"]], float).T
                for u, v in zip(row["units"], (s * np.abs(s)).T, strict=True):
                    out.append({**{c: row[c] for c in (*GRID, "block")}, "unit_uid": u["unit_uid"], **block_peaks(at, v, distance)})
            yield pa.RecordBatch.from_pylist(out, schema)

    def judge(batches):
        for batch in batches:
            out = []
            for part in batch["parts"]:
                p = part.values
                at, v = series_peaks(*(p.field(c).flatten().to_numpy(zero_copy_only=False) for c in arrays), p.field("a").value_lengths().to_numpy(), distance)
                spikes, sil = clustered(at, v)
                out.append((spikes, sil, variability(spikes) if len(spikes) > 1 else None))
            spikes, sil, cov = zip(*out, strict=True) if out else ((), (), ())
            columns = [batch[c] for c in key] + [pa.array(spikes, pa.list_(pa.int64())), pa.array(sil, pa.float64()), pa.array(cov, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*key, "spikes", "sil", "cov"])

    joined = packed(frames_).join(units, list(GRID)).select(*GRID, "block", "part", "units")
    told = joined.mapInArrow(search, f"recording_id string, grid int, block long, unit_uid {kind}, at array<long>, value array<double>, a array<long>, b array<long>, level array<double>, end array<boolean>")
    met = told.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", *arrays))).alias("parts"))
    return met.mapInArrow(judge, f"recording_id string, grid int, unit_uid {kind}, spikes array<long>, sil double, cov double")


def spike_sums(frames_: DataFrame, units: DataFrame, block: int = PACK) -> DataFrame:
    """(unit_uid, filter): sum of the vectors at each unit's spikes (array); spikes meet the blocks they lie in."""
    key, kind = [*GRID, "unit_uid"], units.schema["unit_uid"].dataType.simpleString()
    at = units.select(*key, F.explode("spikes").alias("sample")).withColumn("block", F.floor(F.col("sample") / block))
    own = at.groupBy(*key, "block").agg(F.collect_list("sample").alias("spikes")).groupBy(*GRID, "block").agg(F.collect_list(F.struct("unit_uid", "spikes")).alias("units"))

    def add(batches):
        for batch in batches:
            name = batch.schema.field("units").type.value_type.field("unit_uid").type
            schema = pa.schema([batch.schema.field(c) for c in GRID] + [pa.field("unit_uid", name), pa.field("w", pa.list_(pa.float64()))])
            out = []
            for row, at, x in matrices(batch):
                for u in row["units"]:
                    out.append({**{c: row[c] for c in GRID}, "unit_uid": u["unit_uid"], "w": x[np.isin(at, u["spikes"])].sum(0)})
            yield pa.RecordBatch.from_pylist(out, schema)

    sums = packed(frames_, block).join(own, [*GRID, "block"]).select(*GRID, "part", "units").mapInArrow(add, f"recording_id string, grid int, unit_uid {kind}, w array<double>")
    by_dim = sums.select(*key, F.posexplode("w").alias("dim", "v")).groupBy(*key, "dim").agg(F.sum("v").alias("v"))
    return by_dim.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("dim", "v")))["v"].alias("filter"))


def refine_by_isi(frames_: DataFrame, filters: DataFrame, distance: int) -> DataFrame:
    """(unit_uid, filter, cov, spikes, found): the least variability of intervals, the sum of the vectors at the spikes that gave it, and these spikes.

    All units advance together: upper peaks of the current filter without
    outliers, their variability, and the sum of the vectors at them as the next
    filter. A unit stops when its variability no longer falls below that of the
    round before (at first `cov` of filters, if it has that column), or with
    fewer than two spikes; without any improvement it keeps its filter and spikes
    are null. found: the spikes of the filter kept. Vectors are packed once; only
    whether units still move comes to the driver; each round is stored.
    """
    key = [*GRID, "unit_uid"]
    blocks = packed(frames_) if "part" in frames_.columns else stored(packed(frames_))
    now = filters.select(*key, "filter", (F.col("cov") if "cov" in filters.columns else F.lit(None).cast("double")).alias("last"), F.lit(None).cast("array<long>").alias("seen"))
    done = None
    while True:
        moves = F.col("cov").isNotNull() & (F.col("last").isNull() | (F.col("cov") < F.col("last")))
        step = stored(now.join(unit_spikes(blocks, now, distance), key, "left").select(*key, "filter", "last", "seen", "spikes", "cov", moves.alias("moves")))
        kept = step.where("not moves").select(*key, "filter", F.col("last").alias("cov"), F.col("seen").alias("spikes"), F.col("spikes").alias("found"))
        done = kept if done is None else done.union(kept)
        moving = step.where("moves")
        if moving.isEmpty():
            return done
        now = stored(moving.drop("filter").join(spike_sums(blocks, moving.select(*key, "spikes")), key).select(*key, "filter", F.col("cov").alias("last"), F.col("spikes").alias("seen")))


def spike_triggered_sum(frames_: DataFrame, spikes: DataFrame, unit_norm: bool = False) -> DataFrame:
    """(unit_uid, dim, weight): sum of the vectors at each unit's spikes."""
    at = frames_.join(spikes, [*GRID, "sample"])
    w = at.select(*GRID, "unit_uid", F.posexplode("x").alias("dim", "v")).groupBy(*GRID, "unit_uid", "dim").agg(F.sum("v").alias("weight"))
    if unit_norm:
        w = w.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") ** 2).over(W.partitionBy(*GRID, "unit_uid"))))
    return w


def activity_seed(frames_: DataFrame) -> DataFrame:
    """The vector at the sample with the greatest squared sum (the first of equal ones)."""
    if "part" in frames_.columns:
        frames_ = frames_.select(*GRID, "part").mapInArrow(_strongest, "recording_id string, grid int, sample long, x array<double>")
    power = F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v) ** 2, 9)
    return frames_.groupBy(*GRID).agg(F.min(F.struct((-power).alias("p"), "sample", "x")).alias("b")).select(*GRID, "b.sample", "b.x")


def _strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of packed blocks that may have the greatest squared sum of their block once sums are rounded."""
    for batch in batches:
        out = []
        for row, at, x in matrices(batch):
            p = sum(x.T, np.zeros(len(x))) ** 2
            top = np.fmax.reduce(p)
            for k in np.flatnonzero(~(p < top - 1e-8 - 1e-12 * top)):
                out.append({**row, "sample": at[k], "x": x[k]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([*(batch.schema.field(c) for c in GRID), pa.field("sample", pa.int64()), pa.field("x", pa.list_(pa.float64()))]))


def deflate(vectors: DataFrame, basis: DataFrame) -> DataFrame:
    """Vectors (array w) minus their projections on the accepted, orthonormal ones of their grid, at unit length."""
    b = basis.groupBy(*GRID).agg(F.collect_list("w").alias("_basis"))
    j = vectors.join(b, list(GRID), "left")
    # a value bound by one-element lists is computed once, not again for each element
    out = F.aggregate(F.coalesce("_basis", F.array().cast("array<array<double>>")), F.col("w"), lambda acc, q: F.get(F.transform(F.array(dot("w", q)), lambda d: F.zip_with(acc, q, lambda x, y: x - y * d)), F.lit(0)))
    unit = lambda w: F.get(F.transform(F.array(F.sqrt(dot(w, w))), lambda n: F.transform(w, lambda x: x / n)), F.lit(0))
    return j.withColumn("w", F.get(F.transform(F.array(out), unit), F.lit(0))).drop("_basis")


def contrast_step(frames_: DataFrame, vectors: DataFrame, contrast: str = "skew") -> DataFrame:
    """One fixed-point update E[x g(w'x)] - E[g'(w'x)] w of every grid's vector, before deflation: (dim, w)."""
    g, dg = CONTRASTS[contrast]

    schema = pa.schema({"recording_id": pa.string(), "grid": pa.int32(), "n": pa.int64(), "dg": pa.float64(), "xg": pa.list_(pa.float64()), "w": pa.list_(pa.float64())})

    def sums(batches):
        for batch in batches:
            out = []
            for row, _, x in matrices(batch):
                s = x @ row["w"]
                out.append({**{c: row[c] for c in (*GRID, "w")}, "n": len(s), "dg": dg(s).sum(), "xg": x.T @ g(s)})
            yield pa.RecordBatch.from_pylist(out, schema)

    part = packed(frames_).join(vectors.select(*GRID, "w"), list(GRID)).select(*GRID, "part", "w").mapInArrow(sums, "recording_id string, grid int, n long, dg double, xg array<double>, w array<double>")
    part = part.select(*GRID, "n", "dg", "w", F.posexplode("xg").alias("dim", "xg")).withColumn("w", F.get("w", F.col("dim")))
    return part.groupBy(*GRID, "dim").agg((F.sum("xg") / F.sum("n") - F.sum("dg") / F.sum("n") * F.first("w")).alias("w"))


def muap_segments(samples: DataFrame, spikes: DataFrame, r: int, totals: DataFrame) -> DataFrame:
    """(unit_uid, spike, channel, offset, value) around each spike whose window fits into the recording."""
    fit = spikes.join(totals, "recording_id").where((F.col("sample") >= r) & (F.col("sample") + r < F.col("total_samples")))
    at = fit.select("recording_id", "unit_uid", F.col("sample").alias("spike"), F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("offset")).withColumn("sample", F.col("spike") + F.col("offset"))
    return samples.join(at, ["recording_id", "sample"]).select("recording_id", "grid", "unit_uid", "spike", "channel", "offset", "value")


def spike_triggered_average(samples: DataFrame, spikes: DataFrame, r: int, totals: DataFrame) -> DataFrame:
    return muap_segments(samples, spikes, r, totals).groupBy("recording_id", "grid", "unit_uid", "channel", "offset").agg(F.avg("value").alias("mean"))


def peel_off(samples: DataFrame, spikes: DataFrame, r: int, totals: DataFrame, block: int = 2048) -> DataFrame:
    """The signal minus each unit's mean segment at all of its valid spikes; overlaps add up.

    The mean segments lie beside blocks of the signal, one row for a unit that
    has spikes near the block, and are laid out there: a task's memory follows
    its block, however many spikes are read together.
    """
    mean = spike_triggered_average(samples, spikes, r, totals)
    shapes = mean.groupBy("recording_id", "grid", "unit_uid").agg(F.collect_list(F.struct("channel", "offset", "mean")).alias("shape"))
    fit = spikes.join(totals, "recording_id").where((F.col("sample") >= r) & (F.col("sample") + r < F.col("total_samples")))
    near = F.sequence(F.floor((F.col("sample") - r) / block), F.floor((F.col("sample") + r) / block))
    put = fit.select("recording_id", "unit_uid", "sample", F.explode(near).alias("_b")).groupBy("recording_id", "unit_uid", "_b").agg(F.collect_list("sample").alias("at"))
    put = put.join(shapes, ["recording_id", "unit_uid"]).select(F.col("recording_id").alias("_r"), F.col("grid").alias("_g"), F.col("_b").alias("_o"), "at", "shape")
    rows = samples.withColumns({"value": F.col("value").cast("double"), "_b": F.floor(F.col("sample") / block)})

    def subtract(part: pa.Table, near: pa.Table) -> pa.Table:
        out = part.drop_columns("_b")
        if not part.num_rows or not near.num_rows:
            return out
        lo, channels = part["_b"][0].as_py() * block - r, pc.unique(part["channel"])
        total = np.zeros((len(channels), block + 2 * r))
        for at, shape in zip(near["at"].combine_chunks(), near["shape"].combine_chunks(), strict=True):
            channel, offset, mean_ = shape.values.flatten()
            known = pc.index_in(channel, value_set=channels)
            is_known = pc.is_valid(known).to_numpy(zero_copy_only=False)
            m = np.zeros((len(channels), 2 * r + 1))
            m[known.filter(is_known).to_numpy(), offset.filter(is_known).to_numpy() + r] = pc.fill_null(mean_, 0.0).filter(is_known).to_numpy()
            for s in at.values.to_numpy() - r - lo:
                a, b = max(s, 0), min(s + 2 * r + 1, total.shape[1])
                total[:, a:b] += m[:, a - s : b - s]
        minus = total[pc.index_in(part["channel"], value_set=channels).to_numpy(), part["sample"].to_numpy() - lo]
        return out.set_column(out.column_names.index("value"), "value", pc.subtract(part["value"], pa.array(minus)))

    return rows.groupBy(*GRID, "_b").cogroup(put.groupBy("_r", "_g", "_o")).applyInArrow(subtract, rows.drop("_b").schema)
