"""Whole-window steps: fitting units, and estimating one unit anew in a view.

A window (an analysis range of a grid, seconds to minutes) is the unit of work
and of memory: Spark deals out windows, a task holds one of them. Everything
over whole recordings is in the other modules.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.operators.decompose import CONTRASTS, GRID, PACK, activity_seed, contrast_step, matrices, packed, peel_off, refine_by_isi, spike_sums, symmetric_whitening, unit_spikes
from spikeloom.operators.decompose import frames as framed
from spikeloom.operators.signals import BANDS, butterworth_bandpass, filtfilt
from spikeloom.operators.units import clustered, peaks_1d, stored, upper_cluster, variability


@dataclass
class Fit:
    """niter: extractions; sil, cov: limits of units that are kept (cov only if given); peel: half width in seconds of what is taken out, if any; seed: extractions start at random vectors, drawn anew for each window and extraction."""

    fsamp: float
    niter: int = 150
    contrast: str = "skew"
    sil: float = 0.88
    cov: float | None = None
    peel: float | None = None
    apart: float = 0.02
    updates: int = 499
    tol: float = 1e-4
    seed: int | None = None

    def start(self, key: str, k: int, dim: int) -> np.ndarray:
        """The random vector of a window's k-th extraction."""
        return np.random.default_rng([self.seed, zlib.crc32(key.encode()), k]).standard_normal(dim)


def window_key(recording: str, grid: int, win: int) -> str:
    return f"{recording}\n{grid}\n{win}"


def squared(s: np.ndarray) -> np.ndarray:
    return s * np.abs(s)


def spikes_of(pulse: np.ndarray, distance: int) -> tuple[np.ndarray, float]:
    """Upper peaks of a pulse train without outliers (over mean + 3 deviations), and how well the two clusters are told apart."""
    at = peaks_1d(pulse, distance)
    return clustered(at, pulse[at])


def refined(x: np.ndarray, w: np.ndarray, cov: float, distance: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The sum of the vectors at a unit's spikes as its next filter, for as long as the intervals get more even.

    Gives the sum at the last spikes that were more even (the first filter if none
    were), these spikes, and their variability.
    """
    kept, last = w, (np.zeros(0, np.int64), cov)
    while True:
        spikes, _ = spikes_of(squared(x @ w), distance)
        if len(spikes) < 2:
            break
        now, w = variability(spikes), x[spikes].sum(0)
        if not now < last[1]:
            break
        kept, last = w, (spikes, now)
    return kept, last[0] if len(last[0]) > 1 else spikes_of(squared(x @ w), distance)[0], last[1]


def without_waveform(x: np.ndarray, spikes: np.ndarray, reach: int) -> np.ndarray:
    """Rows minus the mean stretch around the spikes, wherever it fits; overlaps add up."""
    at = spikes[(spikes >= reach) & (spikes < len(x) - reach)]
    if not len(at):
        return x
    offsets = np.arange(-reach, reach + 1)
    mean = sum(x[s - reach : s + reach + 1] for s in at) / len(at)
    x = x.copy()
    for s in at:
        x[s + offsets] -= mean
    return x


def fixed_point(x: np.ndarray, w: np.ndarray, basis: np.ndarray, cfg: Fit) -> np.ndarray:
    """One-unit iteration to the contrast's fixed point, orthogonal to the basis."""
    g, dg = CONTRASTS[cfg.contrast]
    for _ in range(cfg.updates):
        s = x @ w
        new = x.T @ g(s) / len(x) - dg(s).mean() * w
        new = new - basis @ (basis.T @ new)
        size = np.linalg.norm(new)
        if not size:
            break
        moved, w = abs(abs(new @ w) / size - 1), new / size
        if moved <= cfg.tol:
            break
    return w


def fit_window(x: np.ndarray, cfg: Fit, key: str = "") -> list[dict]:
    """Units of one window of whitened vectors (rows).

    Every extraction starts at the row with the greatest squared sum, or at a
    random vector, less what is in the basis. With over ten spikes it is refined, scored and, if it
    reaches the silhouette, taken out of the signal; else its vector only
    joins the basis.
    """
    distance, basis, out = round(cfg.apart * cfg.fsamp), np.zeros((x.shape[1], 0)), []
    for k in range(cfg.niter):
        seed = x[int((x.sum(1) ** 2).argmax())] if cfg.seed is None else cfg.start(key, k, x.shape[1])
        w = seed - basis @ (basis.T @ seed)
        if np.linalg.norm(w) < 1e-9:
            break  # the basis spans all
        w = fixed_point(x, w / np.linalg.norm(w), basis, cfg)
        spikes, _ = spikes_of(squared(x @ w), distance)
        if len(spikes) > 10:
            w, spikes, cov = refined(x, x[spikes].sum(0), variability(spikes), distance)
            w = w / max(np.linalg.norm(w), 1e-12)
            _, sil = spikes_of(squared(x @ w), distance)
            out.append({"unit": k, "filter": w, "sil": sil, "cov": cov, "spikes": spikes})
            if cfg.peel and sil > cfg.sil:
                x = without_waveform(x, spikes, round(cfg.peel * cfg.fsamp))
        basis = np.column_stack([basis, w])
    return [u for u in out if u["sil"] >= cfg.sil and (cfg.cov is None or u["cov"] <= cfg.cov)]


def fit_units(whitened: DataFrame, cfg: Fit) -> DataFrame:
    """(recording_id, grid, win, unit, filter, sil, cov, spikes) of the units of every window; spikes are samples of the recording.

    whitened has recording_id, grid, sample, x and may have win (else 0).
    """
    rows = whitened if "win" in whitened.columns else whitened.withColumn("win", F.lit(0))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        at = pdf["sample"].to_numpy()
        key = {c: pdf[c].iloc[0] for c in ("recording_id", "grid", "win")}
        found = fit_window(np.stack(pdf["x"].to_numpy()), cfg, window_key(*key.values()))
        return pd.DataFrame([key | u | {"spikes": at[u["spikes"]]} for u in found], columns=[*key, "unit", "filter", "sil", "cov", "spikes"])

    return rows.groupBy(*GRID, "win").applyInPandas(fit, UNITS)


UNITS = "recording_id string, grid int, win int, unit int, filter array<double>, sil double, cov double, spikes array<long>"


def _fit_whole(blocks: DataFrame, cfg: Fit) -> DataFrame:
    """The units of windows (key, recording_id, grid, win, block, part) that are small enough for one row each."""
    own, parts = ["recording_id", "grid", "win"], int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema({"recording_id": pa.string(), "grid": pa.int32(), "win": pa.int32(), "unit": pa.int32(), "filter": pa.list_(pa.float64()), "sil": pa.float64(), "cov": pa.float64(), "spikes": pa.list_(pa.int64())})

    def fit(batches):
        for batch in batches:
            out = []
            for row, at, x in matrices(batch):
                out += [row | u | {"spikes": at[u["spikes"]]} for u in fit_window(x, cfg, window_key(*row.values()))]
            yield pa.RecordBatch.from_pylist(out, schema)

    # a window is few bytes and much work: a number that is given keeps Spark from gathering them in one task
    rows = blocks.repartition(parts, *own).groupBy(*own).agg(F.flatten(F.collect_list("part")).alias("part"))
    return rows.mapInArrow(fit, UNITS)


def fit_units_distributed(whitened: DataFrame, cfg: Fit) -> DataFrame:
    """The units of fit_units for windows that are larger than a worker: all windows go step by step together, each step a job over their vectors.

    An extraction is a seed, fixed-point updates (contrast_step, of windows that
    still move), peaks, refinement and scores. Vectors are packed into blocks
    and stored once (again only when something is peeled off), and steps read
    these blocks. A window's state (its vector and basis) is one row, and so are
    its peaks. Each step is
    written, so that a lost executor costs one step; the driver only learns
    whether anything still moves. A window ends when its basis spans all.
    Windows of no more vectors than a block holds would only wait for each other: they are fitted whole, each in a task.
    """
    spark = whitened.sparkSession
    rows = whitened if "win" in whitened.columns else whitened.withColumn("win", F.lit(0))
    name = F.concat_ws("\n", "recording_id", F.col("grid").cast("string"), F.col("win").cast("string"))
    own = ["recording_id", "grid", "win"]
    blocks = rows.groupBy(*own, F.floor(F.col("sample") / PACK).alias("block")).agg(F.collect_list(F.struct("sample", "x")).alias("part"))
    x = stored(blocks.select(name.alias("key"), *own, "block", "part"))
    bounds = F.min(F.array_min("part.sample")).alias("start"), F.max(F.array_max("part.sample")).alias("end"), F.sum(F.size("part")).alias("n")
    windows = stored(x.groupBy("key", *own).agg(*bounds))
    small = windows.where(F.col("n") <= PACK)
    done = _fit_whole(x.join(small.select("key"), "key", "left_semi"), cfg)
    x, windows = x.join(small.select("key"), "key", "left_anti"), windows.where(F.col("n") > PACK)
    if windows.isEmpty():
        return done
    x = x.select(F.col("key").alias("recording_id"), "grid", "block", "part")
    starts = windows.select(F.col("key").alias("recording_id"), "start")
    totals = windows.select(F.col("key").alias("recording_id"), (F.col("end") - F.col("start") + 1).alias("total_samples"))
    distance, grid, uid = round(cfg.apart * cfg.fsamp), list(GRID), [*GRID, "unit_uid"]
    state = windows.select(F.col("key").alias("recording_id"), "grid", F.array().cast("array<array<double>>").alias("basis"))
    moving = "recording_id string, grid int, basis array<array<double>>, w array<double>, moving boolean"

    def free(w: np.ndarray, basis) -> np.ndarray:
        b = np.array([np.asarray(v) for v in basis]).reshape(-1, len(w))
        return w - b.T @ (b @ w)

    def vectors(df: DataFrame) -> DataFrame:
        return df.groupBy(*grid).agg(F.array_sort(F.collect_list(F.struct("dim", "w")))["w"].alias("new"))

    found = []
    for k in range(cfg.niter):

        def begin(batches, k=k):
            for pdf in batches:
                seeds = pdf["w"] if cfg.seed is None else [cfg.start(r, k, len(w)) for r, w in zip(pdf["recording_id"], pdf["w"], strict=True)]
                w = [free(np.asarray(v, float), b) for v, b in zip(seeds, pdf["basis"], strict=True)]
                size = np.array([np.linalg.norm(v) for v in w])
                out = pdf.assign(w=[(v / max(n, 1e-300)).tolist() for v, n in zip(w, size, strict=True)], moving=True)
                yield out[size >= 1e-9]

        def turn(batches):
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    w, still = np.asarray(r["w"]), r["moving"]
                    if still:
                        new = free(np.asarray(r["new"]), r["basis"])
                        size = np.linalg.norm(new)
                        if size:
                            still, w = bool(abs(abs(new @ w) / size - 1) > cfg.tol), new / size
                        else:
                            still = False
                    out.append({**{c: r[c] for c in ("recording_id", "grid", "basis")}, "w": w.tolist(), "moving": still})
                yield pd.DataFrame(out)

        seeds = activity_seed(x).select(*GRID, F.col("x").alias("w"))
        now = stored(state.join(seeds, grid).mapInPandas(begin, moving))
        if now.isEmpty():
            break
        for _ in range(cfg.updates):
            active = now.where("moving")
            if active.isEmpty():
                break
            step = vectors(contrast_step(x, active.select(*GRID, "w"), cfg.contrast))
            now = stored(now.join(step, grid, "left").mapInPandas(turn, moving))
        many = stored(unit_spikes(x, now.select(*GRID, F.lit(k).alias("unit_uid"), F.col("w").alias("filter")), distance).where("size(spikes) > 10").select(*uid, "spikes", "cov"))
        first = stored(spike_sums(x, many).join(many.select(*uid, "cov"), uid))
        fine = stored(refine_by_isi(x, first, distance))
        # without an improvement the spikes are those of the sum at the first filter's spikes
        again = spike_sums(x, fine.where("spikes is null and size(found) > 1").select(*uid, F.col("found").alias("spikes")))
        last = unit_spikes(x, again, distance).select(*uid, F.col("spikes").alias("_last"))
        size = F.sqrt(F.aggregate("filter", F.lit(0.0), lambda a, v: a + v * v))
        fine = fine.withColumn("_size", F.greatest(size, F.lit(1e-12))).withColumn("w", F.transform("filter", lambda v: v / F.col("_size")))
        sil = unit_spikes(x, fine.select(*uid, F.col("w").alias("filter")), distance).select(*uid, "sil")
        fine = stored(fine.join(last, uid, "left").join(sil, uid, "left").select(*uid, "w", "cov", F.coalesce("sil", F.lit(0.0)).alias("sil"), F.coalesce("spikes", "_last", "found", F.array().cast("array<long>")).alias("spikes")))
        found.append(fine)
        out = fine.where(F.col("sil") > cfg.sil).select("recording_id", "unit_uid", F.explode("spikes").alias("sample")) if cfg.peel else None
        if out is not None and not out.isEmpty():
            own_time = lambda df: df.join(starts, "recording_id").withColumn("sample", F.col("sample") - F.col("start")).drop("start")
            samples = own_time(x.select(*GRID, F.inline("part"))).select(*GRID, "sample", F.posexplode("x").alias("channel", "value"))
            left = framed(peel_off(samples, own_time(out), round(cfg.peel * cfg.fsamp), totals)).join(starts, "recording_id")
            x = stored(packed(left.select(*GRID, (F.col("sample") + F.col("start")).alias("sample"), "x")))
        grown = F.concat("basis", F.array(F.coalesce("_f", "w")))
        state = stored(now.join(fine.select(*GRID, F.col("w").alias("_f")), grid, "left").select(*GRID, grown.alias("basis")))
    if not found:
        return done
    all_ = found[0]
    for df in found[1:]:
        all_ = all_.union(df)
    kept = all_.where(F.col("sil") >= cfg.sil) if cfg.cov is None else all_.where((F.col("sil") >= cfg.sil) & (F.col("cov") <= cfg.cov))
    named = kept.drop("grid").withColumnRenamed("recording_id", "key").join(windows, "key")
    return done.union(named.select(*own, F.col("unit_uid").cast("int").alias("unit"), F.col("w").alias("filter"), "sil", "cov", "spikes"))


def embedded(x: np.ndarray, r: int) -> np.ndarray:
    """Rows followed by the r - 1 rows before each (zeros before the start)."""
    return np.hstack([np.vstack([np.zeros((min(m, len(x)), x.shape[1])), x[: max(0, len(x) - m)]]) for m in range(r)])


def conditioned(x: np.ndarray, fsamp: float, width: int, band=None) -> np.ndarray:
    """The signal (rows) of a view filtered, embedded and whitened: the same for all units in it."""
    low, high, order = band or BANDS["surface"]
    sections = butterworth_bandpass(order, low, high, fsamp)
    x = np.column_stack([filtfilt(c, sections) for c in x.T])
    e = embedded(x, max(1, round(width / x.shape[1])))
    return e @ symmetric_whitening(np.cov(e, rowvar=False, ddof=0).reshape(e.shape[1], -1))[0]


def changes(n: int, start: int, own: np.ndarray, fsamp: float) -> bool:
    """Whether a view of n samples is long enough and has spikes of its unit inside."""
    edge = round(0.1 * fsamp)
    return n > 2 * edge and bool(((own >= start + edge) & (own < start + n - edge)).any())


def estimated(white: np.ndarray, start: int, own: np.ndarray, fsamp: float, others: list[np.ndarray], artifacts: np.ndarray, lock: bool, peel: float = 0.025) -> tuple[np.ndarray, np.ndarray] | None:
    """Pulse of a view and the spikes found in it, from its conditioned signal; None if nothing changes."""
    edge, n = round(0.1 * fsamp), len(white)
    inside = own[(own >= start + edge) & (own < start + n - edge)] - start
    for spikes in (*others, artifacts):
        local = spikes - start
        white = without_waveform(white, local[(local >= edge) & (local < n - edge)], round(peel * fsamp))
    w = white[inside].sum(0)
    s = white @ (w / max(np.linalg.norm(w), 1e-12))
    s[:edge] = s[-edge:] = 0
    pulse = squared(s)
    at = peaks_1d(pulse, round(0.005 * fsamp))
    if len(at) <= 2:
        return None
    up = upper_cluster(pulse[at])
    if up.all():
        return None
    new = at[up]
    new = new[pulse[new] <= 3 * pulse[new].mean()]
    if lock:
        gap = np.abs(at[None] - inside[:, None])
        near = gap.argmin(1)
        new = np.union1d(np.where(gap.min(1) <= 10, at[near], inside), new)
    return pulse, (new + start).astype(np.int64)


def update_view(x: np.ndarray, start: int, own: np.ndarray, fsamp: float, width: int, others: list[np.ndarray], artifacts: np.ndarray, lock: bool, band=None, peel: float = 0.025) -> tuple[np.ndarray, np.ndarray] | None:
    """Pulse of a view and all spikes of its unit, estimated anew from the signal (rows) of the view; None if nothing changes."""
    edge = round(0.1 * fsamp)
    got = estimated(conditioned(x, fsamp, width, band), start, own, fsamp, others, artifacts, lock, peel) if changes(len(x), start, own, fsamp) else None
    if got is None:
        return None
    spikes = np.union1d(own[(own < start + edge) | (own > start + len(x) - edge)], got[1])
    return got[0], spikes[spikes >= 0].astype(np.int64)


def update_filter_window(samples: DataFrame, spikes: DataFrame, views: DataFrame, fsamp: float, width: int = 1000, flagged: DataFrame | None = None, artifacts: DataFrame | None = None, peel_others: bool = False, lock: bool = False, band=None, block: int = 4096) -> DataFrame:
    """(recording_id, grid, unit_uid, start, changed, pulse, spikes): one row per view with the unit's pulse in it and all of its spikes.

    samples: (recording_id, grid, channel, sample, value); spikes also with
    grid; views: (recording_id, grid, unit_uid, start, end), end left out. With
    peel_others, what other units of the grid that are not flagged add to the
    signal is taken out; artifacts (recording_id, unit_uid, sample) always are.
    A view of at most 0.2 s, or without spikes inside, or whose peaks don't
    fall into two clusters, changes nothing: its pulse is null.

    Units with the same range of a grid share its signal, which is laid out and
    conditioned once; signal and spikes meet their ranges by blocks of samples.
    All spikes of a unit only come to its views at the end.
    """
    range_, unit = [*GRID, "start", "end"], [*GRID, "unit_uid"]
    ranges = views.select(*range_).distinct()
    own_block = F.floor(F.col("sample") / block).alias("_b")
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("_b")

    def inside(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
        cut = of.where("end > start").select("*", blocks)
        return rows.select("*", own_block).join(cut, [*keys, "_b"]).where("sample >= start and sample < end").drop("_b")

    signal = inside(framed(samples), ranges, list(GRID)).select(*range_, "sample", "x")
    kept = F.lit(True)
    named = spikes.select(*unit, "sample")
    if flagged is not None:
        named = named.join(flagged.select("recording_id", "unit_uid").distinct().withColumn("_f", F.lit(True)), ["recording_id", "unit_uid"], "left")
        kept = F.col("_f").isNull()
    none = F.lit(None).cast("long")
    parts = inside(named, ranges, list(GRID)).select(*range_, "unit_uid", F.when(kept, "spike").otherwise("flagged").alias("part"), "sample")
    parts = parts.union(views.select(*range_, "unit_uid", F.lit("view"), none).distinct())
    if artifacts is not None:
        bad = inside(artifacts.select("recording_id", "unit_uid", "sample"), views.select(*range_, "unit_uid").distinct(), ["recording_id", "unit_uid"])
        parts = parts.union(bad.select(*range_, "unit_uid", F.lit("artifact"), "sample"))
    parts = parts.toDF("_r", "_g", "_s", "_e", "unit_uid", "part", "sample")

    def estimate(signal_: pd.DataFrame, parts_: pd.DataFrame) -> pd.DataFrame:
        if not len(signal_):
            return pd.DataFrame()
        signal_ = signal_.sort_values("sample")
        of = lambda p: np.sort(p["sample"].to_numpy(np.int64))
        part = {kind: {u: of(p) for u, p in g.groupby("unit_uid")} for kind, g in parts_[parts_["part"] != "view"].groupby("part")}
        spikes_, flagged_, bad = (part.get(kind, {}) for kind in ("spike", "flagged", "artifact"))
        x, start, white, none = np.stack(signal_["x"].to_numpy()), int(signal_["start"].iloc[0]), None, np.zeros(0, np.int64)
        row, out = {c: signal_[c].iloc[0] for c in range_}, []
        names = sorted(spikes_, key=str)
        for u in parts_.loc[parts_["part"] == "view", "unit_uid"]:
            own = np.sort(np.concatenate([spikes_.get(u, none), flagged_.get(u, none)]))
            got = None
            if changes(len(x), start, own, fsamp):
                white = conditioned(x, fsamp, width, band) if white is None else white
                got = estimated(white, start, own, fsamp, [spikes_[v] for v in names if v != u] if peel_others else [], bad.get(u, none), lock)
            out.append(row | {"unit_uid": u, "n": len(x), "pulse": got[0] if got else None, "new": got[1] if got else None})
        return pd.DataFrame(out)

    kind = views.schema["unit_uid"].dataType.simpleString()
    schema = f"recording_id string, grid int, start long, end long, unit_uid {kind}, n long, pulse array<double>, new array<long>"
    new = signal.groupBy(*range_).cogroup(parts.groupBy("_r", "_g", "_s", "_e")).applyInPandas(estimate, schema)
    all_ = spikes.groupBy(*unit).agg(F.array_sort(F.collect_list(F.col("sample").cast("long"))).alias("_all"))
    edge = round(0.1 * fsamp)
    outside = F.filter("_all", lambda s: (s >= 0) & ((s < F.col("start") + edge) | (s > F.col("start") + F.col("n") - edge)))
    changed = F.array_sort(F.array_union(outside, F.filter("new", lambda s: s >= 0)))
    rows = new.join(all_, unit, "left").withColumn("_all", F.coalesce("_all", F.array().cast("array<long>")))
    return rows.select(*unit, "start", F.col("pulse").isNotNull().alias("changed"), "pulse", F.when(F.col("pulse").isNull(), F.col("_all")).otherwise(changed).alias("spikes"))
