"""Spike trains: peaks, two-means split, intervals, scores and duplicates.

Tables: pulses and spikes (recording_id, unit_uid, sample[, value]).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNIT = ("recording_id", "unit_uid")
#: Samples of a series that one task takes at once.
BLOCK = 1 << 18


def ready_checkpoints(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where none is set and all runs on one machine (tests) a local one."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which goes when the driver ends."""
    spark = df.sparkSession
    path = f"{ready_checkpoints(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _by_sample():
    return W.partitionBy(*UNIT).orderBy("sample")


def local_maxima(pulses: DataFrame, block: int = BLOCK) -> DataFrame:
    """Samples higher than both sides; the middle (rounded down) of a flat top. The ends of a series are no maxima.

    Series are cut into blocks of samples. Runs of equal values inside a block
    are decided there; the first and last run of each block, two rows a block,
    are put in order over the whole series, joined where they go on, and then decided.
    """
    own = W.partitionBy(*UNIT, "_b").orderBy("sample")
    edge = F.coalesce(F.lag("value").over(own) != F.col("value"), F.lit(True)).cast("int")
    cut = pulses.select(*UNIT, "sample", "value", F.floor(F.col("sample") / block).alias("_b"))
    runs = cut.withColumn("_run", F.sum(edge).over(own)).groupBy(*UNIT, "_b", "_run").agg(F.min("sample").alias("a"), F.max("sample").alias("b"), F.first("value").alias("value"))
    w = W.partitionBy(*UNIT, "_b").orderBy("_run")
    near = runs.withColumn("_before", F.lag("value").over(w)).withColumn("_after", F.lead("value").over(w))
    inner = near.where("_before is not null and _after is not null").select(*UNIT, "a", "b", "value", "_before", "_after")
    u = W.partitionBy(*UNIT).orderBy("a")
    last = F.lag("value").over(u)
    new = F.when(F.col("_before").isNotNull() | last.isNull() | (last != F.col("value")), 1).otherwise(0)
    ends = near.where("_before is null or _after is null")
    ends = ends.withColumn("_new", new).withColumn("_p", F.coalesce("_before", last)).withColumn("_q", F.coalesce("_after", F.lead("value").over(u))).withColumn("_g", F.sum("_new").over(u))
    joined = ends.groupBy(*UNIT, "_g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("value").alias("value"), F.min_by("_p", "a").alias("_before"), F.max_by("_q", "a").alias("_after"))
    all_ = inner.union(joined.select(inner.columns))
    return all_.where("value > _before and value > _after").select(*UNIT, F.floor((F.col("a") + F.col("b")) / 2).alias("sample"), "value")


def apart(at: np.ndarray, value: np.ndarray, distance: int) -> np.ndarray:
    """Flags of the sorted places kept: highest first (the later of equal ones), nothing nearer than `distance` to a chosen one."""
    keep = np.ones(len(at), bool)
    lo, hi = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    for k in np.lexsort((-at, -value)):
        if keep[k]:
            keep[lo[k] : hi[k]] = False
            keep[k] = True
    return keep


#: What is known of a peak: to be decided here, decided elsewhere but not known yet, chosen for certain.
OPEN, UNKNOWN, CHOSEN = 0, 1, 2


def settled(at: np.ndarray, value: np.ndarray, known: np.ndarray, distance: int) -> np.ndarray:
    """The same choice where only a part of the peaks is seen: 1 kept, 0 dropped, -1 if it hangs on a peak whose fate isn't known."""
    out = np.full(len(at), -2, np.int8)
    lo, hi = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    for k in np.lexsort((-at, -value)):
        seen = out[lo[k] : hi[k]]
        out[k] = 1 if known[k] == CHOSEN else 0 if (seen == 1).any() else -1 if known[k] == UNKNOWN or (seen == -1).any() else 1
    return out


def _settle(peaks: DataFrame, distance: int, block: int) -> DataFrame:
    """peaks (with known) that aren't dropped, with `state`; a block sees the peaks within `distance` of it as unknown ones. edge: near a border."""

    @F.pandas_udf("array<tinyint>")
    def states(at: pd.Series, value: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([settled(np.asarray(a), np.asarray(v), np.asarray(k), distance) for a, v, k in zip(at, value, known, strict=True)])

    at = F.col("sample")
    own, low, high = F.floor(at / block), F.floor((at - distance + 1) / block), F.floor((at + distance - 1) / block)
    dealt = peaks.withColumn("_own", own).withColumn("_b", F.explode(F.array_distinct(F.array(own, low, high)))).withColumn("_edge", low != high)
    known = F.when((F.col("_own") != F.col("_b")) & (F.col("known") == OPEN), F.lit(UNKNOWN)).otherwise(F.col("known"))
    rows = dealt.groupBy(*UNIT, "_b").agg(F.array_sort(F.collect_list(F.struct("sample", "value", known.alias("known"), (F.col("_own") == F.col("_b")).alias("mine"), F.col("_edge").alias("edge")))).alias("p"))
    rows = rows.withColumn("s", states("p.sample", "p.value", "p.known")).select(*UNIT, F.explode(F.arrays_zip("p", "s")).alias("x"))
    return rows.where("x.p.mine and x.s <> 0").select(*UNIT, "x.p.sample", "x.p.value", F.col("x.s").alias("state"), "x.p.edge", F.col("x.p.known").alias("was"))


def thin_peaks(peaks: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Highest first (the later of equal ones), peaks nearer than `distance` to a chosen one are dropped.

    Each block of a unit decides all that doesn't hang on peaks beyond its
    borders. The few that do meet, with what has been chosen near borders, in
    blocks sixty-four times as long, and what is still open then (chains of ever
    higher peaks across such blocks) in runs with gaps under `distance`.
    """
    block = max(block, 4 * distance)
    first = stored(_settle(peaks.select(*UNIT, "sample", "value", F.lit(OPEN).alias("known")), distance, block))
    cols = [*UNIT, "sample", "value"]
    kept, rest = first.where("state = 1").select(cols), first
    for width in (64 * block, None):
        # what hangs on something, and what it may hang on
        open_ = F.when(F.col("state") == 1, F.lit(CHOSEN)).otherwise(F.lit(OPEN)).alias("known")
        rest = rest.where("state = -1 or edge").select(*cols, open_)
        if width:
            rest = _settle(rest, distance, width)
        else:
            near = F.coalesce(F.col("sample") - F.lag("sample").over(_by_sample()) >= distance, F.lit(True)).cast("int")
            rest = _settle(rest.withColumn("unit_uid", F.struct("unit_uid", F.sum(near).over(_by_sample()).alias("island"))), distance, 1 << 62).withColumn("unit_uid", F.col("unit_uid.unit_uid"))
        kept = kept.union(rest.where(f"state = 1 and was = {OPEN}").select(cols))
    return kept


def find_peaks(pulses: DataFrame, distance: int, low: float | None = None, high: float | None = None, block: int = BLOCK) -> DataFrame:
    """Local maxima, inside the inclusive height band if given, at least `distance` samples apart; a long series is many tasks."""
    peaks = local_maxima(pulses, block)
    if low is not None:
        peaks = peaks.where(F.col("value") >= low)
    if high is not None:
        peaks = peaks.where(F.col("value") <= high)
    return thin_peaks(peaks, distance, block)


def two_means_split(peaks: DataFrame) -> DataFrame:
    """Adds `high`: whether a peak is in the upper cluster of the best split of its unit's heights.

    Exact in one dimension: costs of all cuts of the sorted heights by prefix
    sums, least cost, lowest cut on ties; a cut between equal heights is never
    the best. One peak, or equal heights, are all high. Heights are counted, and
    put into buckets in order (64 for each power of two): sums of the buckets
    before it are all that a bucket needs, so a unit is as many tasks as it has buckets.
    """
    v, n = F.col("value"), F.col("_n")
    size = F.floor(F.log2(F.abs(v)) * 64) + 100_000
    own = F.when(v > 0, size).when(v < 0, -size).otherwise(0)
    counts = peaks.groupBy(*UNIT, own.alias("_b"), "value").agg(F.count("*").alias("_n"))
    sums = counts.groupBy(*UNIT, "_b").agg(F.sum(n).alias("_n"), F.sum(n * v).alias("_s"), F.sum(n * v * v).alias("_q"))
    order, whole = W.partitionBy(*UNIT).orderBy("_b"), W.partitionBy(*UNIT)
    sums = sums.select(*UNIT, "_b", *((F.sum(c).over(order) - F.col(c)).alias(f"{c}0") for c in ("_n", "_s", "_q")), *(F.sum(c).over(whole).alias(f"{c}1") for c in ("_n", "_s", "_q")))
    inside = W.partitionBy(*UNIT, "_b").orderBy("value")
    c = counts.join(sums, [*UNIT, "_b"]).select(*UNIT, "value", *((F.col(f"{k}0") + F.sum(x).over(inside)).alias(k) for k, x in (("_n", n), ("_s", n * v), ("_q", n * v * v))), "_n1", "_s1", "_q1")
    cost = F.col("_q") - F.col("_s") ** 2 / n + F.col("_q1") - F.col("_q") - (F.col("_s1") - F.col("_s")) ** 2 / (F.col("_n1") - n)
    best = c.where("_n < _n1").groupBy(*UNIT).agg(F.min(F.struct(F.round(cost, 9).alias("cost"), "_n", "value"))["value"].alias("_top"))
    # one row a unit, repeated so that no unit's peaks have to meet it in one task
    salt = F.pmod(F.floor(F.col("sample") / 65_536), F.lit(16)).alias("_salt")
    best = best.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    out = peaks.withColumn("_salt", salt).join(best, [*UNIT, "_salt"], "left").withColumn("high", F.coalesce(v > F.col("_top"), F.lit(True)))
    return out.select(*peaks.columns, "high")


def reject_high_peaks(spikes: DataFrame, rule: str = "deviation") -> DataFrame:
    """Drop spikes above mean + 3 population deviations (`deviation`) or above 3 times the mean (`centre`) of their unit."""
    w = W.partitionBy(*UNIT)
    top = F.avg("value").over(w) + 3 * F.stddev_pop("value").over(w) if rule == "deviation" else 3 * F.avg("value").over(w)
    return spikes.withColumn("_top", top).where("value <= _top").drop("_top")


def silhouette(peaks: DataFrame) -> DataFrame:
    """Score of the upper cluster against both centres; 0 with one peak."""
    s = two_means_split(peaks)
    w = W.partitionBy(*UNIT)
    c = s.withColumn("_hi", F.avg(F.when(F.col("high"), F.col("value"))).over(w)).withColumn("_lo", F.avg(F.when(~F.col("high"), F.col("value"))).over(w))
    up = c.where("high").groupBy(*UNIT).agg(F.sum((F.col("value") - F.col("_lo")) ** 2).alias("_l"), F.sum((F.col("value") - F.col("_hi")) ** 2).alias("_h"))
    return up.select(*UNIT, F.coalesce(F.try_divide(F.col("_l") - F.col("_h"), F.greatest("_l", "_h")), F.lit(0.0)).alias("sil"))


def inter_spike_intervals(spikes: DataFrame) -> DataFrame:
    return spikes.withColumn("isi", F.col("sample") - F.lag("sample").over(_by_sample())).where("isi is not null")


def isi_cov(spikes: DataFrame, default: float | None = None) -> DataFrame:
    """Population deviation over mean of the intervals of each unit; the default without intervals or with a mean of 0 or less."""
    isi = F.col("sample") - F.lag("sample").over(_by_sample())
    g = spikes.withColumn("isi", isi).groupBy(*UNIT).agg(F.count("*").alias("n_spikes"), F.stddev_pop("isi").alias("_s"), F.avg("isi").alias("_m"))
    return g.select(*UNIT, "n_spikes", F.coalesce(F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")), F.lit(default).cast("double")).alias("cov"))


def select_units(units: DataFrame, sil: float | None = None, cov: float | None = None) -> DataFrame:
    """Units with at least that silhouette and at most that variability, each test only if given."""
    if sil is not None:
        units = units.where(F.col("sil") >= sil)
    return units if cov is None else units.where(F.col("cov") <= cov)


def peaks_1d(v: np.ndarray, distance: int, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """Local maxima of one series (middle of flat tops) within the height band, highest first (the later on ties), `distance` apart."""
    if not len(v):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    last, level = np.append(first[1:], len(v)) - 1, v[first]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.array([], int)
    at = (first[top] + last[top]) // 2
    at = at[(v[at] >= low) & (v[at] <= high)]
    return at[apart(at, v[at], distance)]


def upper_cluster(v: np.ndarray) -> np.ndarray:
    """Flags of the upper cluster of the best two-means split of some heights (all, if they are equal); the rule of two_means_split."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    if len(s) < 2 or s[0] == s[-1]:
        return np.ones(len(v), bool)
    c, q, k = np.cumsum(s)[:-1], np.cumsum(s * s)[:-1], np.arange(1, len(s))
    total, squares = s.sum(), (s * s).sum()
    cost = np.round(q - c * c / k + squares - q - (total - c) ** 2 / (len(s) - k), 9)
    out = np.zeros(len(v), bool)
    out[order[int(cost.argmin()) + 1 :]] = True
    return out


def clustered(at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """Upper ones of some peaks (places, heights) without outliers (over mean + 3 deviations), and how well the two clusters are told apart."""
    if len(at) < 2:
        return at, 0.0
    up = upper_cluster(v)
    sil = 0.0
    if not up.all():
        high, low = ((v[up] - c) ** 2 for c in (v[up].mean(), v[~up].mean()))
        sil = float((low.sum() - high.sum()) / max(low.sum(), high.sum()))
    top = v[up]
    return at[up][top <= top.mean() + 3 * top.std()], sil


def variability(spikes: np.ndarray) -> float:
    isi = np.diff(spikes)
    return float(isi.std() / isi.mean())


def block_peaks(at: np.ndarray, v: np.ndarray, distance: int) -> dict[str, np.ndarray]:
    """What a block of a series tells of its peaks: maxima inside (at, value) that no certain one drops, and two runs of equal values (a, b, level) at each border; end: the outermost."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    last, level = np.append(first[1:], len(v)) - 1, v[first]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.array([], int)
    a, b = at[first], at[last]
    mid = (a[top] + b[top]) // 2
    # a peak outside, or one that goes on there, is nowhere before the end of the first run or after the start of the last one
    near = (mid - distance < b[0]) | (mid + distance > a[-1])
    left = settled(mid, level[top], np.where(near, UNKNOWN, OPEN), distance) != 0
    ends = np.unique(np.clip([0, 1, len(level) - 2, len(level) - 1], 0, len(level) - 1))
    return {"at": mid[left], "value": level[top][left], "a": a[ends], "b": b[ends], "level": level[ends], "end": (ends == 0) | (ends == len(level) - 1)}


def series_peaks(at: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray, level: np.ndarray, end: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Peaks (places, heights) of a series from what its blocks tell, in order; sizes: how many runs each block gives."""
    on = np.zeros(len(a), bool)
    on[np.cumsum(sizes)[:-1]] = True
    on[1:] &= level[1:] == level[:-1]
    head = np.flatnonzero(~on)
    a, b, level, end = a[head], b[np.append(head[1:], len(on)) - 1], level[head], np.logical_or.reduceat(end, head)
    top = np.flatnonzero(end[1:-1] & (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.array([], int)
    at, value = np.concatenate([at, (a[top] + b[top]) // 2]), np.concatenate([value, level[top]])
    order = at.argsort(kind="stable")
    at, value = at[order], value[order]
    keep = apart(at, value, distance)
    return at[keep], value[keep]


def shift_index_base(spikes: DataFrame, totals: DataFrame) -> DataFrame:
    """1-based places of a recording become 0-based, unless one of its places is 0; what lies outside the recording goes."""
    low = spikes.groupBy("recording_id").agg((F.min("sample") > 0).cast("long").alias("_base"))
    moved = spikes.join(low, "recording_id").join(totals, "recording_id").withColumn("sample", F.col("sample") - F.col("_base"))
    return moved.where("sample >= 0 and sample < total_samples").drop("_base", "total_samples").distinct()


def infer_total_samples(recordings: DataFrame, pulses: DataFrame, spikes: DataFrame) -> DataFrame:
    """(recording_id, total_samples): the length given, else that of the pulses, else the last spike's place + 1, else 0."""
    of = lambda df, name: df.groupBy("recording_id").agg((F.max("sample") + 1).alias(name))
    given = F.col("total_samples") if "total_samples" in recordings.columns else F.lit(None).cast("long")
    rows = recordings.select("recording_id", given.alias("_given")).distinct()
    rows = rows.join(of(pulses, "_pulses"), "recording_id", "left").join(of(spikes, "_spikes"), "recording_id", "left")
    return rows.select("recording_id", F.coalesce("_given", "_pulses", "_spikes", F.lit(0).cast("long")).alias("total_samples"))


def places(rows: DataFrame, block: int = 65_536) -> DataFrame:
    """Every row once for each `sample` of its `total_samples`, laid out block by block, so no array grows with a recording."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total_samples") - 1) / block)))
    cut = rows.where("total_samples > 0").withColumn("_b", blocks).withColumn("sample", F.explode(F.sequence(F.col("_b") * block, F.least(F.col("total_samples"), (F.col("_b") + 1) * block) - 1)))
    return cut.drop("_b", "total_samples")


def pulse_from_spikes(spikes: DataFrame, totals: DataFrame, block: int = 65_536) -> DataFrame:
    """Series of 0 and 1 over the whole recording for every unit that has spikes.

    Each spike lays out itself and the zeros up to the next one, at most a block in a
    row, and a unit's first one those before it, so only spikes are shuffled, once. Spikes outside stand at -1, before all others.
    """
    parts = int(spikes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = F.col("sample").between(0, F.col("total_samples") - 1)
    # few spikes make many samples: a number that is given keeps Spark from gathering them in one task
    at = spikes.select(*UNIT, "sample").join(totals, "recording_id").withColumn("sample", F.when(inside, F.col("sample")).otherwise(-1)).repartition(parts, *UNIT)
    after = F.lead("sample").over(_by_sample())
    # of equal spikes the last one goes on
    gaps = at.select(*UNIT, "sample", "total_samples", after.alias("_next"), F.min("sample").over(_by_sample()).alias("_first")).where("_next is null or _next <> sample")
    start = F.when(F.col("sample") == F.col("_first"), F.lit(0)).otherwise(F.col("sample"))
    gaps = gaps.select(*UNIT, "sample", start.cast("long").alias("_start"), F.coalesce("_next", "total_samples").alias("_end")).where("_end > _start")
    steps = gaps.withColumn("_from", F.explode(F.sequence("_start", F.col("_end") - 1, F.lit(block).cast("long"))))
    laid = steps.select(*UNIT, F.col("sample").alias("_at"), F.explode(F.sequence("_from", F.least(F.col("_from") + block, "_end") - 1)).alias("sample"))
    return laid.select(*UNIT, "sample", F.when(F.col("sample") == F.col("_at"), 1.0).otherwise(0.0).alias("value"))


def spikes_from_pulse(pulses: DataFrame) -> DataFrame:
    return pulses.where("value <> 0").select(*UNIT, "sample")


def spike_heights(spikes: DataFrame, pulses: DataFrame) -> DataFrame:
    """Pulse value at each spike, 0 where there is none."""
    return spikes.select(*UNIT, "sample").join(pulses, [*UNIT, "sample"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def unit_summary(units: DataFrame) -> DataFrame:
    """Per recording: number of units and their silhouettes in id order."""
    pairs = F.array_sort(F.collect_list(F.struct("unit_uid", "sil")))
    return units.groupBy("recording_id").agg(F.count("*").alias("n_units"), F.avg("sil").alias("mean_sil"), pairs.alias("_p")).withColumn("sils", F.col("_p.sil")).drop("_p")


def units_for_grid(units: DataFrame, grid: int) -> DataFrame:
    """Units of one grid; a recording without any mapping gives all of its units."""
    mapped = F.max(F.col("grid").isNotNull()).over(W.partitionBy("recording_id"))
    return units.withColumn("_mapped", mapped).where(~F.col("_mapped") | (F.col("grid") == grid)).drop("_mapped")


def expand_jitter(spikes: DataFrame, jitter: int, totals: DataFrame | None = None) -> DataFrame:
    """Spikes widened by `jitter` samples both ways, distinct, inside the recording."""
    wide = spikes.select(*UNIT, F.explode(F.sequence(F.col("sample") - jitter, F.col("sample") + jitter)).alias("sample")).where("sample >= 0")
    if totals is not None:
        wide = wide.join(totals, "recording_id").where("sample < total_samples").drop("total_samples")
    return wide.distinct()


def train_names(spikes: DataFrame, group: str = "recording_id", block: int = 1 << 18) -> DataFrame:
    """(group, unit_uid, _h, n_spikes, n_rows): trains that hold the same samples have the same `_h`; n_rows counts repeated samples too.

    Trains are told apart by SHA-256, block by block, so that no row grows with a whole train.
    """
    text = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ","), 256)
    cut = spikes.groupBy(group, "unit_uid", F.floor(F.col("sample") / block).alias("_b")).agg(F.collect_set("sample").alias("_s"), F.count("*").alias("_r"))
    cut = cut.select(group, "unit_uid", F.concat_ws(":", F.col("_b").cast("string"), text(F.col("_s"))).alias("_h"), F.size("_s").cast("long").alias("_n"), "_r")
    return cut.groupBy(group, "unit_uid").agg(text(F.collect_list("_h")).alias("_h"), F.sum("_n").alias("n_spikes"), F.sum("_r").alias("n_rows"))


def train_classes(spikes: DataFrame, group: str = "recording_id", block: int = 1 << 18) -> DataFrame:
    """(group, unit_uid, rep, top, copies, n_spikes): units of a group whose trains hold the same samples are a class, named by its smallest unit; top is its largest."""
    named = train_names(spikes, group, block)
    sets = named.groupBy(group, "_h").agg(F.min("unit_uid").alias("rep"), F.max("unit_uid").alias("top"), F.count("*").alias("copies"))
    return named.join(sets, [group, "_h"]).select(group, "unit_uid", "rep", "top", "copies", "n_spikes")


def lag_counts(left: np.ndarray, right: np.ndarray, reach: int, halo: int) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, counts of common places for each pair of rows) of bit trains; right has `halo` words more on both sides."""
    n = left.shape[1]
    for lag in range(-reach, reach + 1):
        word, bit = halo + lag // 64, np.uint64(lag % 64)
        moved = right[:, word : word + n]
        if bit:
            moved = (moved >> bit) | (right[:, word + 1 : word + n + 1] << (np.uint64(64) - bit))
        yield lag, np.stack([np.bitwise_count(row & moved).sum(1) for row in left])


#: Pairs of spikes that are laid out at once, and bit operations on words that cost as much as one of them.
PAIRS, WORDS_A_PAIR = 1 << 21, 16
#: Units of a tile, tiles that a group of fewer units is cut into, spikes of a tile, and units of a class of equal trains.
TILE, TILES, TILE_SPIKES, CLASS = 2048, 8, 1 << 22, 256


def _dense(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], shape: tuple[int, int], words: int, reach: int, halo: int) -> Iterator[tuple]:
    """(lag, pairs of rows as left * units + right, coincidences, pairs of neighbours) of trains (row, place, ...) as bits, all pairs of rows by shifts of words."""

    def bits(of: np.ndarray, at: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
        trains = np.zeros((units, words + 2 * halo), np.uint64)
        np.bitwise_or.at(trains, (of, (at >> 6) + halo), np.uint64(1) << (at & 63).astype(np.uint64))
        return trains, trains & ((trains >> np.uint64(1)) | np.pad(trains[:, 1:] << np.uint64(63), ((0, 0), (0, 1))))

    inner = slice(halo, halo + words)
    (a, two), (b, both) = bits(*left[:2], shape[0]), bits(*right[:2], shape[1])
    for (lag, n), (_, m) in zip(lag_counts(a[:, inner], b, reach, halo), lag_counts(two[:, inner], both, reach, halo), strict=True):
        code = np.flatnonzero(n)
        yield lag, code, n.ravel()[code].astype(np.int64), m.ravel()[code].astype(np.int64)


def _sparse(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], shape: tuple[int, int], span: int, reach: int) -> Iterator[tuple]:
    """The same of spikes (row, place, whether the next place is a spike too) sorted by place, by laying their pairs out."""
    row, at, two = (x[(left[1] >= 0) & (left[1] < span)] for x in left)
    cells = shape[0] * shape[1]
    for lag in range(-reach, reach + 1):
        lo, hi = np.searchsorted(right[1], at + lag, "left"), np.searchsorted(right[1], at + lag, "right")
        ends, cut, parts = np.cumsum(hi - lo), 0, []
        while cut < len(at):
            done = ends[cut - 1] if cut else 0
            stop = max(cut + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            n = (hi - lo)[cut:stop]
            a = np.repeat(np.arange(cut, stop), n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[cut:stop], n)
            code, near, cut = row[a] * shape[1] + right[0][b], two[a] & right[2][b], stop
            if len(code) * 8 > cells:
                counts = np.bincount(code, minlength=cells)
                of = np.flatnonzero(counts)
                parts.append((of, counts[of], np.bincount(code[near], minlength=cells)[of]))
            else:
                of, place = np.unique(code, return_inverse=True)
                parts.append((of, np.bincount(place, minlength=len(of)), np.bincount(place[near], minlength=len(of))))
        if len(parts) > 1:
            of, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            parts = [(of, *(np.bincount(place, weights=np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2)))]
        if parts:
            yield lag, *parts[0]


def _counted(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], shape: tuple[int, int], words: int, reach: int, halo: int) -> Iterator[tuple]:
    """(lag, pairs, coincidences, pairs of neighbours) for each lag once, the cheaper way; spikes are sorted by place."""
    at = left[1][(left[1] >= 0) & (left[1] < words * 64)]
    pairs = int((np.searchsorted(right[1], at + reach, "right") - np.searchsorted(right[1], at - reach, "left")).sum())
    wide = max(shape) * (words + 2 * halo) > 1 << 23
    if wide or pairs * WORDS_A_PAIR < shape[0] * shape[1] * words * (2 * reach + 1):
        return _sparse(left, right, shape, words * 64, reach)
    return _dense(left, right, shape, words, reach, halo)


def _best(found: Iterator[tuple], shape: tuple[int, int], keep) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Pairs, and of each: most coincidences `n`, their lowest and highest lag with its runs, and the runs without a lag."""
    cells = shape[0] * shape[1]
    out = {c: np.zeros(cells, np.int32) for c in ("n", "lag", "runs", "back", "back_runs", "runs_0")}
    for lag, code, n, both in found:
        code, n, both = keep(code, n, both)
        more = n > out["n"][code]
        last = n >= out["n"][code]
        for of, (where, runs) in ((more, ("lag", "runs")), (last, ("back", "back_runs"))):
            out[where][code[of]], out[runs][code[of]] = lag, (n - both)[of]
        out["n"][code[more]] = n[more]
        if lag == 0:
            out["runs_0"][code] = n - both
    code = np.flatnonzero(out["n"])
    return code, {c: v[code].astype(np.int64) for c, v in out.items()}


def _spread(code: np.ndarray, cols: dict[str, np.ndarray], sides: list[dict], rows: int = 1 << 19) -> Iterator[tuple]:
    """(units, larger units, columns) of pairs of classes, a bounded number of rows at a time: all pairs of their units, turned round where the left one is the larger."""
    left, right = code // len(sides[1]["name"]), code % len(sides[1]["name"])
    number = sides[0]["size"][left] * sides[1]["size"][right]
    ends, cut = np.cumsum(number), 0
    while cut < len(code):
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + rows, "right")))
        n, own = number[cut:stop], slice(cut, stop)
        of = np.repeat(np.arange(cut, stop), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = sides[1]["size"][right[of]]
        u, v = (s["members"][s["first"][x[of]] + place] for s, x, place in ((sides[0], left, k // wide), (sides[1], right, k % wide)))
        same = sides[0]["name"][left[own]] == sides[1]["name"][right[own]]
        stay = (u < v) | ((u > v) & ~np.repeat(same, n))
        u, v, of, cut = u[stay], v[stay], of[stay], stop
        turned = u > v
        got = {c: x[of] for c, x in cols.items()}
        if "back" in got:
            for c, other in (("lag", "back"), ("runs", "back_runs"), ("n_u", "n_v")):
                got[c], got[other] = np.where(turned, got[other], got[c]), np.where(turned, got[c], got[other])
            got["back"] = np.where(turned, -got["back"], got["back"])
        got["lag"] = np.where(turned, -got["lag"], got["lag"])
        yield np.where(turned, v, u), np.where(turned, u, v), got


def lag_overlap(spikes: DataFrame, maxlag: int, group: str = "recording_id", words: int = 1 << 18, own: bool = False, best: bool = False, copies: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """Coincidences `n` of each pair of units of a group (u < v, with `own` also u = v) at each lag of at most 2 * maxlag; spikes count once. `runs` counts coincidences at consecutive samples once.

    With `best` one row a pair: most coincidences `n`, the lowest lag that has them and its `runs`, the highest (`back`,
    `back_runs`), `runs_0` without a lag, and the rows of both units (`n_u`, `n_v`), or what sizes (group, unit_uid, n) says of them. With `copies` units of equal trains
    are compared once, and the rows are laid out again for all pairs of units.

    Units of a group are cut into tiles, in the order of their names, and a pair of tiles in a stretch of
    `words` times 64 samples (with what lags can reach around it) is one task's work: either all lags are shifts of
    bit trains and coincidences counts of common bits, or, where trains are sparse, pairs of spikes are laid
    out, some millions at a time. Spikes are shuffled once for each tile of their group; pairs are
    not shuffled, as long as all spikes lie in one stretch; else the stretches of a pair are added up.
    A run starts where the coincidence before it is missing, so runs are the
    coincidences without those of trains of neighbours (samples whose next one is a spike too).
    """
    reach, span = 2 * maxlag, words * 64
    halo = -(-(reach + 1) // 64) + 1
    kinds = {f.name: f.dataType.simpleString() for f in spikes.schema}
    uid, parts = kinds["unit_uid"], int(spikes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("sample").cast("long")
    near = F.explode(F.sequence(F.floor((at - reach - 1) / span), F.floor((at + reach + 1) / span))).alias("_seg")
    cut = spikes.select(group, "unit_uid", at.alias("sample"), near)
    inside = F.floor(F.col("sample") / span) == F.col("_seg")
    offset = (F.col("sample") - F.col("_seg") * span).cast("int")
    packed = stored(cut.groupBy(group, "unit_uid", "_seg").agg(F.sort_array(F.collect_set(offset)).alias("_at"), F.count_if(inside).alias("_rows")))
    stretches = [r[0] for r in packed.where("_rows > 0").select("_seg").distinct().limit(2).collect()]
    whole = len(stretches) < 2
    packed = packed.where(F.col("_seg").isin(stretches)) if whole else packed
    # one row a unit, then one a class with the units it stands for
    train = F.struct("_seg", F.sha2(F.array_join(F.transform("_at", lambda x: x.cast("string")), ","), 256).alias("h"))
    named = packed.groupBy(group, "unit_uid").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(train))), 256).alias("_h"), F.sum("_rows").alias("_n"), F.sum(F.size("_at")).alias("_k")) if copies else packed.groupBy(group, "unit_uid").agg(F.sum("_rows").alias("_n"), F.sum(F.size("_at")).alias("_k"))
    if sizes is not None:
        named = named.drop("_n").join(sizes.select(group, "unit_uid", F.col("n").alias("_n")), [group, "unit_uid"])
    if copies:
        kind = [group, "_h", "_n", "_k"]
        numbered = named.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(*kind).orderBy("unit_uid")) - 1) / CLASS))
        named = numbered.groupBy(*kind, "_part").agg(F.min("unit_uid").alias("unit_uid"), F.array_sort(F.collect_list("unit_uid")).alias("_members"))
    else:
        named = named.withColumn("_members", F.lit(None).cast(f"array<{uid}>"))
    order, all_ = W.partitionBy(group).orderBy("unit_uid"), W.partitionBy(group)
    width = F.least(F.lit(TILE), F.greatest(F.lit(64), F.ceil(F.count("*").over(all_) / TILES)))
    tile = F.greatest(F.floor((F.row_number().over(order) - 1) / width), F.floor(F.sum("_k").over(order) / TILE_SPIKES)).cast("int")
    named = named.withColumn("_tile", tile).withColumn("_last", F.max("_tile").over(all_))
    other = F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_other")
    dealt = packed.drop("_rows").join(named.select(group, "unit_uid", "_n", "_members", "_tile", "_last"), [group, "unit_uid"])
    dealt = dealt.select(group, "unit_uid", "_seg", "_at", "_n", "_members", "_tile", other).select("*", F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j")).drop("_other")
    keys = [group, "_i", "_j", "_seg"]

    def side(pdf: pd.DataFrame) -> dict:
        """Units of a tile, and their spikes in order (row, place, whether the next place is a spike too)."""
        trains = [np.asarray(x, np.int64) for x in pdf["_at"]]
        size = np.array([len(x) for x in trains], np.int64)
        row, place = np.repeat(np.arange(len(trains)), size), np.concatenate(trains)
        two = np.append((row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1), False)
        order_ = np.argsort(place, kind="stable")
        out = {"name": pdf["unit_uid"].to_numpy(), "n": pdf["_n"].to_numpy(), "spikes": (row[order_], place[order_], two[order_])}
        if copies:
            sets = [np.asarray(x) for x in pdf["_members"]]
            sizes = np.array([len(x) for x in sets], np.int64)
            out |= {"members": np.concatenate(sets), "size": sizes, "first": np.cumsum(sizes) - sizes}
        return out

    def count(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("unit_uid")
        i, j = key[1], key[2]
        tiles = [pdf[pdf["_tile"] == t] for t in (i, j)]
        if not len(tiles[0]) or not len(tiles[1]):
            return
        sides = [side(t) for t in tiles]
        if i == j:
            sides[1] = sides[0]
        shape = len(tiles[0]), len(tiles[1])

        def keep(code: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, ...]:
            if i != j:
                return code, *cols
            later = code % shape[1] >= code // shape[1] + (not own and not copies)
            return code[later], *(c[later] for c in cols)

        def rows(code: np.ndarray, cols: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
            if best and whole:
                cols |= {"n_u": sides[0]["n"][code // shape[1]], "n_v": sides[1]["n"][code % shape[1]]}
            step = 1 << 19
            made = _spread(code, cols, sides) if copies else ((sides[0]["name"][code[k : k + step] // shape[1]], sides[1]["name"][code[k : k + step] % shape[1]], {c: v[k : k + step] for c, v in cols.items()}) for k in range(0, len(code), step))
            for u, v, got in made:
                yield pd.DataFrame({group: np.full(len(u), key[0], object), "u": u, "v": v} | got)

        found = _counted(sides[0]["spikes"], sides[1]["spikes"], shape, words, reach, halo)
        if best and whole:
            yield from rows(*_best(found, shape, keep))
        else:
            for lag, code, n, both in found:
                code, n, both = keep(code, n, both)
                yield from rows(code, {"lag": np.full(len(code), lag), "n": n, "runs": n - both})

    schema = f"{group} {kinds[group]}, u {uid}, v {uid}, " + ("n long, lag long, runs long, back long, back_runs long, runs_0 long, n_u long, n_v long" if best and whole else "lag long, n long, runs long")
    # few rows make much work: a number that is given keeps Spark from gathering them in one task
    part = dealt.repartition(parts, *keys).groupBy(*keys).applyInPandas(count, schema)
    if whole:
        return part
    part = part.groupBy(group, "u", "v", "lag").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"))
    if not best:
        return part
    n, lag = F.col("n"), F.col("lag")
    zero = F.coalesce(F.max(F.when(lag == 0, F.col("runs"))), F.lit(0).cast("long")).alias("runs_0")
    top = part.groupBy(group, "u", "v").agg(F.max(F.struct("n", (-lag).alias("_lag"), "runs")).alias("_a"), F.max(F.struct("n", "lag", F.col("runs"))).alias("_b"), zero)
    given = packed.groupBy(group, "unit_uid").agg(F.sum("_rows").alias("n")) if sizes is None else sizes
    size = lambda c: given.select(group, F.col("unit_uid").alias(c), F.col("n").alias(f"n_{c}"))
    top = top.join(size("u"), [group, "u"]).join(size("v"), [group, "v"])
    return top.select(group, "u", "v", "_a.n", (-F.col("_a._lag")).alias("lag"), "_a.runs", F.col("_b.lag").alias("back"), F.col("_b.runs").alias("back_runs"), "runs_0", "n_u", "n_v")


def class_overlap(spikes: DataFrame, classes: DataFrame, maxlag: int, group: str = "recording_id") -> DataFrame:
    """lag_overlap of classes of equal trains (train_classes), each seen once: u and v name classes.

    A pair stands for all pairs of a unit of u and a larger unit of v, so there
    are both (u, v) and (v, u) where both kinds of pairs exist, and (u, u) where u has copies.
    """
    first = classes.where("unit_uid = rep").select(group, F.col("rep").alias("unit_uid"), "top")
    found = lag_overlap(spikes.join(first, [group, "unit_uid"], "left_semi"), maxlag, group, own=True)
    top = lambda x: first.select(group, F.col("unit_uid").alias(x), F.col("top").alias(f"_{x}"))
    both = found.join(top("u"), [group, "u"]).join(top("v"), [group, "v"])
    row = lambda u, v, lag: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), lag.alias("lag"))
    ways = F.array(F.when(F.col("u") < F.col("_v"), row("u", "v", F.col("lag"))), F.when((F.col("u") < F.col("v")) & (F.col("v") < F.col("_u")), row("v", "u", -F.col("lag"))))
    return both.select(group, F.explode(F.array_compact(ways)).alias("w"), "n", "runs").select(group, "w.*", "n", "runs")


def best_lags(overlaps: DataFrame, spikes: DataFrame | None = None, group: str = "recording_id") -> DataFrame:
    """The lag of most coincidences (the lowest on ties) of each pair, with its share n / sqrt(n_u * n_v), its runs and those without a shift.

    overlaps of lag_overlap with `best` have one row a pair, and no pair is shuffled here; others meet by pair, and with the spikes.
    """
    share = lambda n: (n / F.sqrt(F.col("n_u").cast("double") * F.col("n_v"))).alias("share")
    if "n_u" in overlaps.columns:
        return overlaps.select(group, "u", "v", "lag", share(F.col("n")), "n_u", "n_v", "runs", "runs_0")
    n = spikes.groupBy(group, "unit_uid").agg(F.count("*").alias("n_spikes"))
    best = overlaps.groupBy(group, "u", "v").agg(F.max(F.struct("n", (-F.col("lag")).alias("neg"), "runs")).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("runs"))).alias("_0"))
    size = lambda x: n.select(group, F.col("unit_uid").alias(x), F.col("n_spikes").alias(f"n_{x}"))
    out = best.join(size("u"), [group, "u"]).join(size("v"), [group, "v"])
    return out.select(group, "u", "v", (-F.col("b.neg")).alias("lag"), share(F.col("b.n")), "n_u", "n_v", F.col("b.runs").alias("runs"), F.coalesce("_0", F.lit(0).cast("long")).alias("runs_0"))


def duplicate_score(lags: DataFrame) -> DataFrame:
    """Coincidences at the chosen lag, runs of consecutive samples once, over the larger spike count."""
    return lags.withColumn("score", F.col("runs") / F.greatest("n_u", "n_v"))


def class_scores(best: DataFrame, classes: DataFrame, tol: float, group: str = "recording_id") -> DataFrame:
    """(group, u, v, score) of classes of equal trains, as class_overlap pairs them, from the best lags (lag_overlap with `own`) of their first units; pairs that reach tol neither way are left out."""
    most = F.greatest("n_u", "n_v")
    both = stored(best.select(group, "u", "v", (F.col("runs") / most).alias("there"), (F.col("back_runs") / most).alias("back")).where((F.col("there") >= tol) | (F.col("back") >= tol)))
    top = lambda x: classes.where("unit_uid = rep").select(group, F.col("rep").alias(x), F.col("top").alias(f"_{x}"))
    row = lambda a, b, s: F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.col(s).alias("score"))
    ways = F.array(F.when(F.col("u") < F.col("_v"), row("u", "v", "there")), F.when((F.col("u") < F.col("v")) & (F.col("v") < F.col("_u")), row("v", "u", "back")))
    return both.join(top("u"), [group, "u"]).join(top("v"), [group, "v"]).select(group, F.explode(F.array_compact(ways)).alias("w")).select(group, "w.*")


def _led(units: DataFrame, near: DataFrame, group: str) -> DataFrame:
    """units with `_at`, their place in the order, and `_lead`, the place of the unit that takes them: all groups go in rounds."""
    rows = stored(units.withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy("ord", "unit_uid"))))
    at = lambda c: rows.select(group, F.col("unit_uid").alias(c), F.col("_at").alias(f"_{c}"))
    near = near.select(group, "u", "v").where("u <> v").join(at("u"), [group, "u"]).join(at("v"), [group, "v"])
    first = F.col("_u") < F.col("_v")
    pairs = stored(near.select(group, F.when(first, F.col("_u")).otherwise(F.col("_v")).alias("a"), F.when(first, F.col("_v")).otherwise(F.col("_u")).alias("b")).distinct())

    def leading(left: DataFrame) -> DataFrame:
        """Pairs, with whether their first unit has no earlier neighbour left; one table a round."""
        held = left.select(group, F.col("b").alias("a")).distinct().withColumn("_held", F.lit(True))
        return stored(left.join(held, [group, "a"], "left").select(group, "a", "b", F.col("_held").isNull().alias("leads")))

    left, taken = leading(pairs), None
    while not left.isEmpty():
        led = left.where("leads")
        new = led.select(group, "b").distinct()
        taken = new if taken is None else taken.union(new)
        gone = led.select(group, "a").union(new).distinct()
        left = leading(left.select(group, "a", "b").join(gone, [group, "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), [group, "b"], "left_anti"))
    if taken is None:
        return rows.withColumn("_lead", F.col("_at"))
    own = pairs.join(taken.select(group, F.col("b").alias("a")), [group, "a"], "left_anti").join(taken, [group, "b"]).groupBy(group, F.col("b").alias("_at")).agg(F.min("a").alias("_lead"))
    return rows.join(own, [group, "_at"], "left").withColumn("_lead", F.coalesce("_lead", "_at"))


def dedup_units(units: DataFrame, scores: DataFrame, tol: float = 0.3, group: str = "recording_id", classes: DataFrame | None = None) -> DataFrame:
    """Keep one unit of each group of duplicates: in unit order a leader takes all later active units that score >= tol against it; the lowest variability (first on ties) stays.

    units has group, unit_uid, ord and cov, only of units with spikes; order is by
    ord, then unit_uid. All groups go in rounds: a unit leads when none of its
    earlier neighbours is left, what it takes leaves, and so on. A taken unit belongs to the
    first leader among its earlier neighbours.

    With classes of equal trains (train_classes), scores are those of classes, as
    class_overlap pairs them. A class goes to one leader as a whole, in the place of its
    first unit, if its units are duplicates of each other and of other classes whichever
    unit is the larger one; the units of any other class are taken one by one.
    """
    near = scores.where(F.col("score") >= tol).select(group, "u", "v")
    if classes is None:
        led = _led(units, near, group)
    else:
        near = stored(near)
        far = scores.where(F.col("score") < tol).select(group, F.col("v").alias("u"), F.col("u").alias("v"))
        mixed = near.where("u <> v").join(far, [group, "u", "v"], "left_semi")
        lone = classes.where("copies > 1 and unit_uid = rep").select(group, "rep").join(near.where("u = v").select(group, F.col("u").alias("rep")), [group, "rep"], "left_anti")
        single = lone.union(mixed.select(group, "u")).union(mixed.select(group, "v")).distinct().withColumn("_single", F.lit(True))
        node = F.when(F.col("_single"), F.col("unit_uid")).otherwise(F.col("rep"))
        rows = units.join(classes.select(group, "unit_uid", "rep"), [group, "unit_uid"]).join(single, [group, "rep"], "left").withColumn("_single", F.coalesce("_single", F.lit(False))).withColumn("_node", node)
        nodes = stored(rows.groupBy(group, "rep", "_node", "_single").agg(F.min(F.struct("ord", "unit_uid")).alias("ord")))
        end = lambda x: nodes.select(group, F.col("rep").alias(x), F.col("_node").alias(f"_{x}"), F.col("_single").alias(f"_s{x}"))
        pairs = near.join(end("u"), [group, "u"]).join(end("v"), [group, "v"]).where("_u <> _v and (not _su or not _sv or _u < _v)")
        heads = _led(nodes.select(group, F.col("_node").alias("unit_uid"), "ord"), pairs.select(group, F.col("_u").alias("u"), F.col("_v").alias("v")), group)
        led = rows.withColumn("_at", F.struct("ord", "unit_uid")).join(heads.select(group, F.col("unit_uid").alias("_node"), "_lead"), [group, "_node"])
    best = led.groupBy(group, "_lead").agg(F.min(F.struct(F.coalesce("cov", F.lit(float("inf"))).alias("cov"), "_at"))["_at"].alias("_at"))
    return led.join(best.select(group, "_at"), [group, "_at"], "left_semi").select(units.columns)


def dedup_by_grid(units: DataFrame, spikes: DataFrame, fsamp: float, tol: float = 0.3, across: bool = False, totals: DataFrame | None = None, over: str = "grid") -> DataFrame:
    """Duplicates removed within each grid, and then over all grids of a recording if asked for; with over="recording" over all at once.

    totals (recording_id, total_samples) cuts widened spikes at the end of the
    recording. Pairs whose best share is at most 0.2 are scored without a shift.
    Units with equal trains are compared with others once, and once for all grids
    of a recording where that is less work.
    """
    jitter, maxlag = round(0.00025 * fsamp), round(fsamp / 40)
    # each of them is read many times
    spikes, units = stored(spikes.select(*UNIT, "sample")), stored(units)
    totals = None if totals is None else stored(totals.select("recording_id", "total_samples"))
    trains = stored(train_names(spikes).select(*UNIT, F.concat_ws(":", "_h", F.col("n_rows").cast("string")).alias("train"), "n_rows"))

    def scored(at: DataFrame, key: str) -> DataFrame:
        """(recording_id, key, x, y, there, back): scores of trains x and y of a key, if one reaches tol: of a unit with x and a larger one with y, and the other way round."""
        names = stored(at.groupBy("recording_id", F.col(key).alias("_key"), "train", "n_rows").agg(F.min("unit_uid").alias("unit_uid")))
        own = spikes.join(names, list(UNIT))
        # lag_overlap counts a place once
        wide = own.select(*UNIT, "_key", F.explode(F.sequence(F.col("sample") - jitter, F.col("sample") + jitter)).alias("sample")).where("sample >= 0")
        wide = wide if totals is None else wide.join(totals, "recording_id").where("sample < total_samples")
        best = lag_overlap(wide.select("_key", "unit_uid", "sample"), maxlag, "_key", own=True, best=True, sizes=names.select("_key", "unit_uid", F.col("n_rows").alias("n")))
        share = F.col("n") / F.sqrt(F.col("n_u").cast("double") * F.col("n_v"))
        score = lambda runs: F.when(share > 0.2, F.col(runs)).otherwise(F.col("runs_0")) / F.greatest("n_u", "n_v")
        near = stored(best.select("_key", "u", "v", score("runs").alias("there"), score("back_runs").alias("back")).where((F.col("there") >= tol) | (F.col("back") >= tol)))
        of = lambda c, t: names.select("recording_id", "_key", F.col("unit_uid").alias(c), F.col("train").alias(t))
        return stored(near.join(of("u", "x"), ["_key", "u"]).join(of("v", "y"), ["recording_id", "_key", "v"]).select("recording_id", "_key", "x", "y", "there", "back"))

    def once(u: DataFrame, keys: list[str], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """The units that stay, and the scores of all trains of a recording, if it was these that were found."""
        named = u.withColumn("_group", F.concat_ws("/", *keys))
        at = named.select(*UNIT, "_group").join(trains, list(UNIT))
        kind = ["recording_id", "_group", "train"]
        sets = at.groupBy(*kind).agg(F.min("unit_uid").alias("rep"), F.max("unit_uid").alias("top"), F.count("*").alias("copies"))
        classes = stored(at.join(sets, kind))
        if known is None:
            # a train of many grids is compared once for its recording, unless that is more pairs than grid by grid
            cost = lambda *k: classes.groupBy(*k).agg(F.count_distinct("train").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("n")).first().n or 0.0
            whole = keys == ["recording_id"] or cost("recording_id") <= cost("recording_id", "_group")
            pairs = scored(classes, "recording_id" if whole else "_group")
        else:
            whole, pairs = True, known
        first = classes.where("unit_uid = rep").withColumn("_key", F.col("recording_id" if whole else "_group"))
        end = lambda t, c: first.select("recording_id", "_key", "_group", F.col("train").alias(t), F.col("rep").alias(c), F.col("top").alias(f"_{c}"))
        both = pairs.join(end("x", "u"), ["recording_id", "_key", "x"]).join(end("y", "v"), ["recording_id", "_key", "_group", "y"])
        row = lambda a, b, s: F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.col(s).alias("score"))
        # pairs of trains as class_overlap pairs classes, by the units that a group has of each
        ways = F.array(F.when(F.col("u") < F.col("_v"), row("u", "v", "there")), F.when((F.col("x") != F.col("y")) & (F.col("v") < F.col("_u")), row("v", "u", "back")))
        scores = stored(both.select("_group", F.explode(F.array_compact(ways)).alias("w")).select("_group", "w.*"))
        return stored(dedup_units(named, scores, tol, "_group", classes).drop("_group")), pairs if whole else None

    out, known = once(units, ["recording_id"] if over == "recording" else ["recording_id", "grid"])
    return once(out, ["recording_id"], known)[0] if across else out


def discharge_rate(spikes: DataFrame, fsamp: float) -> DataFrame:
    """Rate fsamp / interval at the rounded middle of each interval; intervals of 0 or less are left out."""
    isi = F.lead("sample").over(_by_sample()) - F.col("sample")
    return spikes.withColumn("isi", isi).where("isi > 0").select(*UNIT, F.rint(F.col("sample") + F.col("isi") / 2).cast("long").alias("at"), (F.lit(fsamp) / F.col("isi")).alias("rate"))
