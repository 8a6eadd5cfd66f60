"""Batches of edits on spike trains, with their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.operators.units import UNIT, dedup_by_grid, find_peaks, isi_cov, pulse_from_spikes, spike_heights, stored

def _by_sample():
    return W.partitionBy(*UNIT).orderBy("sample")


def add_spikes_in_roi(pulses: DataFrame, spikes: DataFrame, rois: DataFrame, distance: int) -> DataFrame:
    """Existing spikes and the peaks of at least y_min inside each unit's range (values outside count as 0); sorted out as a set."""
    r = rois.select(*UNIT, "x_start", "x_end", "y_min")
    masked = pulses.join(r, list(UNIT)).withColumn("value", F.when(F.col("sample").between(F.col("x_start"), F.col("x_end")), F.col("value")).otherwise(0.0))
    peaks = find_peaks(masked.select(*UNIT, "sample", "value"), distance).join(r, list(UNIT)).where("value >= y_min and sample between x_start and x_end")
    return spikes.select(*UNIT, "sample").union(peaks.select(*UNIT, "sample")).distinct()


def delete_spikes_in_roi(spikes: DataFrame, pulses: DataFrame, rois: DataFrame) -> DataFrame:
    """Spikes without those in a range whose pulse (0 if missing) is from y_min to y_max + 1."""
    r = rois.select(*UNIT, "x_start", "x_end", F.least("y_min", "y_max").alias("_lo"), F.greatest("y_min", "y_max").alias("_hi"))
    gone = spike_heights(spikes, pulses).join(r, list(UNIT)).where("sample between x_start and x_end and value between _lo and _hi + 1")
    return spikes.join(gone.select(*UNIT, "sample").distinct(), [*UNIT, "sample"], "left_anti")


def add_artifacts_in_roi(pulses: DataFrame, artifacts: DataFrame, rois: DataFrame, distance: int) -> DataFrame:
    """Artifacts are marked as spikes are (see add_spikes_in_roi)."""
    return add_spikes_in_roi(pulses, artifacts, rois, distance)


def delete_artifacts_in_roi(artifacts: DataFrame, pulses: DataFrame, rois: DataFrame) -> DataFrame:
    """Artifacts without those in a range (see delete_spikes_in_roi), each once; places before the start go too."""
    return delete_spikes_in_roi(artifacts, pulses, rois).where("sample >= 0").select(*UNIT, "sample").distinct()


def _weaker_of_pairs(spikes: DataFrame, pulses: DataFrame) -> tuple[DataFrame, Column]:
    """Consecutive pairs, and the column that names the lower spike of each (the right one on ties)."""
    h = spike_heights(spikes, pulses)
    p = h.withColumn("_right", F.lead("sample").over(_by_sample())).withColumn("_rv", F.lead("value").over(_by_sample())).where("_right is not null").withColumn("_isi", F.col("_right") - F.col("sample"))
    return p, F.when(F.col("value") < F.col("_rv"), F.col("sample")).otherwise(F.col("_right"))


def delete_high_rate_in_roi(spikes: DataFrame, pulses: DataFrame, rois: DataFrame, fsamp: float) -> DataFrame:
    """Of consecutive spikes whose middle is in a range and whose rate exceeds y, the lower goes; all is decided on the original list."""
    p, lower = _weaker_of_pairs(spikes, pulses)
    middle = F.col("_right") - F.floor(F.col("_isi") / 2)
    hit = p.join(rois.select(*UNIT, "x_start", "x_end", "y_min"), list(UNIT)).where((middle >= F.col("x_start")) & (middle <= F.col("x_end")) & (F.col("_isi") > 0) & (F.lit(fsamp) / F.col("_isi") > F.col("y_min")))
    return spikes.join(hit.select(*UNIT, lower.alias("sample")).distinct(), [*UNIT, "sample"], "left_anti")


def remove_rate_outliers(spikes: DataFrame, pulses: DataFrame, fsamp: float, z: float = 3.0) -> DataFrame:
    """Of pairs with a rate over mean + z population deviations of their unit, the lower spike goes; units under 3 spikes stay."""
    p, lower = _weaker_of_pairs(spikes, pulses)
    w = W.partitionBy(*UNIT)
    rate = p.where("_isi > 0").withColumn("_rate", F.lit(fsamp) / F.col("_isi"))
    hit = rate.withColumn("_top", F.avg("_rate").over(w) + z * F.stddev_pop("_rate").over(w)).withColumn("_n", F.count("*").over(w)).where("_rate > _top and _n >= 2")
    return spikes.join(hit.select(*UNIT, lower.alias("sample")).distinct(), [*UNIT, "sample"], "left_anti")


def lock_spikes(spikes: DataFrame, peaks: DataFrame, radius: int = 10) -> DataFrame:
    """Each spike moves to the nearest peak within the radius (the first on ties), else stays; distinct."""
    width = max(1, radius)
    own = F.floor(F.col("sample") / width)
    left = spikes.select(*UNIT, "sample", F.explode(F.array(own - 1, own, own + 1)).alias("_b"))
    right = peaks.select(*UNIT, F.col("sample").alias("_peak"), own.alias("_b"))
    far = F.abs(F.col("_peak") - F.col("sample"))
    best = left.join(right, [*UNIT, "_b"]).where(far <= radius).groupBy(*UNIT, "sample").agg(F.min(F.struct(far.alias("d"), "_peak")).alias("b"))
    return spikes.select(*UNIT, "sample").join(best, [*UNIT, "sample"], "left").select(*UNIT, F.coalesce("b._peak", "sample").alias("sample")).distinct()


def splice_pulse(pulses: DataFrame, patch: DataFrame, start: int, end: int, edge: int) -> DataFrame:
    """Values of the patch for start + edge <= sample < end - edge, the old ones elsewhere."""
    new = patch.where((F.col("sample") >= start + edge) & (F.col("sample") < end - edge)).select(*UNIT, "sample", F.col("value").alias("_new"))
    return pulses.join(new, [*UNIT, "sample"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def flag_units(units: DataFrame, events: DataFrame) -> DataFrame:
    """Deletion mark of each unit by its last event; any other edit than a flag clears it."""
    last = events.groupBy(*UNIT).agg(F.max_by(F.when(F.col("type") == "flag_mu", F.col("flagged")).otherwise(F.lit(False)), "seq").alias("_f"))
    return units.join(last, list(UNIT), "left").withColumn("flagged", F.coalesce("_f", F.lit(False))).drop("_f")


def duplicate_unit(spikes: DataFrame, uid: str, new_uid: str) -> DataFrame:
    """All spikes, and a unit's once more under a new id."""
    return spikes.union(spikes.where(F.col("unit_uid") == uid).withColumn("unit_uid", F.lit(new_uid)))


def spike_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and removed spikes: one full outer join, `change` tells which."""
    b = before.select(*UNIT, "sample").distinct().withColumn("_b", F.lit(True))
    a = after.select(*UNIT, "sample").distinct().withColumn("_a", F.lit(True))
    return b.join(a, [*UNIT, "sample"], "full").where("_a is null or _b is null").select(*UNIT, "sample", F.when(F.col("_b").isNull(), "added").otherwise("removed").alias("change"))


def edit_history_entries(diff: DataFrame, action: str) -> DataFrame:
    """A log row per changed unit; a list is null when nothing was added or removed."""
    of = lambda c: F.array_sort(F.collect_list(F.when(F.col("change") == c, F.col("sample"))))
    e = diff.groupBy(*UNIT).agg(of("added").alias("added"), of("removed").alias("removed"))
    return e.select(*UNIT, F.lit(action).alias("type"), *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("added", "removed")))


def append_edit_log(log: DataFrame, entries: DataFrame) -> DataFrame:
    return log.unionByName(entries, allowMissingColumns=True)


def last_edit_per_unit(log: DataFrame, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """The latest log row of each unit."""
    cols = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*cols), "seq").alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in cols))


def undo_last(log: DataFrame, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """The log without the last row of each unit."""
    last = log.groupBy(*keys).agg(F.max("seq").alias("seq"))
    return log.join(last, [*keys, "seq"], "left_anti")


def reset_units(log: DataFrame, uids: DataFrame, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """The log without any row of the given units."""
    return log.join(uids, list(keys), "left_anti")


def dirty_units(current: DataFrame, original: DataFrame) -> DataFrame:
    return spike_diff(original, current).select(*UNIT).distinct()


def save_edits(units: DataFrame, spikes: DataFrame, pulses: DataFrame, totals: DataFrame, fsamp: float, tol: float = 0.3, remove_flagged: bool = True, remove_duplicates: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, spikes, pulses) as they are to be saved.

    Flagged units go, then duplicates over all grids of a recording (of each
    group the unit with the most even intervals stays). A unit whose pulse is
    missing or not as long as its recording gets one of its spikes.
    """
    kept = units.where(~F.coalesce("flagged", F.lit(False))) if remove_flagged else units
    rows = spikes.where("sample >= 0").select(*UNIT, "sample").distinct()
    if remove_duplicates:
        scored = kept.join(isi_cov(rows.join(kept.select(*UNIT), list(UNIT), "left_semi"), 100.0).select(*UNIT, "cov"), list(UNIT), "left").withColumn("cov", F.coalesce("cov", F.lit(100.0)))
        scored = scored if "ord" in kept.columns else scored.withColumn("ord", F.col("unit_uid"))
        silent = scored.join(rows.select(*UNIT).distinct(), list(UNIT), "left_anti")
        unique = dedup_by_grid(scored.join(silent.select(*UNIT), list(UNIT), "left_anti"), rows, fsamp, tol, totals=totals, over="recording")
        kept = unique.select(*kept.columns)
    rows = stored(rows.join(kept.select(*UNIT), list(UNIT), "left_semi"))
    shape = pulses.groupBy(*UNIT).agg(F.count_distinct("sample").alias("_n"), F.max("sample").alias("_last"), F.min("sample").alias("_first"))
    whole = shape.join(totals, "recording_id").where("_n = total_samples and _first = 0 and _last = total_samples - 1").select(*UNIT)
    own = pulses.join(whole.join(kept.select(*UNIT), list(UNIT)), list(UNIT), "left_semi").select(*UNIT, "sample", "value")
    built = pulse_from_spikes(rows.join(whole, list(UNIT), "left_anti"), totals)
    return kept, rows, own.union(built)
