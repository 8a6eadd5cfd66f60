"""Conditioning, quality control and geometry of sample tables (recording_id, grid, channel, sample, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.operators.series import BLOCK, CELLS, advance, filtered, notched
from spikeloom.operators.units import places, stored

CHANNEL = ("recording_id", "grid", "channel")


def read_grid_window(samples: DataFrame, recording: str, grid: int, start: int, n: int | None = None) -> DataFrame:
    """One grid over one range of samples; the filters reach the scan."""
    keep = (F.col("recording_id") == recording) & (F.col("grid") == grid) & (F.col("sample") >= start)
    return samples.where(keep if n is None else keep & (F.col("sample") < start + n))


def scale_adc_counts(raw: DataFrame, tracks: DataFrame) -> DataFrame:
    """Counts to mV by each channel's range, bits and gain; a gain that is null or 0 counts as 1. tracks is one row per channel of a device."""
    gain = F.coalesce(F.nullif(F.col("gain").try_cast("double"), F.lit(0.0)), F.lit(1.0))
    return raw.join(tracks, "channel").withColumn("value", F.col("value") * F.col("range") / F.pow(F.lit(2.0), F.col("bits")) * 1000 / gain)


def sanitize_values(samples: DataFrame) -> DataFrame:
    """NaN to 0, infinities to the largest finite doubles."""
    v, top = F.col("value"), float(np.finfo(np.float64).max)
    return samples.withColumn("value", F.when(F.isnan(v), 0.0).when(v == float("inf"), top).when(v == float("-inf"), -top).otherwise(v))


def align_lengths(samples: DataFrame, lengths: DataFrame) -> DataFrame:
    """Channels cut, or padded with zeros, to `length` samples of their recording."""
    channels = samples.select(*CHANNEL).distinct().join(lengths.withColumnRenamed("length", "total_samples"), "recording_id")
    return places(channels).join(samples, [*CHANNEL, "sample"], "left").select(*CHANNEL, "sample", F.coalesce("value", F.lit(0.0)).alias("value"))


def demean(samples: DataFrame) -> DataFrame:
    """Value minus the channel's mean: a small aggregate joined back, no window over whole channels."""
    mean = samples.groupBy(*CHANNEL).agg(F.avg("value").alias("_mean"))
    return samples.join(mean, list(CHANNEL)).withColumn("value", F.col("value") - F.col("_mean")).drop("_mean")


def rectified_mean(samples: DataFrame, by_grid: bool = True) -> DataFrame:
    """Mean |value| over channels at each sample, by grid or over all."""
    keys = ["recording_id", *["grid"] * by_grid, "sample"]
    return samples.groupBy(*keys).agg(F.avg(F.abs("value")).alias("activity"))


def channel_mean_abs(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*CHANNEL).agg(F.avg(F.abs("value")).alias("mean_abs"))


def moving_average(series: DataFrame, keys: list[str], width: int, value: str = "value") -> DataFrame:
    """Centred boxcar of `width` samples, zeros beyond the ends, always divided by the width.

    Samples are dealt out by blocks with a halo on both sides, so that one
    long series is many tasks.
    """
    lo, hi, block = width // 2, (width - 1) // 2, max(4096, 4 * width)
    at = F.col("sample")
    own = F.floor(at / block)
    halo = F.array_distinct(F.array(own, F.floor((at - hi) / block), F.floor((at + lo) / block)))
    dealt = series.withColumn("_own", own).withColumn("_block", F.explode(halo))
    w = W.partitionBy(*keys, "_block").orderBy("sample").rangeBetween(-lo, hi)
    return dealt.withColumn("smooth", F.sum(value).over(w) / width).where("_own = _block").drop("_own", "_block")


def decimate(series: DataFrame, fs: float, target_fs: float = 1000.0, start: int = 0) -> DataFrame:
    """Every k-th sample with k = round-half-even(fs / target), at least 1."""
    k = max(1, round(fs / target_fs)) if fs > 0 and target_fs > 0 else 1
    return series.where(F.pmod(F.col("sample") - start, F.lit(k)) == 0)


def minmax_envelope(samples: DataFrame, start: int, n: int, bins: int = 96) -> DataFrame:
    """Least and greatest value of each bin of ceil(n / bins) samples from start on."""
    step = max(1, -(-n // bins))
    inside = samples.where((F.col("sample") >= start) & (F.col("sample") < start + n))
    return inside.groupBy(*CHANNEL, F.floor((F.col("sample") - start) / step).alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def qc_window(samples: DataFrame, grid: int, start: int, end: int, total: int, mode: str, fs: float, channel: int | None = None, bins: int = 96) -> DataFrame:
    """One grid (or channel of it) over a clamped range, as an envelope or as decimated values; end <= 0 is the end of the recording."""
    end = total if end <= 0 else min(end, total)
    start = min(max(start, 0), max(end - 1, 0))
    part = samples.where((F.col("grid") == grid) & (F.col("sample") >= start) & (F.col("sample") < end))
    if channel is not None:
        part = part.where(F.col("channel") == channel)
    return minmax_envelope(part, start, end - start, bins) if mode == "envelope" else decimate(part, fs, start=start)


def keep_channels(samples: DataFrame, masks: DataFrame) -> DataFrame:
    """Without the masked channels (recording_id, grid, channel)."""
    return samples.join(masks.select(*CHANNEL), list(CHANNEL), "left_anti")


def eight_characters(c: Column) -> Column:
    """A number as the longest decimal, of at most six places, that fits into eight characters; six digits if none does."""
    texts = [F.format_string(f"%.{k}f", c) for k in range(6, -1, -1)]
    fits = F.coalesce(*(F.when(F.length(t) <= 8, t.cast("double")) for t in texts))
    return F.coalesce(fits, F.format_string("%.5e", c).cast("double"))


def physical_range(samples: DataFrame) -> DataFrame:
    """Least and greatest value of each channel, widened by 1 both ways where equal, as decimals of at most eight characters."""
    r = samples.groupBy(*CHANNEL).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    flat = F.col("low") == F.col("high")
    low, high = F.when(flat, F.col("low") - 1).otherwise(F.col("low")), F.when(flat, F.col("high") + 1).otherwise(F.col("high"))
    return r.select(*CHANNEL, eight_characters(low).alias("low"), eight_characters(high).alias("high"))


def quantize(samples: DataFrame, ranges: DataFrame, bits: int) -> DataFrame:
    """Values on the linear scale of signed integers of 16 or 24 bits."""
    top, low = 2 ** (bits - 1) - 1, -(2 ** (bits - 1))
    share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    return samples.join(ranges, list(CHANNEL)).withColumn("digital", F.rint(share * (top - low) + low).cast("long"))


def resolve_rois(recordings: DataFrame, rois: DataFrame, seconds: float | None = None) -> DataFrame:
    """Analysis ranges of each recording: its list, else the first seconds, else all; clamped to the recording, which must not be empty."""
    total = F.when(F.col("total_samples") > 0, F.col("total_samples")).otherwise(F.raise_error(F.lit("empty recording")).cast("long"))
    end = F.col("total") if seconds is None else F.least("total", F.rint(F.lit(seconds) * F.col("fsamp")).cast("long"))
    both = recordings.withColumn("total", total).join(rois, "recording_id", "left").select("recording_id", "total", F.coalesce("start", F.lit(0).cast("long")).alias("start"), F.coalesce("end", end).alias("end"))
    start = F.greatest(F.lit(0), F.least("start", F.col("total") - 1))
    clamped = both.withColumn("start", start)
    return clamped.select("recording_id", "start", F.greatest(F.col("start") + 1, F.least("end", "total")).alias("end"))


def assign_windows(samples: DataFrame, windows: DataFrame, trim: int = 0, embed: int = 1) -> DataFrame:
    """Samples with the number of each window that holds them, `trim` samples in from both ends if the window is long enough.

    windows: (recording_id, grid, win, start, end), few per grid; the join is
    equal on recording and grid with the range as its condition.
    """
    trimmed = (F.col("end") - F.col("start") + embed - 1) > 2 * trim
    w = windows.select("recording_id", "grid", "win", (F.col("start") + F.when(trimmed, trim).otherwise(0)).alias("_a"), (F.col("end") - F.when(trimmed, trim).otherwise(0)).alias("_b"))
    return samples.join(w, ["recording_id", "grid"]).where("sample >= _a and sample < _b").drop("_a", "_b")


def match_grid_spec(grids: DataFrame, catalog: DataFrame, name: str = "grid_name") -> DataFrame:
    """The first catalogue entry, in catalogue order, whose key is part of the grid's name; null if none."""
    hit = grids.select(name).distinct().join(F.broadcast(catalog), F.col(name).contains(F.col("key"))).groupBy(name).agg(F.min_by(F.struct(*catalog.columns), "ord").alias("spec"))
    return grids.join(hit, name, "left")


def electrode_coordinates(catalog: DataFrame) -> DataFrame:
    """(key, channel, row, col) of each 1-based channel of a map; the last cell counts for a channel listed twice."""
    rows = catalog.select("key", "n", F.posexplode("channel_map").alias("row", "cells"))
    cells = rows.select("key", "n", "row", F.posexplode("cells").alias("col", "channel")).where("channel between 1 and n")
    return cells.groupBy("key", "channel").agg(F.max(F.struct("row", "col")).alias("at")).select("key", "channel", "at.row", "at.col")


def channel_masks(channels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Discard flag of every channel: the override list of its grid counts only if it is as long as the grid."""
    n = channels.groupBy("recording_id", "grid").agg(F.count("*").alias("_n"))
    out = channels.join(n, ["recording_id", "grid"]).join(overrides, ["recording_id", "grid"], "left")
    return out.withColumn("discard", F.when(F.size("mask") == F.col("_n"), F.get("mask", F.col("channel").cast("int")) != 0).otherwise(F.lit(False))).drop("_n", "mask")


def butterworth_bandpass(order: int, low: float, high: float, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital band-pass by bilinear transform of the analogue prototype."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * (w2 - w1) / 2
    root = np.sqrt(half**2 - w1 * w2)
    z = lambda s: (2 * fs + s) / (2 * fs - s)
    poles = z(np.concatenate([half + root, half - root]))
    upper = sorted((p for p in poles if p.imag >= 0), key=lambda p: (p.real, p.imag))[:order]
    sections = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in upper]
    at = np.exp(2j * np.arctan(np.sqrt(w1 * w2) / (2 * fs)))
    gain = np.prod([abs(np.polyval(b, at) / np.polyval(a, at)) for b, a in sections])
    sections[0] = (sections[0][0] / gain, sections[0][1])
    return sections


def filtfilt(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Forward and backward pass with odd padding, each section starting in its steady state."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x.copy()
    for _ in range(2):
        for b, a in sections:
            # a band-pass section has no response to a constant input, so its steady state is known
            y = advance(y, b, a, np.array([-b[0], b[2]]) * y[0])[0]
        y = y[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


#: Band edges in Hz and filter order by kind of electrode.
BANDS = {"surface": (20.0, 500.0, 2), "intramuscular": (100.0, 4400.0, 3)}


def bandpass(samples: DataFrame, fs: float, kind: str = "surface", band: tuple[float, float, int] | None = None, block: int | None = BLOCK) -> DataFrame:
    """Zero-phase Butterworth band-pass of each channel, by blocks of samples of any length of recording.

    With block=None a channel is one group in a task: less work where all recordings are short.
    """
    low, high, order = band or BANDS[kind]
    sections = butterworth_bandpass(order, low, high, fs)
    if block is not None:
        return filtered(samples, sections, block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        return pdf.assign(value=filtfilt(pdf["value"].to_numpy(), sections))

    cols = samples.select(*CHANNEL, "sample", F.col("value").cast("double").alias("value"))
    return cols.groupBy(*CHANNEL).applyInPandas(run, cols.schema)


def spectral_notch(samples: DataFrame, fs: float, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """Remove narrow peaks of each channel's spectrum: bins over median + 5 deviations of their slice of int(fs) bins, widened by about 4 Hz.

    Channels of up to `block` samples are transformed in one task, longer ones,
    whose samples must follow without gaps, by columns and rows over many.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x = pdf["value"].to_numpy()
        n, step = len(x), int(fs)
        f = np.fft.fft(x)
        mag, flags = np.abs(f), np.zeros(n, bool)
        for lo in range(1, n - step + 1, step):
            part = mag[lo : lo + step]
            flags[lo : lo + step] = part > np.median(part) + 5 * part.std()
        reach = int(np.floor(round(4 * n / fs) / 2))
        wide = np.unique((np.flatnonzero(flags)[:, None] + np.arange(-reach, reach + 1)).ravel())
        wide = wide[(wide > 0) & (wide <= min(n // 2 + 1, n - 1))]
        g = np.zeros(n, complex)
        g[wide] = f[wide]
        g[(n - wide) % n] = np.conj(f[wide])
        return pdf.assign(value=x - np.fft.ifft(g).real)

    cols = samples.select(*CHANNEL, "sample", F.col("value").cast("double").alias("value"))
    n = samples.groupBy(*CHANNEL).agg(F.count("*").alias("n"), F.min("sample").alias("lo"), F.max("sample").alias("_hi")).where(F.col("n") > block)
    gapless = F.when(F.col("_hi") - F.col("lo") + 1 == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("a long channel has gaps or repeated samples")).cast("long"))
    long = stored(n.select(*CHANNEL, gapless.alias("n"), "lo"))  # at most one row for each `block` samples, so it can be broadcast
    short = cols.join(F.broadcast(long), list(CHANNEL), "left_anti").groupBy(*CHANNEL).applyInPandas(run, cols.schema)
    if long.isEmpty():
        return short
    return short.union(notched(cols.join(F.broadcast(long), list(CHANNEL), "left_semi"), F.broadcast(long), fs, cells))


def preview_bundle(samples: DataFrame, fs: float, width: int, masks: DataFrame | None = None, pulses: DataFrame | None = None, spikes: DataFrame | None = None, auxiliary: DataFrame | None = None, grids: DataFrame | None = None, catalog: DataFrame | None = None, first: int = 3) -> dict[str, DataFrame]:
    """Tables of a preview, each only if what it is made of is given; all series at about 1000 Hz.

    overall and by_grid: smoothed activity, the latter without masked channels;
    channels: mean |value| of all channels. pulses (recording_id, unit_uid, sample,
    value): of all units, `preview` marks the first units of a recording.
    spikes: sorted lists. auxiliary (recording_id, channel, name, sample, value).
    coordinates: row and column of each electrode of grids (recording_id, grid,
    grid_name), by the catalogue's entry for the grid's name.
    """
    kept = samples if masks is None else keep_channels(samples, masks)
    all_ = moving_average(rectified_mean(samples, False), ["recording_id"], width, "activity")
    grid = moving_average(rectified_mean(kept), ["recording_id", "grid"], width, "activity")
    out = {"overall": decimate(all_, fs), "by_grid": decimate(grid, fs), "channels": channel_mean_abs(samples)}
    if pulses is not None:
        place = F.dense_rank().over(W.partitionBy("recording_id").orderBy("unit_uid"))
        units = pulses.select("recording_id", "unit_uid").distinct().withColumn("preview", place <= first)
        out["pulses"] = decimate(pulses, fs).join(units, ["recording_id", "unit_uid"])
    if spikes is not None:
        out["spikes"] = spikes.groupBy("recording_id", "unit_uid").agg(F.array_sort(F.collect_set("sample")).alias("samples"))
    if auxiliary is not None:
        out["auxiliary"] = decimate(auxiliary, fs)
    if grids is not None and catalog is not None:
        named = match_grid_spec(grids, catalog).select("recording_id", "grid", F.col("spec.key").alias("key"))
        out["coordinates"] = named.join(electrode_coordinates(catalog), "key").select("recording_id", "grid", "channel", "row", "col")
    return out


def bucket(c: Column, width: int) -> Column:
    return F.floor(c / width)
