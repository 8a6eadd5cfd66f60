"""Channel rows, grids and saved unit lists of recordings.

channels: (recording_id, row_no, type, group, target_muscle, sampling_frequency,
low_cutoff, high_cutoff, gain, ...), one row per channel; texts may be `n/a`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spikeloom.functions.labels import aux_channel_type, format_hz, na_to_null, safe_token


def _ordered(value: str, *order: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*order, value)))[value]


def grid_summary(channels: DataFrame) -> DataFrame:
    """Grids (by length of name, then name), their muscles without trailing blanks, and the first readable rate.

    Only EMG rows with a group; the first row of a group names its muscle.
    """
    emg = channels.where("type = 'EMG'").withColumn("group", na_to_null(F.col("group"))).where("group is not null")
    rate = F.when(F.col("sampling_frequency").try_cast("double").isNotNull(), F.struct("row_no", F.col("sampling_frequency").try_cast("double").alias("hz")))
    first = emg.groupBy("recording_id", "group").agg(F.min(F.struct("row_no", F.coalesce(na_to_null(F.col("target_muscle")), F.lit("")).alias("muscle")))["muscle"].alias("muscle"), F.min(rate).alias("_rate"))
    g = first.withColumn("_len", F.length("group")).groupBy("recording_id").agg(_ordered("group", "_len").alias("grids"), F.array_sort(F.collect_list(F.struct("_len", "group", "muscle")))["muscle"].alias("_m"), F.min("_rate")["hz"].alias("fsamp"))
    last = F.array_max(F.transform("_m", lambda m, k: F.when(m != "", k + 1).otherwise(0)))
    return g.select("recording_id", "grids", F.slice("_m", F.lit(1), last).alias("muscles"), "fsamp")


def recording_auto_info(channels: DataFrame) -> DataFrame:
    """First filled cutoffs and gain, and the distinct muscles in row order, of every recording."""
    first = lambda c: F.min(F.when(na_to_null(F.col(c)).isNotNull(), F.struct("row_no", na_to_null(F.col(c)).alias("v"))))["v"].alias(c)
    named = channels.withColumn("_m", na_to_null(F.col("target_muscle")))
    muscles = F.filter(F.array_distinct(F.array_sort(F.collect_list(F.struct("row_no", "_m")))["_m"]), lambda m: m.isNotNull())
    return named.groupBy("recording_id").agg(first("low_cutoff"), first("high_cutoff"), first("gain"), muscles.alias("muscles"))


def classify_channels(tracks: DataFrame, description: str = "description") -> DataFrame:
    """Adds `adapter` (1 general, 2-4 arrays of 16, 32, 64, 5 auxiliary) and `kind`: grid, other or aux."""
    d = F.coalesce(F.col(description), F.lit(""))
    adapter = F.when(d.contains("16"), 2).when(d.contains("32"), 3).when(d.contains("64") | d.contains("Splitter"), 4).when(d.contains("General") | d.contains("iEMG"), 1).otherwise(5)
    return tracks.withColumn("adapter", adapter).withColumn("kind", F.when(F.col("adapter").isin(3, 4), "grid").when(F.col("adapter") == 5, "aux").otherwise("other"))


#: mV of one count by device family and adapter (None: any other adapter of the family).
DEVICE_FACTORS = {
    ("QUATTROCENTO", "QUATTRO"): {"Direct connection": 0.1526, "AdapterControl": 1.0, None: 0.00050863},
    ("DUE+", "QUATTRO+"): {"AdapterControl": 1.0, "AdapterQuaternions": 1.0, None: 0.00024928},
    ("DUE",): {"AdapterControl": 1.0, "AdapterQuaternions": 1.0, None: 0.00025177},
    ("SYNCSTATION",): {"Due+": 0.00024928, "Quattro+": 0.00024928, "Direct connection to Syncstation Input": 0.1526, "AdapterLoadCell": 0.00037217, "AdapterControl": 1.0, "AdapterQuaternions": 1.0, None: 0.00028610},
}
#: The family that divides by a gain, its auxiliary factors by bits, and the gains that its settings stand for.
GAIN_DEVICES = ("SESSANTAQUATTRO", "SESSANTAQUATTRO+")
AUX_INPUT = "Direct connection to Auxiliary Input"
AUX_FACTOR = {16: 0.00014648, 24: 0.00000057220}
GAIN_OF_SETTING = {16: {256.0: 1.0, 128.0: 0.5, 64.0: 0.75}, 24: {1.0: 1.0, 0.5: 2.0, 0.25: 3.0, 0.125: 4.0}}


def device_factor(device: Column, adapter: Column, bits: Column, gain: Column) -> Column:
    """Factor from counts to mV. A gain of 0 counts as 1 for unknown devices; null devices and adapters are unknown ones."""
    device, adapter = F.coalesce(device, F.lit("")), F.coalesce(adapter, F.lit(""))
    by_gain = lambda g: F.lit(4.8 / 2**24 * 1000) / g
    still = adapter.isin("AdapterControl", "AdapterQuaternions")
    mapped = gain
    for b, settings in GAIN_OF_SETTING.items():
        for setting, g in settings.items():
            mapped = F.when((bits == b) & (gain == setting), g).otherwise(mapped)
    known = F.when(still, 1.0).when(adapter == AUX_INPUT, F.when(bits == 16, AUX_FACTOR[16]).otherwise(AUX_FACTOR[24])).otherwise(by_gain(mapped))
    other = F.when(adapter == AUX_INPUT, AUX_FACTOR[24]).when(still, 1.0).otherwise(by_gain(F.when(gain == 0, 1.0).otherwise(gain)))
    out = F.when(device.isin(*GAIN_DEVICES), known)
    for family, factors in DEVICE_FACTORS.items():
        pick = F.lit(factors[None])
        for name, f in factors.items():
            if name:
                pick = F.when(adapter == name, f).otherwise(pick)
        out = out.when(device.isin(*family), pick)
    return out.otherwise(other)


def scale_by_device(raw: DataFrame, channel_meta: DataFrame) -> DataFrame:
    """Counts to mV; channel_meta has (channel, device, adapter, bits, gain), one row per channel of a device."""
    f = channel_meta.select("channel", device_factor(F.col("device"), F.col("adapter"), F.col("bits"), F.col("gain")).alias("_factor"))
    return raw.join(F.broadcast(f), "channel").withColumn("value", F.col("value") * F.col("_factor")).drop("_factor")


def normalize_bad_mask(cells: Column, n: Column) -> Column:
    """n flags of 0 and 1 from flags, 1-based positions, 0-based positions or numbers; all 0 if none of these fits."""
    cells = F.coalesce(cells, F.array().cast("array<int>"))
    inside = lambda lo, hi: F.forall(cells, lambda x: (x >= lo) & (x <= hi))
    places = lambda base: F.transform(F.sequence(F.lit(base), n - 1 + base), lambda k: F.array_contains(cells, k).cast("int"))
    full = F.size(cells) == n
    mask = F.when(full & inside(0, 1), F.transform(cells, lambda x: x.cast("int"))).when(inside(1, n), places(1)).when(inside(0, n - 1), places(0)).when(full, F.transform(cells, lambda x: (x != 0).cast("int")))
    return F.when(n > 0, F.coalesce(mask, F.array_repeat(F.lit(0), n))).otherwise(F.array().cast("array<int>"))


def normalize_spike_lists(df: DataFrame, col: str) -> DataFrame:
    """(unit, spikes): a JSON list of spike lists as one row per unit, sorted, distinct, not negative.

    A null unit is an empty list, a flat list is one unit, nesting inside a unit is flattened, an empty or null text has no units.
    """
    parts = F.from_json(F.col(col), "array<string>")
    nested = F.exists(parts, lambda p: F.ltrim(p).startswith("["))
    blank = F.forall(parts, lambda p: p.isNull())
    units = df.withColumn("_units", F.when(nested | blank, parts).otherwise(F.array(F.col(col)))).select(*df.columns, F.posexplode("_units").alias("unit", "_text"))
    numbers = F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    spikes = F.transform(numbers, lambda x: x.cast("double").cast("long"))
    return units.withColumn("spikes", F.array_sort(F.array_distinct(F.filter(spikes, lambda x: x >= 0)))).drop("_text")


def unpack_gridwise_units(decomps: DataFrame) -> DataFrame:
    """(recording_id, unit, grid, spikes) from (recording_id, spikes by grid and unit, pulse_rows by grid, mapping or null).

    A grid has as many units as pulse rows: more lists are dropped, missing ones are empty. A mapping of
    the right length wins; of another length it puts every unit on grid 0.
    """
    total = F.aggregate("pulse_rows", F.lit(0), lambda s, n: s + F.greatest(n, F.lit(0)))
    g = decomps.select("recording_id", "spikes", "mapping", "pulse_rows", total.alias("_n"), F.posexplode("pulse_rows").alias("_g", "_rows")).where("_rows > 0")
    before = F.aggregate(F.slice("pulse_rows", F.lit(1), F.col("_g")), F.lit(0), lambda s, n: s + F.greatest(n, F.lit(0)))
    u = g.select("*", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_k")).withColumn("unit", before + F.col("_k"))
    grid = F.when(F.col("mapping").isNull(), F.col("_g")).when(F.size("mapping") == F.col("_n"), F.get("mapping", F.col("unit"))).otherwise(0)
    got = F.coalesce(F.get(F.get("spikes", F.col("_g")), F.col("_k")), F.array().cast("array<long>"))
    return u.select("recording_id", "unit", grid.alias("grid"), got.alias("spikes"))


def electrodes_table(electrodes: DataFrame) -> DataFrame:
    """Electrode rows: x and y in steps of the spacing (1.0 if unknown), names `E<n>` that run over the grids of a recording.

    electrodes: (recording_id, grid, grid_name, channel, row, col, ied, material).
    """
    step = F.coalesce(F.col("ied"), F.lit(1.0))
    n = F.row_number().over(W.partitionBy("recording_id").orderBy("grid", "channel"))
    space = safe_token(F.col("grid_name"), "Grid")
    return electrodes.select("recording_id", F.concat(F.lit("E"), n.cast("string")).alias("name"), F.round(F.col("row") * step, 4).alias("x"), F.round(F.col("col") * step, 4).alias("y"), space.alias("coordinate_system"), F.coalesce("material", F.lit("n/a")).alias("material"), F.concat(F.lit("Grid"), (F.col("grid") + 1).cast("string")).alias("group"))


def coordinate_spaces(grids: DataFrame) -> DataFrame:
    """One row per space of a recording, of its first grid; mm if the spacing is known, else arbitrary units."""
    own = safe_token(F.col("grid_name"), "")
    space = F.when(own == "", F.concat(F.lit("Grid"), (F.col("grid") + 1).cast("string"))).otherwise(own)
    g = grids.withColumn("space", space).groupBy("recording_id", "space").agg(F.min(F.struct("grid", "ied"))["ied"].alias("ied"))
    return g.select("recording_id", "space", F.when(F.col("ied").isNotNull(), "mm").otherwise("a.u.").alias("units"))


def recording_sidecar(recordings: DataFrame, channels: DataFrame) -> DataFrame:
    """(recording_id, sidecar map): filters and gain from the channels, then the recording's own `extra`, counts and duration last.

    recordings: (recording_id, fsamp, total_samples, extra map or null). Null values are left out.
    """
    number = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
    first = lambda c: F.min(F.when(number(c).isNotNull(), F.struct("row_no", number(c).alias("v"))))["v"]
    gain = na_to_null(F.col("gain"))
    a = channels.groupBy("recording_id").agg(first("low_cutoff").alias("_low"), first("high_cutoff").alias("_high"), F.when(F.min(gain) == F.max(gain), F.min(gain)).alias("_gain"), F.count_if(F.col("type") == "EMG").alias("_emg"), F.count_if(F.col("type") == "MISC").alias("_misc"))
    pairs = lambda **kv: F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    j = recordings.join(a, "recording_id", "left")
    base = pairs(SamplingFrequency=F.col("fsamp"), HighpassCutoff=F.col("_low"), LowpassCutoff=F.col("_high"), EMGGain=F.col("_gain"))
    last = pairs(EMGChannelCount=F.coalesce("_emg", F.lit(0)), MISCChannelCount=F.coalesce("_misc", F.lit(0)), RecordingDuration=F.try_divide(F.col("total_samples"), F.col("fsamp")))
    extra = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    over = lambda old, new: F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return j.select("recording_id", over(over(base, extra), last).alias("sidecar"))


#: Columns of a channel listing, in order.
LISTING = ("name", "type", "units", "description", "sampling_frequency", "signal_electrode", "reference", "group", "target_muscle", "placement_scheme", "placement_description", "interelectrode_distance", "grid_name", "low_cutoff", "high_cutoff", "notch", "status", "status_description", "gain")


def channels_sidecar(recordings: DataFrame, channels: DataFrame, aux: DataFrame) -> DataFrame:
    """recording_id, row_no and the 19 text columns of a channel listing; unknown values are `n/a`.

    recordings: recording_id, fsamp, units, reference, placement_scheme, and
    what holds for all channels of a recording: gain, low_cutoff, high_cutoff,
    notch. channels: recording_id, grid, channel, grid_name, target_muscle, ied,
    discard, and gain, low_cutoff, high_cutoff, notch, which come first. aux:
    recording_id, ord, label, gain, low_cutoff, high_cutoff. Electrodes are
    numbered over all grids of a recording; auxiliary rows follow.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit("n/a"))
    none, of_all = F.lit("n/a"), {c: f"_{c}" for c in ("gain", "low_cutoff", "high_cutoff", "notch")}
    r = recordings.select("recording_id", "fsamp", "units", "reference", F.when(F.lower("placement_scheme") == "measured", "measured").otherwise("other").alias("scheme"), *(F.col(c).alias(n) for c, n in of_all.items()))
    j = channels.join(r, "recording_id").withColumn("row_no", F.row_number().over(W.partitionBy("recording_id").orderBy("grid", "channel")))
    number, own = F.col("row_no").cast("string"), lambda c: F.coalesce(F.col(c), F.col(f"_{c}"))
    bad = F.col("discard") == 1
    emg = {
        "name": F.concat(F.lit("Ch"), F.when(F.col("row_no") < 10, F.lpad(number, 2, "0")).otherwise(number)), "type": F.lit("EMG"), "units": text(F.col("units")), "description": F.lit("ElectroMyoGraphy"),
        "sampling_frequency": text(F.col("fsamp")), "signal_electrode": F.concat(F.lit("E"), number), "reference": text(F.col("reference")), "group": F.concat(F.lit("Grid"), (F.col("grid") + 1).cast("string")),
        "target_muscle": text(F.col("target_muscle")), "placement_scheme": F.col("scheme"), "placement_description": none, "interelectrode_distance": text(F.nullif(F.col("ied"), F.lit(0.0))), "grid_name": text(F.col("grid_name")),
        "low_cutoff": format_hz(own("low_cutoff")), "high_cutoff": format_hz(own("high_cutoff")), "notch": text(own("notch")), "status": F.when(bad, "bad").otherwise("good"),
        "status_description": F.when(bad, "manually excluded").otherwise("n/a"), "gain": text(own("gain")),
    }
    count = channels.groupBy("recording_id").agg(F.count("*").alias("_n"))
    k = aux.join(r.select("recording_id", "fsamp"), "recording_id").join(count, "recording_id", "left")
    k = k.withColumn("row_no", F.coalesce("_n", F.lit(0)) + F.row_number().over(W.partitionBy("recording_id").orderBy("ord")))
    more = {c: none for c in LISTING} | {
        "name": F.col("label"), "type": aux_channel_type(F.col("label")), "units": F.lit("a.u."), "description": F.lit("Auxiliary Channel"), "sampling_frequency": text(F.col("fsamp")), "group": F.lit("Aux"),
        "low_cutoff": format_hz(F.col("low_cutoff")), "high_cutoff": format_hz(F.col("high_cutoff")), "status": F.lit("good"), "gain": text(F.col("gain")),
    }
    out = lambda df, cols: df.select("recording_id", F.col("row_no").cast("long").alias("row_no"), *(cols[c].alias(c) for c in LISTING))
    return out(j, emg).union(out(k, more))
