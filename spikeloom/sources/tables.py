"""Dataset tables and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.sources import versions


def spike_events_table(spikes: DataFrame, fsamp: float, *keys: str) -> DataFrame:
    """One row per spike: onset in seconds with six decimals, duration 0, sample, unit and label, after any further keys."""
    return spikes.select(*keys, F.format_string("%.6f", F.col("sample") / F.lit(float(fsamp))).alias("onset"), F.lit(0.0).alias("duration"), "sample", "unit_uid", F.lit("motor unit discharge").alias("description"))


def upsert_participants(existing: DataFrame, updates: DataFrame, key: str = "participant_id") -> DataFrame:
    """One row per participant, updates win; null becomes `n/a`. Numeric labels come first, by number, then others. updates has one row per participant."""
    rest = [c for c in existing.columns if c != key]
    j = existing.alias("a").join(updates.alias("b"), key, "full")
    label = F.regexp_replace(F.col(key).cast("string"), "^sub-", "")
    out = j.select(key, *(F.coalesce(f"b.{c}", f"a.{c}", F.lit("n/a")).alias(c) for c in rest))
    return out.orderBy(label.try_cast("long").asc_nulls_last(), label)


def uniform_or_null(df: DataFrame, keys: list[str], cols: dict[str, str], ignore: str | None = None) -> DataFrame:
    """A column's value where all rows of a key agree, else null."""
    seen = lambda c: F.when(F.col(c) != ignore, F.col(c)) if ignore else F.col(c)
    return df.groupBy(*keys).agg(*(F.when(F.count_distinct(seen(c)) == 1, F.min(seen(c))).alias(out) for c, out in cols.items()))


def missing_only(planned: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Planned outputs that aren't there yet."""
    return planned.join(existing.select(key), key, "left_anti")


def lookup_participants(recordings: DataFrame, participants: DataFrame) -> DataFrame:
    """Each recording with what its `sub-<subject>` row says; the first row (by `row`) of a participant counts."""
    cols = [c for c in participants.columns if c not in ("participant_id", "row")]
    first = participants.groupBy("participant_id").agg(F.min_by(F.struct(*cols), "row").alias("_p"))
    j = recordings.withColumn("participant_id", F.concat(F.lit("sub-"), "subject")).join(first, "participant_id", "left")
    return j.select(*recordings.columns, *(F.col(f"_p.{c}").alias(c) for c in cols))


def patch_metadata(meta: DataFrame, updates: DataFrame, key: str = "recording_id") -> DataFrame:
    """Maps with the keys of an update put over them; empty values are not written; doing it twice changes nothing."""
    j = meta.join(updates.withColumnRenamed("meta", "_new"), key, "left")
    new = F.coalesce(F.map_filter("_new", lambda k, v: v.isNotNull() & (v != "")), F.create_map().cast("map<string,string>"))
    old = F.map_filter("meta", lambda k, v: ~F.map_contains_key(new, k))
    return j.withColumn("meta", F.map_concat(old, new)).drop("_new")


def read_channels_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Channel rows of tab-separated sidecars with their file: type, group and whether a channel is bad; `n/a` is null."""
    rows = spark.read.option("header", True).option("sep", "\t").option("nullValue", "n/a").csv(paths)
    return rows.select("*", F.col("_metadata.file_path").alias("path")).withColumn("bad", F.coalesce(F.lower("status") == "bad", F.lit(False)))


def read_recording_sidecars(spark: SparkSession, paths: str | list[str], schema: str, lines: bool = False) -> DataFrame:
    """One row per JSON sidecar (with lines: per line of a file) under an explicit schema; missing keys are null."""
    return spark.read.schema(schema).option("multiLine", not lines).json(paths).select("*", F.col("_metadata.file_path").alias("path"))


def resolve_recording_paths(listing: DataFrame) -> DataFrame:
    """(folder, label, path, channels): the signal file of each entity label and its channel sidecar, from a listing of paths.

    A signal is `<label>_emg.<suffix>`: .bdf before .edf before any other but
    .json and .tsv. The sidecar is `<label>_channels.tsv`, else the older
    `<label>_emg_channels.tsv`, else null.
    """
    name = F.substring_index("path", "/", -1)
    files = listing.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("_name"))
    suffix = F.lower(F.regexp_extract("_name", r"\.([^.]*)$", 1))
    signal = files.withColumn("label", F.regexp_extract("_name", r"^(.*)_emg\.[^.]*$", 1)).where((F.col("label") != "") & ~suffix.isin("json", "tsv"))
    rank = F.when(suffix == "bdf", 0).when(suffix == "edf", 1).otherwise(2)
    best = signal.groupBy("folder", "label").agg(F.min(F.struct(rank.alias("r"), "path")).alias("s"))
    side = files.withColumn("label", F.regexp_extract("_name", r"^(.*?)(?:_emg)?_channels\.tsv$", 1)).where("label <> ''")
    older = F.col("_name").endswith("_emg_channels.tsv")
    side = side.groupBy("folder", "label").agg(F.min(F.struct(older.alias("r"), "path")).alias("c"))
    return best.join(side, ["folder", "label"], "left").select("folder", "label", F.col("s.path").alias("path"), F.col("c.path").alias("channels"))


def only_recording(resolved: DataFrame) -> DataFrame:
    """One row per folder; a folder with several recordings is an error."""
    one = resolved.groupBy("folder").agg(F.count("*").alias("_n"), F.first(F.struct("label", "path", "channels")).alias("r"))
    path = F.when(F.col("_n") == 1, F.col("r.path")).otherwise(F.raise_error(F.concat(F.lit("several recordings in "), "folder")).cast("string"))
    return one.select("folder", "r.label", path.alias("path"), "r.channels")


def save_decomposition(units: DataFrame, pulses: DataFrame, spikes: DataFrame, recordings: DataFrame, root: str, **more: DataFrame) -> int:
    """Commit decompositions of recordings, all tables at once; what is saved of other recordings stays (see versions.commit). Returns the version.

    Spikes are distinct and inside their recording, whose length is its own
    `total_samples`, else that of the pulses, else the last spike's place + 1;
    units without a grid get grid 0. more: further tables with recording_id, such
    as losses, emg, masks or coordinates.
    """
    from spikeloom.operators.units import UNIT, infer_total_samples

    totals = infer_total_samples(recordings, pulses, spikes)
    rows = spikes.select(*UNIT, "sample").distinct().join(totals, "recording_id").where("sample >= 0 and sample < total_samples").drop("total_samples")
    tables = {
        "recordings": recordings.drop("total_samples").join(totals, "recording_id"), "units": units.withColumn("grid", F.coalesce("grid", F.lit(0))) if "grid" in units.columns else units.withColumn("grid", F.lit(0)),
        "pulses": pulses.select(*UNIT, "sample", "value"), "spikes": rows,
    }
    return versions.commit(recordings.sparkSession, root, tables | more)


def save_edited(root: str, units: DataFrame, spikes: DataFrame, pulses: DataFrame, totals: DataFrame, fsamp: float, entries: DataFrame | None = None, artifacts: DataFrame | None = None, participants: DataFrame | None = None, **rules) -> int:
    """Commit edited recordings: units, spikes, pulses, artifacts, edit log, events and participants in one version, which is returned.

    Units and series are those of edits.save_edits (rules are its switches).
    totals (recording_id, total_samples) names the recordings that are saved. The
    stored log of a recording is only ever added to: entries (recording_id, seq,
    ...) that it has already are not written twice. Events are the remaining
    spikes in seconds; artifacts are kept for remaining units; participants
    (participant_id, ...) are put over those of the dataset.
    """
    from spikeloom.operators.edits import append_edit_log, save_edits
    from spikeloom.operators.units import UNIT

    spark = totals.sparkSession
    known = versions.tables(spark, root) if versions.versions(spark, root) else set()
    kept, rows, series = save_edits(units, spikes, pulses, totals, fsamp, **rules)
    total = F.when(F.col("total_samples") > 0, F.col("total_samples")).otherwise(F.raise_error(F.lit("total_samples is required to save edits")).cast("long"))
    recordings = totals.select("recording_id", total.alias("total_samples"), F.lit(float(fsamp)).alias("fsamp"))
    names = kept.select(*UNIT)
    out = {"recordings": recordings, "units": kept, "spikes": rows, "pulses": series, "events": spike_events_table(rows, fsamp, "recording_id")}
    if artifacts is not None:
        out["artifacts"] = artifacts.where("sample >= 0").select(*UNIT, "sample").distinct().join(names, list(UNIT), "left_semi")
    if entries is not None:
        mine = entries.join(recordings.select("recording_id"), "recording_id", "left_semi")
        if "edit_log" in known:
            old = versions.read(spark, root, "edit_log").join(recordings.select("recording_id"), "recording_id", "left_semi")
            mine = append_edit_log(old, mine.join(old.select("recording_id", "seq"), ["recording_id", "seq"], "left_anti"))
        out["edit_log"] = mine
    shared = {}
    if participants is not None:
        there = versions.read(spark, root, "participants") if "participants" in known else participants.limit(0)
        shared["participants"] = upsert_participants(there, participants)
    return versions.commit(spark, root, out, shared, laid=frozenset({"pulses"}))
