"""Commits of several tables: what stays, what is seen after a crash, and two at once."""

import pytest
from pyspark.sql import functions as F

from spikeloom.sources import tables as T
from spikeloom.sources import versions as V

UNITS, PULSES, SPIKES = "recording_id string, unit_uid long", "recording_id string, unit_uid long, sample long, value double", "recording_id string, unit_uid long, sample long"


def saved(spark, root, spikes, **more):
    s = spark.createDataFrame(spikes, SPIKES)
    pulses = s.withColumn("value", F.col("sample").cast("double"))
    recordings = s.select("recording_id").distinct().withColumn("total_samples", F.lit(None).cast("long"))
    return T.save_decomposition(s.select("recording_id", "unit_uid").distinct(), pulses, s, recordings, root, **more)


def rows(spark, root, table, version=None):
    df = V.read(spark, root, table, version)
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_a_save_keeps_other_recordings(spark, tmp_path):
    root = str(tmp_path / "x")
    assert saved(spark, root, [("a", 1, 5), ("a", 1, 5), ("a", 2, -1), ("1", 1, 3)]) == 0
    assert saved(spark, root, [("b", 1, 7)]) == 1
    assert rows(spark, root, "spikes") == [("1", 3, 1), ("a", 5, 1), ("b", 7, 1)]
    assert rows(spark, root, "spikes", 0) == [("1", 3, 1), ("a", 5, 1)]
    assert saved(spark, root, [("a", 9, 2)]) == 2
    assert sorted(rows(spark, root, "units")) == [(0, "1", 1), (0, "a", 9), (0, "b", 1)] and sorted(rows(spark, root, "recordings")) == [("1", 4), ("a", 3), ("b", 8)]
    assert rows(spark, root, "spikes", 1) == [("1", 3, 1), ("a", 5, 1), ("b", 7, 1)] and V.tables(spark, root) == {"units", "pulses", "spikes", "recordings"}


@pytest.mark.parametrize("broken", ["data", "manifest", "number"])
def test_a_commit_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch, broken):
    root = str(tmp_path / "x")
    saved(spark, root, [("a", 1, 5), ("b", 1, 5)])
    if broken == "number":
        monkeypatch.setattr(V, "_claim", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    elif broken == "manifest":
        monkeypatch.setattr(V, "versions", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost|without recording_id"):
        saved(spark, root, [("a", 1, 6)] if broken != "data" else [("a", 1, 6), (None, 1, 6)])
    monkeypatch.undo()
    assert V.versions(spark, root) == [0]
    assert rows(spark, root, "spikes") == [("a", 5, 1), ("b", 5, 1)]
    assert saved(spark, root, [("a", 1, 7)]) == 1 and rows(spark, root, "spikes") == [("a", 7, 1), ("b", 5, 1)]
    assert V.vacuum(spark, root) > 0 and V.versions(spark, root) == [1]
    assert rows(spark, root, "spikes") == [("a", 7, 1), ("b", 5, 1)]


def test_of_two_commits_at_once_none_is_lost(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "x")
    saved(spark, root, [("a", 1, 1)])
    claim, calls = V._claim, []

    def late(spark_, root_, version, manifest):
        if not calls:
            calls.append(version)
            saved(spark, root, [("b", 1, 2)])  # another one gets this number first
        return claim(spark_, root_, version, manifest)

    monkeypatch.setattr(V, "_claim", late)
    assert saved(spark, root, [("c", 1, 3)]) == 2 and calls == [1]
    assert rows(spark, root, "spikes") == [("a", 1, 1), ("b", 2, 1), ("c", 3, 1)]


def test_more_tables_and_columns(spark, tmp_path):
    root = str(tmp_path / "x")
    saved(spark, root, [("a", 1, 1)], losses=spark.createDataFrame([("a", 0.5)], "recording_id string, loss double"))
    saved(spark, root, [("b", 1, 1)], losses=spark.createDataFrame([("b", 0.25, 3)], "recording_id string, loss double, batch int"))
    assert rows(spark, root, "losses") == [(3, 0.25, "b"), (None, 0.5, "a")]
    saved(spark, root, [("b", 2, 2)])
    assert rows(spark, root, "losses") == [(3, 0.25, "b"), (None, 0.5, "a")]  # a table that isn't given keeps its rows


def test_edits_are_saved_with_log_events_and_participants(spark, tmp_path):
    root = str(tmp_path / "x")
    spikes = spark.createDataFrame([("a", u, k) for u, step in ((1, 10), (2, 13), (3, 10)) for k in range(0, 100, step)], SPIKES)
    units = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False)], UNITS + ", flagged boolean").withColumn("grid", F.lit(0))
    totals = spark.createDataFrame([("a", 100)], "recording_id string, total_samples long")
    log = lambda *seqs: spark.createDataFrame([("a", 1, k, "add_spikes") for k in seqs], UNITS + ", seq long, type string")
    artifacts = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 1, -4)], SPIKES)
    people = lambda *p: spark.createDataFrame(p, "participant_id string, age string")
    T.save_edited(root, units, spikes, spikes.withColumn("value", F.lit(1.0)), totals, 1000.0, log(1), artifacts, people(("sub-2", None), ("sub-10", "4")))
    T.save_edited(root, units, spikes, spikes.withColumn("value", F.lit(1.0)), totals, 1000.0, log(1, 2), None, people(("sub-2", "30")))
    kept = {r.unit_uid for r in V.read(spark, root, "units").collect()}
    assert kept == {1}  # 2 is flagged, 3 the same as 1
    assert rows(spark, root, "edit_log") == [("a", 1, "add_spikes", 1), ("a", 2, "add_spikes", 1)]
    assert rows(spark, root, "artifacts") == [("a", 4, 1)]
    assert rows(spark, root, "participants") == [("30", "sub-2"), ("4", "sub-10")]
    events = V.read(spark, root, "events").collect()
    assert {(r.onset, r.sample) for r in events} == {(f"{k / 1000:.6f}", k) for k in range(0, 100, 10)}
    assert V.read(spark, root, "pulses").count() == 100 and V.read(spark, root, "recordings").first().total_samples == 100
    with pytest.raises(Exception, match="total_samples is required"):
        T.save_edited(root, units, spikes, spikes.withColumn("value", F.lit(1.0)), totals.withColumn("total_samples", F.lit(0).cast("long")), 1000.0)
    assert V.versions(spark, root) == [0, 1]


def test_series_of_one_recording_are_written_by_many_tasks(spark, tmp_path):
    root = str(tmp_path / "x")
    s = spark.range(40).selectExpr("'a' recording_id", "id unit_uid", "id * 7 sample")
    units = s.select("recording_id", "unit_uid").withColumn("grid", F.lit(0)).withColumn("flagged", F.lit(False))
    totals = spark.createDataFrame([("a", 300)], "recording_id string, total_samples long")
    T.save_edited(root, units, s, s.limit(0).withColumn("value", F.lit(1.0)), totals, 100.0, remove_duplicates=False)
    assert len(list((tmp_path / "x" / "data" / "pulses").rglob("_scope=r-a/*.parquet"))) > 1
    got = V.read(spark, root, "pulses").groupBy("unit_uid").agg(F.count("*").alias("n"), F.sum("value").alias("ones"), F.max_by("sample", "value").alias("at")).collect()
    assert sorted(map(tuple, got)) == [(u, 300, 1.0, u * 7) for u in range(40)]
    assert spark.conf.get(V.WRITERS, "0") in ("0", None)
