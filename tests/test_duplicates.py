"""Duplicates over grids: copies cost one comparison, inputs are read once, and results are those of units one by one."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.operators import units as U


def plain(units, spikes, fsamp, tol, across):
    """All pairs of units of a group are compared, without classes."""

    def once(u, keys):
        named = u.withColumn("_group", F.concat_ws("/", *keys))
        own = spikes.join(named.select("recording_id", "unit_uid", "_group"), ["recording_id", "unit_uid"])
        lags = U.best_lags(U.lag_overlap(own, round(fsamp / 40), "_group"), own, "_group")
        near = F.col("share") > 0.2
        lags = lags.withColumn("runs", F.when(near, F.col("runs")).otherwise(F.col("runs_0")))
        return U.stored(U.dedup_units(named, U.stored(U.duplicate_score(lags)), tol, "_group").drop("_group"))

    out = once(units, ["recording_id", "grid"])
    return once(out, ["recording_id"]) if across else out


@pytest.fixture
def copies(spark):
    """Units of two recordings and three grids with few trains, many of them in several grids, others shifted copies."""
    rng = np.random.default_rng(5)
    base = [np.sort(rng.choice(400, 30, replace=False)) for _ in range(5)]
    base += [base[0] + 2, base[0] - 3, np.sort(np.append(base[1][3:], [401, 402])), base[2][:14], np.array([7])]
    spikes, units = [], []
    for rec in ("a", "b"):
        for u in range(36):
            t = int(rng.integers(len(base)))
            units.append((rec, u, int(rng.integers(3)), round(float(rng.random()), 1), int(rng.integers(40))))
            spikes += [(rec, u, int(k)) for k in base[t] if k >= 0] + [(rec, u, int(base[t][-1]))] * (u % 7 == 0)
    return spark.createDataFrame(units, "recording_id string, unit_uid int, grid int, cov double, ord int"), spark.createDataFrame(spikes, "recording_id string, unit_uid int, sample long")


@pytest.mark.parametrize(("tol", "across"), [(0.05, True), (0.3, False)])
def test_copies_over_grids_as_units_one_by_one(copies, tol, across):
    units, spikes = copies
    got = {tuple(r) for r in U.dedup_by_grid(units, spikes, 100.0, tol, across).collect()}
    assert got == {tuple(r) for r in plain(units, spikes, 100.0, tol, across).select(units.columns).collect()}


def test_trains_that_differ_are_compared_grid_by_grid(spark):
    rng = np.random.default_rng(6)
    rows = [("r", u, int(k)) for u in range(24) for k in rng.choice(300, 25, replace=False)]
    spikes = spark.createDataFrame(rows, "recording_id string, unit_uid int, sample long")
    units = spikes.select("recording_id", "unit_uid").distinct().select("*", (F.col("unit_uid") % 3).alias("grid"), F.lit(0.5).alias("cov"), F.col("unit_uid").alias("ord"))
    got = {tuple(r) for r in U.dedup_by_grid(units, spikes, 100.0, 0.2, True).collect()}
    assert got == {tuple(r) for r in plain(units, spikes, 100.0, 0.2, True).select(units.columns).collect()}


def test_inputs_are_read_once_and_trains_of_many_grids_compared_once(copies, tmp_path, monkeypatch):
    units, spikes = copies
    calls, compare = [], U.lag_overlap
    monkeypatch.setattr(U, "lag_overlap", lambda *a, **k: calls.append(1) or compare(*a, **k))

    def seen(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    U.dedup_by_grid(units.coalesce(1).mapInPandas(seen, units.schema), spikes, 100.0, 0.3, True).collect()
    assert len(list(tmp_path.iterdir())) == 1 and len(calls) == 1


def test_pairs_of_units_are_not_shuffled(spark):
    df = spark.createDataFrame([("r", u, 7 * u % 30 + k) for u in range(9) for k in (0, 40, 90)], "recording_id string, unit_uid long, sample long")
    for kind in ({}, {"best": True}, {"copies": True}, {"best": True, "copies": True}):
        plan = U.lag_overlap(df, 2, **kind)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("FlatMapGroupsInPandas")]


@pytest.mark.parametrize("words", [1, 1 << 18])
@pytest.mark.parametrize("tile", [3, 2048])
def test_best_rows_of_tiles_stretches_and_copies(spark, monkeypatch, words, tile):
    monkeypatch.setattr(U, "TILE", tile)
    monkeypatch.setattr(U, "CLASS", 2)
    rng = np.random.default_rng(11)
    kinds = [sorted(set(rng.integers(0, 300, n).tolist())) for n in (4, 30, 60, 60)] + [list(range(100, 180))]
    trains = {(g, int(u)): kinds[int(k)] for g in ("a", "b") for u, k in enumerate(rng.integers(0, len(kinds), 11))}
    rows = [(g, u, s) for (g, u), t in trains.items() for s in t]
    df = spark.createDataFrame(rows + [r for r in rows if r[1] == 4][:5], "recording_id string, unit_uid long, sample long")
    want, size = {}, {k: len(t) for k, t in trains.items()}
    for r in (("a", 4), ("b", 4)):
        size[r] = len([x for x in rows + [r for r in rows if r[1] == 4][:5] if x[:2] == r])
    for (g, u), x in trains.items():
        for (h, v), y in trains.items():
            if g == h and u < v:
                hits = {lag: [s for s in x if s + lag in y] for lag in range(-4, 5)}
                n = max(map(len, hits.values()))
                runs = lambda lag, hits=hits: sum(s - 1 not in hits[lag] for s in hits[lag])
                at = [lag for lag, s in hits.items() if len(s) == n]
                if n:
                    want[g, u, v] = (n, at[0], runs(at[0]), at[-1], runs(at[-1]), runs(0), size[g, u], size[g, v])
    for copies in (False, True):
        got = {(r.recording_id, r.u, r.v): (r.n, r.lag, r.runs, r.back, r.back_runs, r.runs_0, r.n_u, r.n_v) for r in U.lag_overlap(df, 2, words=words, best=True, copies=copies).collect()}
        assert got == want


@pytest.mark.parametrize("name", ["lag_overlap", "best_lags", "duplicate_score"])
def test_copies_are_paired_with_every_unit(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from spikeloom import queries as Q

    # users 0, 4 and 8 have one train, 12 has it a minute later, 16 another one
    events = [(u, 60 * (k + (u == 12))) for u in (0, 4, 8, 12) for k in (3, 10, 11, 50)] + [(16, 60 * k) for k in (2, 51)]
    spark.createDataFrame(events, "user_id long, sec long").selectExpr("user_id as event_id", "timestamp_seconds(1704067200 + sec) as ts", "user_id", "1.0d as value").write.parquet(f"{tmp_path}/events.parquet")
    got = Q.queries()[name](spark, str(tmp_path)).toPandas()
    assert {(a, b) for a, b in zip(got.u, got.v, strict=True)} == {(a, b) for a in (0, 4, 8, 12, 16) for b in (0, 4, 8, 12, 16) if a < b}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(Q.oracle_sql()[name]).df()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(float).round(6).values))
    assert key(got) == key(want)


def test_saved_edits_leave_out_duplicates(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from spikeloom import queries as Q

    # users 1, 5 and 13 of a recording have one train, 17 has it a minute later, 9 is flagged, 25 is another one
    events = [(u, 60 * (k + (u == 17))) for u in (1, 5, 9, 13, 17) for k in range(3, 900, 11)] + [(25, 60 * k) for k in range(2, 900, 97)]
    spark.createDataFrame(events, "user_id long, sec long").selectExpr("user_id as event_id", "timestamp_seconds(1704067200 + sec) as ts", "user_id", "1.0d as value").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, Q.queries()["save_edits"](spark, str(tmp_path)).collect()))
    assert [r[1] for r in got] == [1, 25]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(c.sql(Q.oracle_sql()["save_edits"]).fetchall())
