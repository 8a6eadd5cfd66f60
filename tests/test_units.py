"""Peaks, filters and duplicates against small brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.operators import decompose, signals, units


def test_peaks_match_a_greedy_loop(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 30, 400).astype(float)
    df = spark.createDataFrame([("r", 1, k, float(x)) for k, x in enumerate(v)], "recording_id string, unit_uid long, sample long, value double")
    got = sorted(r.sample for r in units.find_peaks(df, 7).collect())
    cand, k = [], 1
    while k < len(v) - 1:
        e = k
        while e < len(v) - 1 and v[e + 1] == v[k]:
            e += 1
        if v[k] > v[k - 1] and e < len(v) - 1 and v[e] > v[e + 1]:
            cand.append((k + e) // 2)
        k = e + 1
    kept = []
    for c in sorted(cand, key=lambda c: (-v[c], -c)):
        if all(abs(c - x) >= 7 for x in kept):
            kept.append(c)
    assert got == sorted(kept)


def test_bandpass_keeps_the_band_and_drops_the_rest():
    t = np.arange(4096) / 2048
    sections = signals.butterworth_bandpass(2, 20.0, 500.0, 2048.0)
    inside = signals.filtfilt(np.sin(2 * np.pi * 100 * t), sections)
    outside = signals.filtfilt(np.sin(2 * np.pi * 2 * t), sections)
    assert abs(np.abs(inside[500:-500]).max() - 1) < 0.01
    assert np.abs(outside[500:-500]).max() < 0.02


def test_whitened_covariance_is_a_projector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    s = spark.createDataFrame([("r", 0, c, k, float(x[k, c])) for k in range(200) for c in range(6)], "recording_id string, grid int, channel int, sample long, value double")
    w = decompose.whiten(decompose.frames(signals.demean(s)), decompose.whitening_basis(decompose.covariance_matrix(s)))
    y = np.stack([r.x for r in w.orderBy("sample").collect()])
    c = y.T @ y / len(y)
    assert np.allclose(c @ c, c, atol=1e-6)


def test_stream_equals_batch(spark, tmp_path):
    from spikeloom.streaming.envelope import stream_qc_envelope

    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.range(2000).select(F.lit("r").alias("recording_id"), (F.col("id") % 3).alias("unit_uid"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.sin(F.col("id").cast("double")).alias("value"))
    rows.write.parquet(src)
    live = spark.readStream.schema(rows.schema).parquet(src)
    q = stream_qc_envelope(live, "5 minutes", "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in stream_qc_envelope(spark.read.parquet(src), "5 minutes").collect()}
    assert got and got <= want and len(want) - len(got) <= 3


PULSES = "recording_id string, unit_uid long, sample long, value double"


def chosen(v, distance):
    """Maxima of a list, chosen one by one from the highest down."""
    cand, k = [], 1
    while k < len(v) - 1:
        e = k
        while e < len(v) - 1 and v[e + 1] == v[k]:
            e += 1
        if v[k] > v[k - 1] and e < len(v) - 1 and v[e] > v[e + 1]:
            cand.append((k + e) // 2)
        k = e + 1
    kept = []
    for c in sorted(cand, key=lambda c: (-v[c], -c)):
        if all(abs(c - x) >= distance for x in kept):
            kept.append(c)
    return sorted(kept)


@pytest.mark.parametrize("block", [8, 32, 1 << 18])
def test_peaks_over_block_borders(spark, block):
    rng = np.random.default_rng(3)
    stairs = np.ravel([[k, 0] for k in range(150)])  # each peak hangs on the next one, across all blocks
    series = {1: rng.integers(0, 4, 500), 2: np.repeat(rng.integers(0, 9, 40), rng.integers(1, 30, 40)), 3: stairs, 4: np.ones(300), 5: rng.integers(0, 90, 700), 6: [5], 7: stairs[::-1], 8: np.r_[0, np.ones(100), 0]}
    rows = [("r", u, k, float(x)) for u, v in series.items() for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, PULSES).repartition(3)
    maxima, found = {}, {}
    for name, out, got in (("maxima", units.local_maxima(df, block), maxima), ("peaks", units.find_peaks(df, 5, block=block), found)):
        for r in out.collect():
            got.setdefault(r.unit_uid, []).append(r.sample)
    for u, v in series.items():
        assert sorted(maxima.get(u, [])) == chosen(list(v), 1), u
        assert sorted(found.get(u, [])) == chosen(list(v), 5), u


def test_an_unseen_peak_leaves_open_what_hangs_on_it():
    at, value = np.array([0, 3, 6, 9, 30]), np.array([5.0, 6.0, 7.0, 8.0, 1.0])
    known = np.array([0, 0, 0, units.UNKNOWN, 0])
    assert units.settled(at, value, known, 4).tolist() == [-1, -1, -1, -1, 1]
    assert units.settled(at, value, np.array([0, 0, 0, units.CHOSEN, 0]), 4).tolist() == [0, 1, 0, 1, 1]


def test_two_means_of_hot_and_signed_heights(spark):
    rng = np.random.default_rng(4)
    heights = {1: np.r_[np.full(300, 2.0), rng.normal(9, 1, 40)], 2: rng.normal(-3, 2, 80), 3: [4.0], 4: [1.0, 1.0], 5: [0.0, -1e-9, 1e9], 6: np.r_[rng.normal(0, 1, 30), rng.normal(5, 0.1, 30), 0.0]}
    df = spark.createDataFrame([("r", u, k, float(x)) for u, v in heights.items() for k, x in enumerate(v)], PULSES)
    got = {}
    for r in units.two_means_split(df).orderBy("unit_uid", "sample").collect():
        got.setdefault(r.unit_uid, []).append(r.high)
    for u, v in heights.items():
        s = sorted(v)
        cost = [sum((x - np.mean(part)) ** 2 for part in (s[:k], s[k:]) for x in part) for k in range(1, len(s))]
        cut = s[int(np.argmin(cost))] if len(set(s)) > 1 else -np.inf
        assert got[u] == [x > cut for x in v], u


def test_bit_trains_count_as_pairs_do(spark):
    rng = np.random.default_rng(6)
    trains = {("r", 1): set(range(0, 900, 2)), ("r", 2): set(rng.integers(0, 900, 400).tolist()), ("r", 3): {5, 899}, ("q", 2): {1, 2, 3}, ("q", 9): {4}, ("q", 10): {100_000}}
    df = spark.createDataFrame([(r, u, k) for (r, u), t in trains.items() for k in [*t, *list(t)[:3]]], "recording_id string, unit_uid long, sample long")
    for maxlag, words in ((3, 2), (40, 1), (70, 64)):
        got = {(r.recording_id, r.u, r.v, r.lag): r.n for r in units.lag_overlap(df, maxlag, words=words).collect()}
        want = {(a[0], a[1], b[1], lag): n for a, x in trains.items() for b, y in trains.items() if a[0] == b[0] and a[1] < b[1] for lag in range(-2 * maxlag, 2 * maxlag + 1) if (n := len({k + lag for k in x} & y))}
        assert got == want


def test_leaders_by_rounds_match_the_greedy_pass(spark):
    rng = np.random.default_rng(7)
    rows, edges = [], []
    for g in range(6):
        n = int(rng.integers(1, 40))
        rows += [(f"g{g}", u, int(rng.integers(0, 9)), float(rng.integers(0, 4))) for u in range(n)]
        edges += [(f"g{g}", int(a), int(b), float(rng.integers(0, 2))) for a, b in rng.integers(0, n, (int(n * g / 2), 2))]
    rows += [("chain", u, u, 1.0) for u in range(12)]
    edges += [("chain", u, u + 1, 1.0) for u in range(11)]
    df, sc = spark.createDataFrame(rows, "recording_id string, unit_uid long, ord int, cov double"), spark.createDataFrame(edges, "recording_id string, u long, v long, score double")
    got = {(r.recording_id, r.unit_uid) for r in units.dedup_units(df, sc, 0.5).collect()}
    near = {(g, a, b) for g, a, b, s in edges if s >= 0.5} | {(g, b, a) for g, a, b, s in edges if s >= 0.5}
    want = set()
    for g in {r[0] for r in rows}:
        active = sorted((o, u, c) for x, u, o, c in rows if x == g)
        while active:
            lead, *later = active
            taken = [lead] + [x for x in later if (g, lead[1], x[1]) in near]
            want.add((g, min(taken, key=lambda x: (x[2], x[0], x[1]))[1]))
            active = [x for x in later if x not in taken]
    assert got == want
    assert units.dedup_units(df, sc.limit(0), 0.5).count() == len(rows)


def test_classes_of_equal_trains_stand_for_all_pairs(spark):
    rng = np.random.default_rng(8)
    kinds = [sorted(set(rng.integers(0, 60, n).tolist())) for n in (3, 9, 25, 25)] + [list(range(40)), [5], [6, 200_000]]
    trains = {(g, int(u)): kinds[int(k)] for g in ("a", "b") for u, k in enumerate(rng.integers(0, len(kinds), 23))}
    df = spark.createDataFrame([(g, u, s) for (g, u), t in trains.items() for s in t], "recording_id string, unit_uid long, sample long")
    classes = units.train_classes(df).cache()
    rep = {(r.recording_id, r.unit_uid): r.rep for r in classes.collect()}
    assert rep == {(g, u): min(x for (h, x), s in trains.items() if h == g and s == t) for (g, u), t in trains.items()}
    found = units.class_overlap(df, classes, 2).cache()
    got = {(r.recording_id, r.u, r.v, r.lag): (r.n, r.runs) for r in found.collect()}
    plain = {(r.recording_id, r.u, r.v, r.lag): (r.n, r.runs) for r in units.lag_overlap(df, 2).collect()}
    assert got == {(g, rep[g, u], rep[g, v], lag): n for (g, u, v, lag), n in plain.items()}
    for (g, u, v, lag), (n, runs) in plain.items():
        hit = [s for s in trains[g, u] if s + lag in trains[g, v]]
        assert (n, runs) == (len(hit), sum(s - 1 not in hit for s in hit))
    # leaders of classes are those of units, also where orders differ, and where copies don't reach the threshold
    for tol, order in ((0.15, lambda u: u), (0.3, lambda u: u * 7 % 23)):
        rows = spark.createDataFrame([(g, u, order(u), float(u % 3)) for g, u in trains], "recording_id string, unit_uid long, ord int, cov double")
        of = lambda o: units.duplicate_score(units.best_lags(o, df))
        want = {tuple(r) for r in units.dedup_units(rows, of(units.lag_overlap(df, 2)), tol).collect()}
        assert {tuple(r) for r in units.dedup_units(rows, of(found), tol, classes=classes).collect()} == want


def test_sparse_and_dense_counts_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([("r", u, int(s)) for u in range(9) for s in set(rng.integers(0, 5000, 60 * u + 5).tolist())], "recording_id string, unit_uid long, sample long")
    got = []
    for cost in (0, 1 << 40):
        monkeypatch.setattr(units, "WORDS_A_PAIR", cost)
        got.append(sorted(map(tuple, units.lag_overlap(df, 33, words=2, own=True).collect())))
    assert got[0] == got[1] and got[0]


def test_series_of_spikes_outside_and_repeated(spark):
    rows = [("r", 1, 3), ("r", 1, 3), ("r", 1, 0), ("r", 2, -5), ("r", 2, 40), ("r", 3, 9), ("r", 3, 10), ("r", 3, -1), ("q", 1, 0), ("x", 9, 1)]
    spikes = spark.createDataFrame(rows, "recording_id string, unit_uid long, sample long")
    totals = spark.createDataFrame([("r", 10), ("q", 1), ("x", 0)], "recording_id string, total_samples long")
    for block in (2, 65_536):
        out = units.pulse_from_spikes(spikes, totals, block)
        got = {}
        for r in out.orderBy("sample").collect():
            got.setdefault((r.recording_id, r.unit_uid), []).append(r.value)
        assert got == {("r", 1): [1, 0, 0, 1, 0, 0, 0, 0, 0, 0], ("r", 2): [0] * 10, ("r", 3): [0] * 9 + [1], ("q", 1): [1]}
    # spikes are shuffled once
    plan = units.pulse_from_spikes(spikes, F.broadcast(totals))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan
