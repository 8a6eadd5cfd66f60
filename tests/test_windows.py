"""Fitting, view updates, filters, duplicates over grids and adaptive runs, against plain loops and made sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.operators import decompose as D
from spikeloom.operators import edits as E
from spikeloom.operators import signals as S
from spikeloom.operators import units as U
from spikeloom.operators import windows as V
from spikeloom.sources import tables as T
from spikeloom.streaming import adaptive as A
from test_adaptive import FRAME, MODEL, signal


def made(n=4000, channels=8, units=2, seed=3):
    """Channels that mix sparse spike trains with a short waveform each, and where the spikes are."""
    rng = np.random.default_rng(seed)
    x, trains = rng.normal(size=(n, channels)) * 0.05, []
    for u in range(units):
        at = np.cumsum(rng.integers(45 + 9 * u, 60 + 9 * u, n // 60))
        at = at[at < n - 60]
        for k, a in enumerate((1.0, -0.6, 0.2)):
            x[at + k] += a * rng.normal(size=channels)[None] * (1.0 + 0.02 * rng.normal(size=(len(at), 1)))
        trains.append(at)
    return x, trains


def test_fit_finds_made_sources():
    x, trains = made()
    e = V.embedded(x, 4)
    e = e - e.mean(0)
    white = e @ D.symmetric_whitening(np.cov(e, rowvar=False, ddof=0))[0]
    found = V.fit_window(white, V.Fit(1000.0, niter=6, sil=0.8, apart=0.02))
    assert found and all(u["sil"] >= 0.8 and abs(np.linalg.norm(u["filter"]) - 1) < 1e-9 for u in found)
    for at in trains:
        hit = max(max(len(np.intersect1d(u["spikes"], at + lag)) for lag in range(6)) / max(len(at), len(u["spikes"])) for u in found)
        assert hit > 0.9
    peeled = V.fit_window(white, V.Fit(1000.0, niter=6, sil=0.8, apart=0.02, peel=0.005))
    assert peeled


def test_waveforms_are_taken_out_where_they_fit():
    x = np.zeros((100, 2))
    at = np.array([2, 20, 24, 70, 98])
    for k in at:
        x[k : k + 2] += [[1.0, 2.0], [3.0, 4.0]][: 100 - k]
    one = V.without_waveform(x, np.array([20, 70]), 3)
    mean = (x[17:24] + x[67:74]) / 2
    assert np.allclose(one[65:75], x[65:75] - np.vstack([np.zeros((2, 2)), mean, np.zeros((1, 2))]))
    assert np.array_equal(V.without_waveform(x, np.array([2, 98]), 3), x)


def test_update_keeps_what_it_cannot_judge():
    x, (at, _) = made()
    short = V.update_view(x[:150], 0, at, 1000.0, 32, [], np.zeros(0, int), False, (20.0, 400.0, 2))
    empty = V.update_view(x, 0, np.zeros(0, int), 1000.0, 32, [], np.zeros(0, int), False, (20.0, 400.0, 2))
    assert short is None and empty is None
    pulse, spikes = V.update_view(x[500:3000], 500, at, 1000.0, 32, [], np.zeros(0, int), False, (20.0, 400.0, 2))
    inside = spikes[(spikes >= 600) & (spikes < 2900)]
    known = at[(at >= 600) & (at < 2900)]
    assert max(len(np.intersect1d(inside, known + lag)) for lag in range(-3, 6)) > 0.8 * len(known)
    assert not pulse[:100].any() and not pulse[-100:].any() and set(at[at < 600]) <= set(spikes.tolist())


def test_update_filter_window_by_view(spark):
    x, trains = made(n=1500)
    rows = [("r", 0, c, k, float(x[k, c])) for k in range(len(x)) for c in range(x.shape[1])]
    samples = spark.createDataFrame(rows, "recording_id string, grid int, channel int, sample long, value double")
    spikes = spark.createDataFrame([("r", 0, u, int(k)) for u, at in enumerate(trains) for k in at], "recording_id string, grid int, unit_uid int, sample long")
    views = spark.createDataFrame([("r", 0, 0, 0, 1500), ("r", 0, 1, 100, 250)], "recording_id string, grid int, unit_uid int, start long, end long")
    got = {r.unit_uid: r for r in V.update_filter_window(samples, spikes, views, 1000.0, 32, peel_others=True, band=(20.0, 400.0, 2)).collect()}
    want = V.update_view(x, 0, trains[0], 1000.0, 32, [trains[1]], np.zeros(0, int), False, (20.0, 400.0, 2))
    assert got[0].changed and np.allclose(got[0].pulse, want[0]) and got[0].spikes == want[1].tolist()
    assert not got[1].changed and got[1].pulse is None and got[1].spikes == trains[1].tolist()


@pytest.mark.parametrize("n", [1, 7, 256, 700])
def test_section_is_the_recurrence(n):
    rng = np.random.default_rng(n)
    x, (b, a), z = rng.normal(size=n), S.butterworth_bandpass(2, 10.0, 30.0, 100.0)[0], np.array([0.3, -0.2])
    want, (z1, z2) = [], z
    for v in x:
        o = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * o + z2, b[2] * v - a[2] * o
        want.append(o)
    assert np.allclose(S.advance(x, b, a, z)[0], want)


def plain_duplicates(trains, length, jitter, maxlag, tol):
    wide = [{t + j for t in at for j in range(-jitter, jitter + 1) if 0 <= t + j < length} for at in trains]
    even = [np.std(np.diff(at)) / np.mean(np.diff(at)) for at in trains]
    active, kept = [True] * len(trains), []
    for i in range(len(trains)):
        if not active[i]:
            continue
        same = [i]
        for j in range(i + 1, len(trains)):
            if active[j]:
                shares = [(len(wide[i] & {t + lag for t in wide[j]}) / np.sqrt(len(trains[i]) * len(trains[j])), -k) for k, lag in enumerate(range(-2 * maxlag, 2 * maxlag + 1))]
                best, k = max(shares)
                lag = -k - 2 * maxlag if best > 0.2 else 0
                common = sorted(wide[i] & {t + lag for t in wide[j]})
                runs = sum(k == 0 or common[k] != common[k - 1] + 1 for k in range(len(common)))
                if runs / max(len(trains[i]), len(trains[j])) >= tol:
                    same.append(j)
        kept.append(min(same, key=lambda x: even[x]))
        for k in same:
            active[k] = False
    return sorted(kept)


@pytest.mark.parametrize("tol", [0.05, 0.3])
def test_duplicates_over_grids(spark, tol):
    rng = np.random.default_rng(11)
    base = [np.sort(rng.choice(3000, 60, replace=False)) for _ in range(4)]
    trains = [*base, base[0] + 3, np.sort(np.append(base[1][5:], 2999)), np.sort(np.concatenate([base[2][:12], rng.choice(3000, 50)]))]
    trains = [np.unique(t[t < 3000]) for t in trains]
    spikes = spark.createDataFrame([("r", u, int(k)) for u, at in enumerate(trains) for k in at], "recording_id string, unit_uid int, sample long")
    units = U.isi_cov(spikes, 100.0).withColumn("ord", F.col("unit_uid")).withColumn("grid", F.lit(0))
    totals = spark.createDataFrame([("r", 3000)], "recording_id string, total_samples long")
    got = sorted(r.unit_uid for r in U.dedup_by_grid(units, spikes, 4000.0, tol, totals=totals).collect())
    assert got == plain_duplicates(trains, 3000, 1, 100, tol) and len(got) < len(trains)


def test_saved_edits(spark):
    rows = [("r", 0, k * 10) for k in range(50)] + [("r", 1, k * 10) for k in range(49)] + [("r", 2, k * 13 + k % 3) for k in range(30)] + [("r", 3, 5), ("r", 2, -4)]
    spikes = spark.createDataFrame(rows, "recording_id string, unit_uid int, sample long")
    units = spark.createDataFrame([("r", 0, 0, False), ("r", 1, 1, None), ("r", 2, 1, False), ("r", 3, 1, True)], "recording_id string, unit_uid int, grid int, flagged boolean")
    totals = spark.createDataFrame([("r", 600)], "recording_id string, total_samples long")
    pulses = spark.range(600).select(F.lit("r").alias("recording_id"), F.lit(2).alias("unit_uid"), F.col("id").alias("sample"), F.lit(0.5).alias("value"))
    kept, left, built = E.save_edits(units, spikes, pulses, totals, 1000.0)
    assert sorted(r.unit_uid for r in kept.collect()) == [0, 2] and left.where("sample < 0").count() == 0
    sums = {r.unit_uid: (r.n, r.total) for r in built.groupBy("unit_uid").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert sums == {0: (600, 50.0), 2: (600, 300.0)}
    assert {r.unit_uid for r in E.save_edits(units, spikes, pulses, totals, 1000.0, remove_flagged=False, remove_duplicates=False)[0].collect()} == {0, 1, 2, 3}


def test_one_recording_in_a_folder(spark):
    listing = spark.createDataFrame([("/a/x_emg.edf",), ("/a/x_emg.bdf",), ("/a/x_emg.json",), ("/a/x_emg_channels.tsv",), ("/b/y_emg.edf",), ("/b/z_emg.edf",)], "path string")
    found = T.resolve_recording_paths(listing)
    assert T.only_recording(found.where("folder = '/a'")).first()[2:] == ("/a/x_emg.bdf", "/a/x_emg_channels.tsv")
    with pytest.raises(Exception, match="several recordings"):
        T.only_recording(found).collect()


CFG = A.Config(50, distance=5)


def grids(spark, x, start, **more):
    frames = spark.createDataFrame([("r", 0, k, [float(v) for v in x[k]]) for k in range(len(x))], FRAME)
    row = ("r", 0, start, [float(v) for v in np.eye(4).ravel()], [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]], [0.5, 0.5], [12.0, 12.0])
    return frames, spark.createDataFrame([row], MODEL).withColumns({k: F.lit(v) for k, v in more.items()})


def sources(df):
    rows = sorted((r.sample, r.unit, r.source, r.spike) for r in df.collect())
    return [r[:2] for r in rows], np.array([r[2] for r in rows]), [r[3] for r in rows]


def test_backward_run_takes_blocks_from_the_end(spark):
    x = signal()
    frames, models = grids(spark, x, 130)
    at, value, spikes = sources(A.adaptive_bidirectional(frames, models, CFG))
    assert at == [(k, u) for k in range(len(x)) for u in range(2)]
    turned = np.vstack([x[100:130], x[50:100], x[:50]])
    home = np.concatenate([np.arange(100, 130), np.arange(50, 100), np.arange(50)])
    for part, first, place in ((turned, 0, home), (x[80:], 50, np.arange(80, len(x)))):
        f, m = grids(spark, part, 0)
        own, want, flags = sources(A.adaptive_corpus(f, m, CFG))
        back = {(int(place[k]), u): (v, s) for (k, u), v, s in zip(own, want, flags, strict=True) if k >= first}
        assert all(np.isclose(value[at.index(k)], v) and spikes[at.index(k)] == s for k, (v, s) in back.items())


def test_state_of_calibration_and_its_loss(spark):
    x = signal() @ np.diag([1.0, 2.0, 0.5, 1.0])
    frames, models = grids(spark, x, 0)
    row = A.init_whitening_state(frames, models, CFG).first()
    cov, kl = np.cov(x, rowvar=False), []
    for lo in range(0, 500, 50):
        cov = 0.9 * cov + 0.1 * np.cov(x[lo : lo + 50], rowvar=False)
        kl.append(0.5 * (np.trace(cov) - np.log(np.linalg.det(cov)) - 4))
    assert np.allclose(row.cov, cov.ravel()) and np.isclose(row.kl_mean, np.mean(kl)) and np.isclose(row.kl_std, np.std(kl))
    loss = A.whitening_loss(A.init_whitening_state(frames, models, CFG)).first()
    assert np.isclose(loss.kl, kl[-1]) and np.isclose(loss.loss, ((kl[-1] - np.mean(kl)) / np.std(kl)) ** 2)
    bad = spark.createDataFrame([("r", 0, [1.0, 2.0, 2.0, 1.0], 0.0, 1.0)], "recording_id string, grid int, cov array<double>, kl_mean double, kl_std double")
    assert A.whitening_loss(bad).first().loss is None


def test_updates_of_one_batch(spark):
    x = signal()[:50]
    frames, models = grids(spark, x, 0)
    w = np.array(A.whitening_update(frames, models, CFG).first().whitening).reshape(4, 4)
    cov = 0.9 * np.eye(4) + 0.1 * np.cov(x, rowvar=False)
    assert np.allclose(w, np.eye(4) - CFG.whitening_rate * (cov - np.eye(4)))
    flagged = frames.withColumn("spikes", F.array(F.get("x", F.lit(0)) > 2, F.lit(False)))
    for epochs in (1, 7):
        v = np.array(A.separation_update(flagged, models, A.Config(50, epochs=epochs, tol=0.0)).first().vectors)
        hit, new = x[:, 0] > 2, np.eye(4)[0]
        slope = (np.tanh(x[:, 0]) * hit) @ x / hit.sum()
        for _ in range(epochs):
            new = new + CFG.vector_rate * slope
            new /= np.linalg.norm(new)
        assert np.allclose(v[0], new) and np.allclose(v[1], np.eye(4)[1])


def test_the_last_batch_of_a_stream(spark, tmp_path):
    x = signal()
    frames, models = grids(spark, x, 0, total=len(x))
    models = models.withColumn("total", F.col("total").cast("long"))
    frames = frames.withColumn("ts", F.timestamp_micros((F.lit(1_700_000_000_000_000) + F.col("sample") * 1000).cast("long")))
    frames.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = A.adaptive_stream(stream, models, CFG, 1000.0).writeStream.format("memory").queryName("last_batch").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = sources(spark.table("last_batch")), sources(A.adaptive_corpus(frames, models, CFG))
    assert got[0] == want[0] == [(k, u) for k in range(len(x)) for u in range(2)]
    assert np.allclose(got[1], want[1]) and got[2] == want[2] and not any(got[2][-60:])


@pytest.mark.parametrize(("seed", "peel"), [(3, 0.004)])
def test_windows_in_step_give_the_units_of_one_task(spark, seed, peel):
    rows = []
    for rec, win, lo in (("a", 0, 0), ("a", 1, 1200), ("b", 0, 40)):
        x, _ = made(n=1100, channels=4, seed=win + len(rec) + lo)
        white = x @ D.symmetric_whitening(np.cov(x, rowvar=False, ddof=0))[0]
        rows += [(rec, 0, win, lo + k, [float(v) for v in r]) for k, r in enumerate(white)]
    df = spark.createDataFrame(rows, "recording_id string, grid int, win int, sample long, x array<double>")
    cfg = V.Fit(1000.0, niter=2, sil=0.0, updates=2, peel=peel, seed=seed)
    key = lambda r: (r.recording_id, r.win, r.unit)
    one, many = ({key(r): r for r in f(df, cfg).collect()} for f in (V.fit_units, V.fit_units_distributed))
    assert one.keys() == many.keys() and len(one) >= 3
    for k, u in one.items():
        assert np.allclose(np.array(u.filter), np.array(many[k].filter), atol=1e-6)
        assert abs(u.sil - many[k].sil) < 1e-6 and abs(u.cov - many[k].cov) < 1e-6 and u.spikes == many[k].spikes


def test_refinement_gives_the_sum_at_the_last_spikes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3)) * 0.2
    at = np.arange(30, 880, 40) + rng.integers(-1, 2, 22)
    x[at, 0] += 4
    w = np.array([1.0, 0.5, 0.3])
    kept, spikes, cov = V.refined(x, w, 9.0, 10)
    assert np.allclose(kept, x[spikes].sum(0)) and abs(cov - V.variability(spikes)) < 1e-12
    same, _, last = V.refined(x, w, 0.0, 10)
    assert np.array_equal(same, w) and last == 0.0


def test_queries_leave_no_stage_of_a_fit_out(spark, monkeypatch):
    import inspect

    from spikeloom import queries as Q

    seen = {}
    for name in ("fit_units_distributed", "update_filter_window"):
        of = inspect.signature(getattr(V, name))
        monkeypatch.setattr(V, name, lambda *a, name=name, of=of, **k: (_ for _ in ()).throw(InterruptedError(seen.setdefault(name, of.bind(*a, **k).arguments))))
        with pytest.raises(InterruptedError):
            Q.queries()[name](spark, "/root/testdata/sf0.001")
    cfg, plain = seen["fit_units_distributed"]["cfg"], V.Fit(100.0)
    assert (cfg.niter, cfg.updates, cfg.tol) == (plain.niter, plain.updates, plain.tol)
    assert round(seen["update_filter_window"].get("width", 1000) / 64) > 1  # rows before each are embedded


@pytest.mark.parametrize(("peel", "seed"), [(None, None), (0.004, 3)])
def test_small_windows_are_fitted_whole_and_large_ones_in_steps(spark, monkeypatch, peel, seed):
    rng = np.random.default_rng(4)
    rows, calls, step = [], [], V.contrast_step
    for win, n, first in (("one", 900, 700), ("two", 1400, 0)):
        x = rng.normal(size=(n, 4)) * 0.5
        for c in range(2):
            at = np.arange(20 + 9 * c, n - 20, 23 + 8 * c)
            x[at + rng.integers(-2, 3, len(at)), c] += 5
        rows += [(win, 0, 0, first + k, v.tolist()) for k, v in enumerate((x - x.mean(0)) / x.std(0))]
    df = spark.createDataFrame(rows, "recording_id string, grid int, win int, sample long, x array<double>")
    cfg = V.Fit(1000.0, niter=2, sil=0.0, updates=4, peel=peel, seed=seed)
    monkeypatch.setattr(V, "contrast_step", lambda x, v, c: calls.append({r.recording_id.split("\n")[0] for r in v.collect()}) or step(x, v, c))
    one, many = ({(r.recording_id, r.unit): r for r in f(df, cfg).collect()} for f in (V.fit_units, V.fit_units_distributed))
    assert one.keys() == many.keys() and {k[0] for k in one} == {"one", "two"}
    assert calls and all(c == {"two"} for c in calls)
    for k, u in one.items():
        assert np.allclose(np.array(u.filter), np.array(many[k].filter), atol=1e-6) and abs(u.sil - many[k].sil) < 1e-6 and u.spikes == many[k].spikes
