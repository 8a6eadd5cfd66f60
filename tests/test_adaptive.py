"""Adaptive decomposition against a plain loop, stream against batch, and refinement."""

import time

import numpy as np
from pyspark.sql import functions as F

from spikeloom.operators import decompose as D
from spikeloom.streaming import adaptive as A

CFG = A.Config(50, skip=2, distance=5)
FRAME = "recording_id string, grid int, sample long, x array<double>"
MODEL = "recording_id string, grid int, start long, whitening array<double>, vectors array<array<double>>, low array<double>, high array<double>"


def signal(n=530, d=4, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for u in range(2):
        x[rng.integers(0, n, 40), u] += 4
    return x


def tables(spark, xs):
    rows = [(r, 0, k, [float(v) for v in x[k]]) for r, x in xs.items() for k in range(len(x))]
    models = [(r, 0, 0, [float(v) for v in np.eye(4).ravel()], [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]], [0.5, 0.5], [12.0, 12.0]) for r in xs if r != "none"]
    return spark.createDataFrame(rows, FRAME), spark.createDataFrame(models, MODEL)


def plain(x, cfg):
    """The same steps written out one scalar or sample at a time."""
    w, v, cov = np.eye(4), np.eye(4)[:2].copy(), np.eye(4)
    low, high = [0.5, 0.5], [12.0, 12.0]
    out = {}
    whole = len(x) // cfg.batch
    for b in range(whole):
        at = list(range(b * cfg.batch + (cfg.skip if b == 0 else 0), (b + 1) * cfg.batch))
        white = np.array([w @ x[k] for k in at])
        c = sum(np.outer(r - white.mean(0), r - white.mean(0)) for r in white) / (len(white) - 1)
        cov = (1 - cfg.alpha) * cov + cfg.alpha * c
        w = w - cfg.whitening_rate * (cov - np.eye(4)) @ w
        s = np.array([[v[u] @ r for u in range(2)] for r in white])
        spike = np.zeros(s.shape, bool)
        for u in range(2):
            p = s[:, u] * abs(s[:, u])
            cand = [k for k in range(1, len(p) - 1) if p[k - 1] < p[k] > p[k + 1] and low[u] / 3 <= p[k] <= 3 * high[u]]
            kept = []
            for k in sorted(cand, key=lambda k: -p[k]):
                if all(abs(k - j) >= cfg.distance for j in kept):
                    kept.append(k)
            mid = (low[u] + high[u]) / 2
            ups, downs = [p[k] for k in kept if p[k] > mid], [p[k] for k in kept if p[k] <= mid]
            for k in kept:
                spike[k, u] = p[k] > mid
            high[u] = (5 * high[u] + sum(ups)) / (5 + len(ups))
            low[u] = (5 * low[u] + sum(downs)) / (5 + len(downs))
        new = v.copy()
        for u in range(2):
            if spike[:, u].any():
                new[u] = v[u] + cfg.vector_rate * np.mean([white[k] * np.tanh(s[k, u]) for k in range(len(s)) if spike[k, u]], axis=0)
                new[u] /= np.linalg.norm(new[u])
        if spike[:, 1].any():
            new[1] -= (new[0] @ new[1]) * new[0]
            new[1] /= np.linalg.norm(new[1])
        v = new
        out |= {(u, k): (s[i, u], bool(spike[i, u])) for i, k in enumerate(at) for u in range(2)}
    for k in range(whole * cfg.batch, len(x)):
        out |= {(u, k): (v[u] @ w @ x[k], False) for u in range(2)}
    return out


def test_corpus_matches_a_plain_loop(spark):
    xs = {"a": signal(), "b": signal(seed=9, n=120), "none": signal(n=30)}
    frames, models = tables(spark, xs)
    got = A.adaptive_corpus(frames, models, CFG).collect()
    assert {r.recording_id for r in got} == {"a", "b"} and any(r.spike for r in got)
    for name in ("a", "b"):
        want = plain(xs[name], CFG)
        mine = {(r.unit, r.sample): (r.source, r.spike) for r in got if r.recording_id == name}
        assert mine.keys() == want.keys()
        assert all(abs(mine[k][0] - want[k][0]) < 1e-9 and mine[k][1] == want[k][1] for k in want)
    assert A.adaptive_corpus(frames.limit(0), models, CFG).count() == 0


def played(spark, tmp_path, files, models, cfg, delay="1 second", stop_after=None):
    """Rows of a stream over these files in order, one a trigger; with stop_after the query is stopped and started again from its checkpoint."""
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    ts = F.timestamp_micros((F.lit(1_700_000_000_000_000) + F.col("sample") * 10_000).cast("long"))
    for k, df in enumerate(files):
        if k in (0, stop_after):
            if k:
                run(spark, src, out, mark, models, cfg, delay)
        df.withColumn("ts", ts).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)  # files are taken by their time
    run(spark, src, out, mark, models, cfg, delay)
    return spark.read.parquet(out)


def run(spark, src, out, mark, models, cfg, delay):
    live = spark.readStream.schema(FRAME + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = A.adaptive_stream(live, models, cfg, 100.0, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)


def same(a, b):
    of = lambda df: sorted(map(tuple, df.select("recording_id", "unit", "sample", F.round("source", 9), "spike").collect()))
    return of(a) == of(b)


def test_stream_equals_batch_over_shuffled_input_and_a_restart(spark, tmp_path):
    frames, models = tables(spark, {"a": signal(n=230), "b": signal(seed=9, n=230)})
    models = models.withColumn("total", F.lit(230).cast("long"))
    dealt = [frames.where(F.pmod(F.xxhash64("recording_id", "sample"), F.lit(4)) == k) for k in (2, 0, 3, 1)]
    got = played(spark, tmp_path, [*dealt, frames.where("sample = 7")], models, CFG, "1 hour", stop_after=2)  # a repeated sample is late
    assert same(got, A.adaptive_corpus(frames, models, CFG)) and got.count() == 2 * 2 * (230 - CFG.skip)


def test_a_lost_sample_closes_by_time(spark, tmp_path):
    frames, models = tables(spark, {"a": signal(n=330), "none": signal(n=60)})
    there = frames.where("sample <> 70 and sample not between 150 and 219")  # one place, and a batch and a half
    files = [there.where(F.col("sample").between(lo, lo + 59)) for lo in range(0, 330, 60)]
    late = frames.where("recording_id = 'a' and sample = 70")
    got = played(spark, tmp_path, [*files[:4], late, *files[4:], files[0].limit(0).union(spark.createDataFrame([("none", 0, 5000, [0.0] * 4)], FRAME)), there.limit(1)], models, CFG)
    want = A.adaptive_corpus(there, models, CFG).where("recording_id = 'a'")
    assert same(got, want)
    rows = {(r.unit, r.sample): r for r in got.collect()}
    assert (0, 70) not in rows and (0, 71) in rows and not any(r.spike for (_, k), r in rows.items() if 50 <= k < 100)
    assert {k // 50 for _, k in rows} == {0, 1, 2, 4, 5, 6}


def test_feeder_keeps_no_more_than_it_must():
    row = {"whitening": np.eye(4).ravel(), "vectors": [np.eye(4)[0]], "low": [0.5], "high": [12.0]}
    f = A.Feeder(A.GridState(row), A.Config(10), 5, None)
    x = signal(n=200)
    f.add(np.arange(0, 12), x[:12])
    assert not list(f.ready()) and f.at.tolist() == list(range(5, 12))
    f.add(np.arange(12, 40), x[12:40])
    assert [len(r[0]) for r in f.ready()] == [10, 10, 10] and f.at.tolist() == list(range(35, 40))
    f.add(np.array([3, 36, 190]), x[:3])
    assert [r[0].tolist() for r in f.ready(44)] == [] and [r[0].tolist() for r in f.ready(45)] == [list(range(35, 40))]
    assert f.low == 45 and not list(f.ready(100)) and f.low == 95 and [r[0].tolist() for r in f.ready(np.inf)] == [[190]]


def test_windows_losses_and_both_ways(spark):
    x = signal(n=230)
    frames, models = tables(spark, {"a": x})
    two = models.withColumn("win", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("start", F.when(F.col("win") == 1, 60).otherwise(0).cast("long"))
    got = A.adaptive_corpus(frames, two, CFG)
    assert same(got.where("win = 0"), A.adaptive_corpus(frames, models, CFG))
    assert same(got.where("win = 1"), A.adaptive_corpus(frames, models.withColumn("start", F.lit(60).cast("long")), CFG))
    both = A.adaptive_bidirectional(frames, two, CFG)
    assert both.groupBy("win", "unit", "sample").count().where("count > 1").count() == 0
    assert same(both.where("win = 1"), A.adaptive_bidirectional(frames, models.withColumn("start", F.lit(60).cast("long")), CFG))
    ready = A.init_whitening_state(frames, models, CFG).withColumn("contrast_mean", F.array(F.lit(0.1), F.lit(0.2))).withColumn("contrast_std", F.array(F.lit(0.5), F.lit(0.5)))
    losses = {(r.batch, r.unit): r for r in A.adaptive_losses(frames, ready, CFG).collect()}
    assert set(losses) == {(b, u) for b in range(4) for u in range(2)}
    rows, k = A.adaptive_corpus(frames, ready, CFG).collect(), ready.first()
    for (b, u), r in losses.items():
        at = [s.source for s in rows if s.unit == u and s.sample // 50 == b and s.spike]
        want = ((np.log(np.cosh(np.mean(at))) - k.contrast_mean[u]) / 0.5) ** 2 if at else None
        assert (r.contrast_loss is None) == (want is None) and (want is None or abs(r.contrast_loss - want) < 1e-6)
        assert r.whitening_loss >= 0 and abs(r.total_loss - (r.whitening_loss + sum(losses[b, v].contrast_loss or 0 for v in range(2)))) < 1e-6


def test_frames_of_adaptive_runs_are_demeaned(spark):
    s = spark.createDataFrame([("r", 0, c, k, float(k * (c + 1))) for c in range(2) for k in range(5)], "recording_id string, grid int, channel int, sample long, value double")
    got = {r.sample: list(r.x) for r in A.adaptive_frames(s, 2).collect()}
    assert got[0] == [-2.0, -4.0, 0.0, 0.0] and got[3] == [1.0, 2.0, 0.0, 0.0] and got[4] == [2.0, 4.0, 1.0, 2.0]


def test_refinement_never_raises_the_variability(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)) * 0.3
    x[20::30, 0] += 5
    frames = spark.createDataFrame([("r", 0, k, [float(v) for v in x[k]]) for k in range(600)], FRAME)
    f = spark.createDataFrame([("r", 0, 1, [1.0, 0.4, 0.0], 9.0), ("r", 0, 2, [0.0, 1.0, 0.0], 0.0)], "recording_id string, grid int, unit_uid long, filter array<double>, cov double")
    got = {r.unit_uid: r for r in D.refine_by_isi(frames, f, 4).collect()}
    assert set(got) == {1, 2} and got[1].cov < 0.05
    assert got[2].cov == 0.0 and list(got[2].filter) == [0.0, 1.0, 0.0]  # no round is better than the given 0


def test_a_recording_that_ends_before_the_batch_keeps_its_vectors(spark, tmp_path):
    from spikeloom import queries as Q

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 155")  # the second recording has 30 samples
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = Q.separation_update(spark, str(tmp_path)).where("recording_id = 'r1'").collect()
    assert {(r.unit, r.dim): r.w for r in rows} == {(u, k): float(u == k) for u in range(3) for k in range(64)}


def test_levels_near_a_tie_do_not_hang_on_the_order_of_sums(spark):
    from spikeloom import queries as Q

    # the exact level is 27.3621875; sums in different orders end on either side of it
    df = spark.createDataFrame([(27.362187499999997,), (27.3621875,), (27.362187500000004,), (27.3621874,)], "low double")
    assert [r.low for r in Q._settled(df, "low").collect()] == [27.362188] * 3 + [27.362187]
