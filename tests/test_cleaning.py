"""Values that are no numbers, and waveforms that are taken out block by block."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spikeloom.operators import decompose as D


def test_sql_of_sanitize_values_knows_what_is_not_finite_in_any_channel(spark, tmp_path):
    odd = [float("nan"), float("inf"), float("-inf"), -1e-8, 0.25, None]
    rows = [(i, [odd[(i + k) % 6] for k in range(6)], 0) for i in range(6)] + [(6, None, 0)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    got = entry.queries()["sanitize_values"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
        want = con.execute(entry.oracle_sql()["sanitize_values"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_peel_off_over_borders_of_blocks(spark):
    rng, n, r, nan = np.random.default_rng(5), 300, 3, float("nan")
    value = rng.standard_normal((2, n)).tolist()
    value[0][41], value[1][90] = None, nan
    missing = {(0, 64), (1, 127)}
    samples = spark.createDataFrame([("a", 0, c, s, value[c][s], "kept") for c in range(2) for s in range(n) if (c, s) not in missing], "recording_id string, grid int, channel int, sample long, value double, note string")
    at = {"u": [1, 40, 62, 64, 64, 66, 127, 192, 298], "v": [30, 91, 128, 191]}
    spikes = spark.createDataFrame([("a", u, s) for u, ss in at.items() for s in ss], "recording_id string, unit_uid string, sample long")
    totals = spark.createDataFrame([("a", n)], "recording_id string, total_samples long")
    want = {}
    for c in range(2):
        minus = np.zeros(n)
        for ss in at.values():
            fit = [s for s in ss if r <= s < n - r]
            for k in range(-r, r + 1):
                there = [value[c][s + k] for s in fit if (c, s + k) not in missing and value[c][s + k] is not None]
                for s in fit:
                    minus[s + k] += np.mean(there) if there else 0.0
        want |= {(c, s): None if value[c][s] is None else value[c][s] - minus[s] for s in range(n) if (c, s) not in missing}
    out = D.peel_off(samples, spikes, r, totals, block=64)
    got = {(x.channel, x.sample): x.value for x in out.collect() if x.note == "kept"}
    assert got.keys() == want.keys()
    assert {k for k in got if got[k] is None} == {(0, 41)}
    assert {k for k in got if got[k] is not None and np.isnan(got[k])} == {k for k in want if want[k] is not None and np.isnan(want[k])} != set()
    np.testing.assert_allclose([got[k] for k in want if want[k] is not None], [w for w in want.values() if w is not None], atol=1e-12)


def test_peel_off_lays_nothing_out_beside_the_spikes(spark):
    """Spikes are few bytes and meet in one task, which must not hold sums of each channel at each sample near one."""
    samples = spark.createDataFrame([("a", 0, 0, k, 1.0) for k in range(20)], "recording_id string, grid int, channel int, sample long, value double")
    spikes = samples.select("recording_id", F.col("channel").alias("unit_uid"), "sample")
    plan = D.peel_off(samples, spikes, 2, spikes.groupBy("recording_id").agg(F.max("sample").alias("total_samples")))._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[(.*?)\]", plan)
    assert keys and not [k for k in keys if "channel" in k and "unit_uid" not in k]
