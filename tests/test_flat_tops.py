"""Queries over tables whose neighbours are often equal, or longer than the given ones, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import rows

from spikeloom import queries as Q
from spikeloom.operators import units


@pytest.mark.parametrize("name", ["local_maxima", "find_peaks", "bounded_spike_detect", "centroid_update", "add_spikes_in_roi", "add_artifacts_in_roi"])
def test_flat_tops_as_in_sql(spark, tmp_path, name):
    rng = np.random.default_rng(11)
    at = 1_704_067_200 + np.sort(rng.choice(2_000_000, 400, replace=False))
    cols = {"event_id": range(400), "ts": pa.array(at * 1_000_000, pa.timestamp("us")), "user_id": rng.integers(0, 5, 400), "event_type": ["a"] * 400, "value": rng.integers(20, 24, 400) * 1.0, "props": [""] * 400}
    pq.write_table(pa.table(cols), tmp_path / "events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert rows(Q.queries()[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(Q.oracle_sql()[name]).df())


def test_wide_lines_as_in_sql(spark, tmp_path):
    """Lines are taken out with 2 % of all frequencies on both sides, also where these are more than 200."""
    x = np.random.default_rng(12).normal(size=(10_300, 1)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": range(len(x)), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": [0] * len(x)}), tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert rows(Q.queries()["spectral_notch"](spark, str(tmp_path)).toPandas()) == rows(c.sql(Q.oracle_sql()["spectral_notch"]).df())


@pytest.mark.parametrize("block", [1, 7, 65_536])
def test_pulses_are_laid_out_without_a_shuffle_of_samples(spark, block):
    at = {("a", 1): [0, 3, 3, 9], ("a", 2): [5], ("a", 3): [-2, 12], ("b", 1): [19], ("c", 1): [0]}
    s = spark.createDataFrame([(*u, x) for u, t in at.items() for x in t], "recording_id string, unit_uid long, sample long")
    n = {"a": 10, "b": 20, "c": 1}
    out = units.pulse_from_spikes(s, spark.createDataFrame(list(n.items()), "recording_id string, total_samples long"), block)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted((r, u, k, float(k in t)) for (r, u), t in at.items() for k in range(n[r]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("Generate explode")[:1] if "Exchange" in x]
