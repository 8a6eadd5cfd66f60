"""Views of several units over the same and over overlapping ranges, met by blocks of samples."""

import numpy as np

from spikeloom.operators import windows as V


def test_units_share_ranges_that_cross_blocks(spark):
    rng, n = np.random.default_rng(8), 3000
    trains = [np.arange(60 + 40 * u, n, 90 + 7 * u) for u in range(3)]
    x = 0.1 * rng.standard_normal((n, 4))
    for u, at in enumerate(trains):
        x[at] += 3 * rng.standard_normal(4)
    samples = spark.createDataFrame([("a", 0, c, s, float(x[s, c])) for c in range(4) for s in range(n)], "recording_id string, grid int, channel int, sample long, value double")
    spikes = spark.createDataFrame([("a", 0, u, int(s)) for u, at in enumerate(trains) for s in at], "recording_id string, grid int, unit_uid int, sample long")
    ranges = [(0, 0, 1500), (1, 0, 1500), (2, 0, 1500), (1, 1000, 2600), (2, 2900, 3000)]
    views = spark.createDataFrame([("a", 0, *v) for v in ranges], "recording_id string, grid int, unit_uid int, start long, end long")
    flagged = spark.createDataFrame([("a", 2)], "recording_id string, unit_uid int")
    out = V.update_filter_window(samples, spikes, views, 1000.0, 16, flagged=flagged, peel_others=True, band=(20.0, 400.0, 2), block=256)
    got = {(r.unit_uid, r.start): r for r in out.collect()}
    assert got.keys() == {v[:2] for v in ranges}
    for u, start, end in ranges:
        others = [trains[v][(trains[v] >= start) & (trains[v] < end)] for v in (0, 1) if v != u]
        want = V.update_view(x[start:end], start, trains[u], 1000.0, 16, others, np.zeros(0, int), False, (20.0, 400.0, 2))
        r = got[u, start]
        assert r.changed == (want is not None) and (end - start > 200 or not r.changed)
        assert r.spikes == (trains[u] if want is None else want[1]).tolist()
        if want:
            np.testing.assert_allclose(r.pulse, want[0], atol=1e-9)
    # every row meets views by its block, and the signal meets ranges, not each of their units
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "start" in line and ">=" in line]
    assert joins and all("_b" in line for line in joins)
