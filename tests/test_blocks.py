"""Steps over packed blocks: vectors are made once, and what blocks tell gives the peaks of the whole series."""

import numpy as np
import pytest

from spikeloom.operators import decompose as D
from spikeloom.operators import units as U
from spikeloom.operators import windows as V

FRAME = "recording_id string, grid int, sample long, x array<double>"


def counted(spark, n=300):
    """Vectors of two recordings, and how often one of them was made."""
    rng, made = np.random.default_rng(5), spark.sparkContext.accumulator(0)
    rows = [(rec, 0, k, [float(v) for v in rng.normal(size=3) + 4 * (k % 20 == 7)]) for rec in "ab" for k in range(n)]

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    return spark.createDataFrame(rows, FRAME).mapInPandas(count, FRAME), made, len(rows)


def test_windows_in_step_make_their_vectors_once(spark):
    frames, made, n = counted(spark)
    assert V.fit_units_distributed(frames, V.Fit(100.0, niter=1, updates=1, sil=-1.0, apart=0.03)).count() == 2
    assert made.value == n


def test_refinement_makes_its_vectors_once(spark):
    frames, made, n = counted(spark)
    filters = spark.createDataFrame([(rec, 0, u, [1.0, 0.5, 0.1 * u]) for rec in "ab" for u in range(2)], "recording_id string, grid int, unit_uid int, filter array<double>")
    assert D.refine_by_isi(frames, filters, 3).count() == 4
    assert made.value == n


@pytest.mark.parametrize("distance", [1, 3, 9])
@pytest.mark.parametrize("levels", [3, 1000])
def test_blocks_give_the_peaks_of_the_series(distance, levels):
    for seed in range(60):
        rng = np.random.default_rng(seed)
        v = np.repeat(rng.integers(0, levels, 40), rng.integers(1, 12, 40)).astype(float)
        if seed % 3 == 0:
            v = np.sort(v)[np.r_[0 : len(v) : 2, len(v) - 1 : 0 : -2]] + rng.random(len(v)) * (levels > 3)
        at = np.arange(len(v))
        for block in (1, 2, 7, 50, 1000):
            told = [U.block_peaks(at[at // block == b], v[at // block == b], distance) for b in range(at[-1] // block + 1)]
            got, height = U.series_peaks(*(np.concatenate([t[c] for t in told]) for c in ("at", "value", "a", "b", "level", "end")), np.array([len(t["a"]) for t in told]), distance)
            assert np.array_equal(got, U.peaks_1d(v, distance)) and np.array_equal(height, v[got])


def test_spikes_and_sums_of_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3)).round(1)
    frames = spark.createDataFrame([("r", 0, k, [float(v) for v in r]) for k, r in enumerate(x)], FRAME)
    w = {"u": np.array([1.0, 0.3, -0.2]), "v": np.array([0.0, 1.0, 1.0])}
    filters = spark.createDataFrame([("r", 0, u, f.tolist()) for u, f in w.items()], "recording_id string, grid int, unit_uid string, filter array<double>")
    blocks = D.packed(frames, 16)
    found = U.stored(D.unit_spikes(blocks, filters, 4))
    sums = {r.unit_uid: r.filter for r in D.spike_sums(blocks, found, 16).collect()}
    rows = {r.unit_uid: r for r in found.collect()}
    for u, f in w.items():
        spikes, sil = V.spikes_of(V.squared((x @ np.stack(list(w.values())).T)[:, list(w).index(u)]), 4)
        assert rows[u].spikes == spikes.tolist() and abs(rows[u].sil - sil) < 1e-9 and abs(rows[u].cov - U.variability(spikes)) < 1e-12
        assert np.allclose(sums[u], x[spikes].sum(0))
