"""Filters by blocks against the same filters of whole channels and against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.operators import series as B
from spikeloom.operators import signals as S

SCHEMA = "recording_id string, grid int, channel int, sample long, value double"


def made(spark, xs, start=0):
    rows = [(r, 0, c, start + k, float(v)) for (r, c), x in xs.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def back(df):
    out = {}
    for r in df.orderBy("recording_id", "channel", "sample").collect():
        out.setdefault((r.recording_id, r.channel), []).append(r.value)
    return out


def slow(x, sections):
    """Forward and backward, sample by sample."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = [2 * x[0] - v for v in x[pad:0:-1]] + list(x) + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]] if pad else list(x)
    for _ in range(2):
        for b, a in sections:
            z1, z2, out = -b[0] * y[0], b[2] * y[0], []
            for u in y:
                v = b[0] * u + z1
                z1, z2 = b[1] * u - a[1] * v + z2, b[2] * u - a[2] * v
                out.append(v)
            y = out
        y = y[::-1]
    return y[pad : len(y) - pad]


def test_a_section_goes_on_where_it_stopped():
    b, a = S.butterworth_bandpass(2, 20.0, 90.0, 400.0)[0]
    x = np.random.default_rng(0).normal(size=1000)
    whole, end = B.advance(x, b, a, np.array([0.3, -0.2]))
    for cut in (1, 255, 256, 257, 700):
        first, z = B.advance(x[:cut], b, a, np.array([0.3, -0.2]))
        rest, last = B.advance(x[cut:], b, a, z)
        assert np.allclose(np.append(first, rest), whole, atol=1e-12) and np.allclose(last, end, atol=1e-12)


@pytest.mark.parametrize(("block", "fan"), [(16, 2), (64, 3), (100_000, 1024)])
def test_bandpass_by_blocks(spark, block, fan):
    rng = np.random.default_rng(1)
    xs = {("a", 0): rng.normal(size=333) + 5, ("a", 1): np.cumsum(rng.normal(size=333)), ("b", 0): rng.normal(size=9), ("c", 0): [3.0], ("d", 0): rng.normal(size=16)}
    sections = S.butterworth_bandpass(3, 20.0, 90.0, 400.0)
    df = made(spark, xs, 1013)
    got = back(B.filtered(df, sections, block, fan))
    assert got.keys() == xs.keys()
    for k, x in xs.items():
        assert np.allclose(got[k], slow(list(x), sections), atol=1e-9)
        assert np.allclose(got[k], S.filtfilt(np.asarray(x, float), sections), atol=1e-9)


def test_bandpass_modes_agree(spark):
    df = made(spark, {("a", 0): np.random.default_rng(2).normal(size=500)})
    one, many = (back(S.bandpass(df, 1000.0, block=k)) for k in (None, 128))
    assert np.allclose(one["a", 0], many["a", 0], atol=1e-9)
    assert S.bandpass(df.limit(0), 1000.0).count() == 0


@pytest.mark.parametrize("n", [2, 7, 64, 97, 300])
def test_transform_of_any_length(spark, n):
    rng = np.random.default_rng(n)
    z = rng.normal(size=n) + 1j * rng.normal(size=n)
    df = spark.createDataFrame([("a", 0, 0, n, k, float(v.real), float(v.imag)) for k, v in enumerate(z) if k % 5 != 3], "recording_id string, grid int, channel int, n long, pos long, re double, im double")

    def finish(key, n, k, v):
        import pandas as pd

        return pd.DataFrame({"k": k, "re": v.real, "im": v.imag})

    got = B.dft(df, finish, "k long, re double, im double", cells=32).orderBy("k").collect()
    z[3::5] = 0
    want = np.fft.fft(z)
    assert [r.k for r in got] == list(range(n))
    assert np.allclose([r.re + 1j * r.im for r in got], want, atol=1e-9)


def lines(n, fs, rng):
    t = np.arange(n) / fs
    return rng.normal(size=n) + 4 * np.sin(2 * np.pi * 50 * t + 0.4) + 3 * np.sin(2 * np.pi * 21.5 * t)


def test_notch_removes_lines_and_only_them(spark):
    fs, n = 200.0, 2000
    rng = np.random.default_rng(5)
    x = lines(n, fs, rng)
    got = np.array(back(S.spectral_notch(made(spark, {("a", 0): x}), fs))["a", 0])
    before, after = np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(got))
    at = lambda f: int(f * n / fs)
    assert after[at(50)] < 1e-6 < before[at(50)] / 1e6 and after[at(21.5)] < 1e-6
    reach = int(np.floor(round(4 * n / fs) / 2))
    far = np.ones(len(before), bool)
    for f in (50, 21.5):
        far[at(f) - 2 * reach : at(f) + 2 * reach + 1] = False
    far[0] = False
    assert np.allclose(after[far], before[far], atol=1e-8)


@pytest.mark.parametrize("n", [997, 1000])
def test_distributed_notch_equals_one_task(spark, n):
    rng = np.random.default_rng(n)
    xs = {("a", 0): lines(n, 100.0, rng), ("a", 1): rng.normal(size=n), ("b", 0): lines(300, 100.0, rng)}
    df = made(spark, xs, 11)
    one, many = (back(S.spectral_notch(df, 100.0, block=k, cells=256)) for k in (100_000, 500))
    assert one.keys() == many.keys() == xs.keys()
    for k in xs:
        assert np.allclose(one[k], many[k], atol=1e-8)
    assert not np.allclose(one["a", 0], xs["a", 0], atol=0.1)


def test_long_channels_without_gaps_only(spark):
    df = made(spark, {("a", 0): np.arange(50.0)}).where(F.col("sample") != 20)
    with pytest.raises(Exception, match="gaps"):
        S.spectral_notch(df, 10.0, block=20).collect()
