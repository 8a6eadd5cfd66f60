"""The network's pooling against a naive loop, its gradients against differences, learning on whole texts."""

import numpy as np
import pyarrow as pa

from spikeloom.llm import quality
from spikeloom.llm import text as X


def naive(data, tables, bias):
    """Mean and maximum over chunks of two hops, filter by filter, byte by byte."""
    positions = max(1, -(-len(data) // quality.STRIDE))
    padded = data + bytes(quality.WIDTH + quality.STRIDE)
    r = [sum(tables[j][padded[p * quality.STRIDE + j]] for j in range(quality.WIDTH)) for p in range(positions)]
    hops = [np.maximum(np.max(r[k : k + quality.HOP], axis=0) + bias, 0) for k in range(0, positions, quality.HOP)]
    chunks = [np.maximum(h, hops[min(k + 1, len(hops) - 1)]) for k, h in enumerate(hops)]
    return np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])


def test_pooling_is_the_naive_loop(monkeypatch):
    rng = np.random.default_rng(3)
    tables, bias = rng.normal(size=(quality.WIDTH, 256, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32)
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 2, 7, 127, 128, 129, 130, 600, 5000)]
    alone = [quality.pooled(*quality.layout(next(X.slices(pa.array([t], pa.binary())))), tables, bias)[0] for t in texts]
    for t, got in zip(texts, alone, strict=True):
        assert np.allclose(got, naive(t, tables, bias), atol=1e-4)
    at_once = quality.pooled(*quality.layout(next(X.slices(pa.array(texts, pa.binary())))), tables, bias)
    monkeypatch.setattr(quality, "AT_ONCE", 100)
    assert np.allclose(quality.pooled(*quality.layout(next(X.slices(pa.array(texts, pa.binary())))), tables, bias), at_once)
    assert np.allclose(at_once, alone)


def test_gradients_are_differences():
    rng = np.random.default_rng(4)
    p = {"e": rng.normal(0, 0.5, (256, 3)), "k": rng.normal(0, 0.3, (quality.WIDTH, 3, 2)), "c": rng.normal(0, 0.3, 2), "w": rng.normal(0, 1, 4), "b": np.array([0.1])}
    texts, y, share = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (40, 300, 700)], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = quality.gradients(p, texts, y, share)
    for k in p:
        flat = np.argsort(-np.abs(g[k]).ravel())[:3]
        for at in flat:
            q = {n: a.copy() for n, a in p.items()}
            step = 1e-3
            q[k].ravel()[at] += step
            up = quality.gradients(q, texts, y, share)[0]
            q[k].ravel()[at] -= 2 * step
            down = quality.gradients(q, texts, y, share)[0]
            assert abs((up - down) / (2 * step) - g[k].ravel()[at]) < 0.02 * abs(g[k].ravel()[at]) + 2e-4, k


def test_it_learns_from_what_stands_anywhere_in_a_long_text(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows = [(k, word(900) + " zqzqzqzq xjxjxjxj " + word(900) if k % 2 else word(1800)) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    out = quality.quality(docs, labels).where("held_out").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in out]) > 0.9


def test_steps_hold_all_texts():
    sizes = np.array([10, quality.STEP_BYTES * 3, 20] + [100] * 200)
    got = list(quality.steps(np.arange(len(sizes)), sizes))
    assert np.concatenate(got).tolist() == list(range(len(sizes))) and all(len(g) == 1 or sizes[g].sum() <= quality.STEP_BYTES for g in got)
