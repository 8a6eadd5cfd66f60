"""The conditional random field: marginals of long chains, neighbours as features."""

import numpy as np
import pyarrow as pa
import pytest

from spikeloom.llm import text as X
from spikeloom.llm import toxicity


@pytest.mark.parametrize("block", [1, 3, 7])
def test_blocks_of_a_chain_make_no_difference(monkeypatch, block):
    rng = np.random.default_rng(block)
    e, trans, begin = rng.normal(size=90) * 2, rng.normal(size=(3, 2)), rng.random(90) < 0.06
    begin[0] = True
    want = toxicity.marginals(e, begin, trans, True)
    monkeypatch.setattr(toxicity, "LONG", block)
    for x, y in zip(toxicity.marginals(e, begin, trans, True), want, strict=True):
        assert np.allclose(x, y)


def test_a_very_long_text_without_stops():
    rng = np.random.default_rng(2)
    e = rng.normal(size=200_000)
    p = toxicity.marginals(e, np.arange(len(e)) == 0, np.array([[0, -1.0], [0, 1.0], [0, -2.0]]))
    assert ((p > 0) & (p < 1)).all()


def test_expected_counts_are_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(3)
    e, trans, begin = rng.normal(size=6), rng.normal(size=(3, 2)), np.array([1, 0, 0, 1, 0, 0], bool)

    def log_total(e, trans):
        out = 0
        for lo, hi in ((0, 3), (3, 6)):
            scores = []
            for bits in range(8):
                y = [bits >> k & 1 for k in range(3)]
                scores.append(trans[2, y[0]] + sum(e[lo + k] * y[k] for k in range(3)) + sum(trans[y[k - 1], y[k]] for k in range(1, 3)))
            out += np.log(np.exp(scores).sum())
        return out

    p, xi, start = toxicity.marginals(e, begin, trans, True)
    for k in range(6):
        d = np.eye(6)[k] * 1e-5
        assert np.isclose((log_total(e + d, trans) - log_total(e - d, trans)) / 2e-5, p[k], atol=1e-6)
    for a in range(3):
        for b in range(2):
            d = np.zeros((3, 2))
            d[a, b] = 1e-5
            assert np.isclose((log_total(e, trans + d) - log_total(e, trans - d)) / 2e-5, (start if a == 2 else xi[a])[b], atol=1e-6)


def test_neighbours_are_features_inside_a_sentence():
    w, h, begin = toxicity.tokens(next(X.slices(pa.array(["one two three. four"]))))
    keys = np.sort(h[0])
    order = np.argsort(h[0])
    of = lambda v: np.array(v, float)[order]
    model = {"keys": keys, "weights": of([1, 2, 3, 4]), "other": -9.0, "stems": np.zeros(0, np.uint64), "stem_weights": np.zeros(0), "before": of([10, 20, 30, 40]), "after": of([100, 200, 300, 400])}
    assert toxicity.emissions(h, begin, model).tolist() == [1 + 200, 2 + 10 + 300, 3 + 20, 4]
