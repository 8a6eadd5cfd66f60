"""Features against a naive count, the pairwise machines on data that can be separated."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spikeloom.llm import langid
from spikeloom.llm import text as X


def naive(text):
    b = text.encode().lower() if text.isascii() else bytes(langid.X.LOWER[np.frombuffer(text.encode(), np.uint8)])
    count = Counter()
    for k in range(len(b)):
        if k + 1 < len(b):
            two = (b[k] * 2654435761 + b[k + 1] * 2246822519) % 2**32
            count[(two * 668265263) % 2**32 >> 20] += 1
            if k + 2 < len(b):
                count[((two + b[k + 2] * 3266489917) * 374761393) % 2**32 >> 20] += 1
    v = np.zeros(langid.FEATURES)
    for k, n in count.items():
        v[k] = np.log1p(n)
    return v / max(np.linalg.norm(v), 1e-9)


@pytest.mark.parametrize("piece", [1 << 20, 5, 1])
def test_features_are_the_naive_count(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    texts = ["Ab", "", "x", "the QUICK brown fox, the lazy dog", "Ünïcødé und mehr", None, "abcabcabc"]
    got = np.vstack([langid.features(s) for s in X.slices(pa.array(texts))])
    assert np.allclose(got, [naive(t or "") for t in texts], atol=1e-6)


def test_family_first_then_pairs():
    rng = np.random.default_rng(1)
    langs = [x for x in ("de", "en", "fr", "es", "ja") for _ in range(30)]
    centre = {x: rng.normal(size=20) for x in set(langs)}
    x = np.array([centre[v] + rng.normal(size=20) * 0.2 for v in langs], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.fit(x, langs)
    assert sorted(model["fams"]) == ["germanic", "ja", "romance"] and sorted(model["pairs"]) == [("de", "en"), ("es", "fr")]
    pick, score = langid.predict(model, x)
    assert (pick == np.array(langs)).all() and ((score > 0) & (score <= 1)).all()
