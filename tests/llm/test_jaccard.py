"""The n-gram join on dense groups, long unrelated texts, tiles and mixed sizes, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.llm import jaccard
from test_brute import shingle_components


def words(rng, n, vocabulary=5000):
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


def changed(rng, w, n):
    w = list(w)
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"x{rng.integers(1 << 30)}"
    return w


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    out = []
    base = words(rng, 200)
    out += [changed(rng, base, int(rng.integers(0, 5))) for _ in range(60)]  # a dense group
    chain = words(rng, 150)
    for _ in range(12):  # each links with the next ones only
        out.append(chain)
        chain = changed(rng, chain, 3)
    passage = words(rng, 60)
    out += [passage + words(rng, int(rng.integers(20, 60))) for _ in range(60)]  # a passage that many share
    out += [passage + words(rng, 6) for _ in range(10)]
    out += [words(rng, 40), [], ["one"], ["one"], ["one", "two"]]
    return [(k, " ".join(w)) for k, w in enumerate(out)] + [(None, "a b c d e f g")]


@pytest.mark.parametrize("sizes", [None, (6, 4)])
def test_whole_join(spark, texts, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(jaccard, "TILE", sizes[0]), monkeypatch.setattr(jaccard, "COUNTED", sizes[1])
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    comp, sets, links = shingle_components([r for r in docs.collect() if r.doc_id is not None], 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs, 4, 80).collect()}
    assert max(links.values()) > 50 and len(set(comp.values())) > 20
    assert got == {d: (len(sets[d]), comp[d], links[d]) for d in sets} | {None: (4, None, 0)}


def test_long_unrelated_texts_are_no_candidates(spark):
    rng = np.random.default_rng(9)
    shared = " ".join(words(rng, 40))
    docs = spark.createDataFrame([(k, shared + " " + " ".join(words(rng, 4000))) for k in range(250)], "doc_id long, text string")
    first = jaccard.saved(jaccard.signatures(docs, 5, 80, np.zeros(0, np.uint64)))
    held = jaccard.blocks(first)
    rows = held.withColumn("side", F.lit(2)).withColumn("comp", F.col("doc_id")).join(first.select("doc_id", "n", "counts"), "doc_id")
    assert held.count() >= 250
    assert jaccard.candidates(rows, 80, False).count() == 0


def test_sizes_and_groups():
    assert [jaccard.groups_of(n) for n in (1, 32, 33, 64, 65, 4000, 10**6)] == [16, 16, 32, 32, 64, 2048, 65536]
    x = np.full((1, 64), 255, np.uint8)
    assert (jaccard.folded(x, 16) == jaccard.OPEN).all()
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 2, 50)]
    assert jaccard.linked(sets, 85, 64).tolist() == [[False, True, False], [True, False, False], [False, False, False]]
