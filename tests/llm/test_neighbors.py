"""Neighbour search on tight groups, saturated lists and several labels, against brute force."""

import numpy as np
import pytest

from spikeloom.llm import neighbors
from spikeloom.llm import text as X
from test_brute import least, table


def brute(ids, x, labels, threshold=0.98):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links, pairs = dict.fromkeys(ids, 0), []
    for label in set(labels):
        at = np.flatnonzero(np.array(labels) == label)
        a, b = np.nonzero(np.triu(u[at] @ u[at].T >= threshold, 1))
        for i, j in zip(at[a].tolist(), at[b].tolist(), strict=True):
            links[ids[i]] += 1
            links[ids[j]] += 1
        pairs += list(zip(at[a].tolist(), at[b].tolist(), strict=True))
    comp = least([(ids[i], ids[j]) for i, j in pairs], ids)
    return {k: (links[k], comp[k], comp[k] == k) for k in ids}


def run(spark, ids, x, labels):
    rows = spark.createDataFrame([(k, v.tolist(), b) for k, v, b in zip(ids, x.astype(np.float32), labels, strict=True)], "vec_id long, embedding array<float>, label string")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbors.near_duplicates(rows).collect()}


@pytest.mark.parametrize("spread", [0.0005, 0.012])
def test_a_tight_group_larger_than_lists_and_blocks(spark, spread):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=48)
    centre /= np.linalg.norm(centre)
    x = np.vstack([centre + rng.normal(size=(2000, 48)) * spread, rng.normal(size=(1000, 48))])
    ids, labels = list(range(3000)), ["a"] * 3000
    want = brute(ids, x, labels)
    if spread < 0.001:
        assert want[0] == (1999, 0, True)
    assert run(spark, ids, x, labels) == want


def test_labels_keep_apart(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(60, 24)), 10, axis=0) + rng.normal(size=(600, 24)) * rng.choice([0.01, 0.1, 0.14], 600)[:, None]
    ids, labels = rng.permutation(600).tolist(), [str(k) for k in rng.integers(0, 3, 600)]
    assert run(spark, ids, x, labels) == brute(ids, x, labels)


def test_whole_given_table(spark):
    rows = table(spark, "embeddings", "/root/testdata/sf0.01")
    good = [r for r in rows if r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    want = {r.vec_id: (0, r.vec_id, True) for r in rows} | brute([r.vec_id for r in good], np.array([r.embedding for r in good]), [r.label for r in good])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbors.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()}
    assert got == want


def test_recall_sees_lost_links(spark):
    x = np.tile(np.eye(8, dtype=np.float32)[:4], (25, 1)) + np.random.default_rng(1).normal(size=(100, 8)).astype(np.float32) * 1e-3
    reps = spark.createDataFrame([(k, "x", bytearray(v.tobytes())) for k, v in enumerate(x)], "vec_id long, kind string, vec binary")
    comp = [(k, k % 4) for k in range(100)]
    assert neighbors.recall(reps, spark.createDataFrame(comp, "vec_id long, component long"), 0.98) == {"x": (2400, 2400)}
    split = [(k, k % 8) for k in range(100)]
    links, found = neighbors.recall(reps, spark.createDataFrame(split, "vec_id long, component long"), 0.98)["x"]
    assert links == 2400 and found < 0.6 * links


def test_the_result_comes_from_the_lists(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(100, 24)), 6, axis=0) + rng.normal(size=(600, 24)) * rng.choice([0.01, 0.1, 0.13], 600)[:, None]
    ids, labels = list(range(600)), ["a"] * 600
    want = brute(ids, x, labels)
    monkeypatch.setattr(neighbors, "completed", lambda *_: pytest.fail("lists were enough before"))
    assert run(spark, ids, x, labels) == want
    none = spark.createDataFrame([], "u long, v long, sim double")
    monkeypatch.setattr(neighbors, "first_lists", lambda *_: none)
    monkeypatch.setattr(neighbors, "recall", lambda *_: {})
    assert all(n == 0 for n, _, _ in run(spark, ids, x, labels).values())  # without lists nothing is found


def test_a_label_that_fails_its_audit_is_searched_exactly(spark, monkeypatch):
    x = np.repeat(np.eye(8), 3, axis=0) + np.random.default_rng(2).normal(size=(24, 8)) * 0.01
    ids, labels = list(range(24)), ["a" if k < 12 else "b" for k in range(24)]
    lists = neighbors.first_lists
    monkeypatch.setattr(neighbors, "first_lists", lambda reps, *how: lists(reps.where("kind = 'a/8'"), *how))
    rows = spark.createDataFrame([(k, v.tolist(), b) for k, v, b in zip(ids, x.astype(np.float32), labels, strict=True)], "vec_id long, embedding array<float>, label string")
    got = neighbors.near_duplicates(rows).collect()
    assert {r.vec_id: r.search for r in got} == {k: "lists" if k < 12 else "exact" for k in ids}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(ids, x, labels)


def test_groups_stay_whole_across_batches():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(3).integers(0, 40, 5000))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 70]), pa.array(np.arange(k, min(k + 70, 5000)))], ["key", "row"]) for k in range(0, 5000, 70)]
    for rows, size in ((1, 1 << 25), (100, 1 << 25), (10_000, 1 << 25), (10_000, 5000)):
        got = list(X.whole_groups(iter(batches), "key", rows, size))
        seen = [set(t.column("key").to_pylist()) for t in got]
        assert sum(map(len, seen)) == len(set().union(*seen)) and [r for t in got for r in t.column("row").to_pylist()] == list(range(5000))
