"""Inputs on which an operator once did less than its whole job."""

import duckdb
import numpy as np

from spikeloom.llm import queries as Q
from spikeloom.llm import neighbors, suffixes, toxicity


def test_repeats_inside_a_later_document(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    line, short = word(70) + "\n", word(56) + "\n"
    frame = word(12) + "{}" + word(11)
    rows = [
        (1, word(90) + line + word(80)), (2, word(90) + line * 3 + word(80)), (3, line * 4), (4, word(60) + short), (5, (short + word(40)) * 2 + short * 5),
        (6, word(50) + short[:54] + word(50)), (7, (word(30) + frame.format(short[:54])) * 1 + word(33) + frame.format(short[:54]) * 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = db.sql(Q.OP8_SQL)
    assert sorted(map(tuple, suffixes.remove_repeats(docs).select(*want.columns).collect())) == sorted(want.fetchall())


def test_links_between_clusters_larger_than_lists(spark):
    rng = np.random.default_rng(4)
    a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    # two clusters 12.84 degrees apart, of which one vector each leans 1 degree towards the other: one link in 11.48 degrees
    turned = np.radians([0.0] * 299 + [1.0, 11.84] + [12.84] * 299)[:, None]
    ends = np.cos(turned) * a + np.sin(turned) * b + rng.normal(size=(600, 32)) * 1e-4
    x = np.vstack([ends, rng.normal(size=(50, 32))]).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbors.near_duplicates(rows, 0.98).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(1) - 1
    assert links[0] == 299 and links[299] == links[300] == 300
    assert got == {k: (links[k], 0 if k < 600 else k) for k in range(len(x))}


def test_exact_search_needs_no_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "HELD", 20_000)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(120, 16)), 4, axis=0) + rng.normal(size=(480, 16)) * 0.1
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    reps = spark.createDataFrame([(k, "x", bytearray(v.astype(np.float32).tobytes())) for k, v in enumerate(x)], "vec_id long, kind string, vec binary")
    got = {r.vec_id: r.component for r in neighbors.completed(reps, spark.createDataFrame([], "vec_id long, component long"), 0.98).collect()}
    want = {k: k for k in range(480)}
    near = u @ u.T >= 0.98
    for _ in range(480):
        now = {k: min(want[j] for j in np.flatnonzero(near[k])) for k in want}
        if now == want:
            break
        want = now
    assert got == {k: c for k, c in want.items() if near[k].sum() > 1} and len(set(got.values())) > 20


def test_toxicity_learns_from_long_documents(spark):
    filler = " ".join(f"word{k % 97}." for k in range(2500))
    rows = [(k, f"{filler} zorkvile {filler}" if k % 2 else "plain words only.") for k in range(60)]
    docs = spark.createDataFrame([*rows, (100, "a zorkvile thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model is not None and len(model["lexicon"])
    assert all(r.score >= 0.5 for r in toxicity.score(docs, model).where("doc_id % 2 = 1").collect())
