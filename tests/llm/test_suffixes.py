"""Suffix arrays: byte order, merge scans, levels kept between batches, windows verified."""

import duckdb
import numpy as np

from spikeloom.llm import queries as Q
from spikeloom.llm import suffixes


def columns(texts, at):
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    c = dict(zip(suffixes.WORDS, suffixes.first_bytes(buf, np.array(at)), strict=True))
    n = len(at)
    return c | {"around": np.arange(n, dtype=np.uint64), "doc": np.arange(n), "pos": np.array(at, np.int64)}


def test_arrays_are_in_byte_order_and_survive_packing():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("ab"), 400)) + "".join(rng.choice(list("abcdeé"), 400))
    at = list(range(700))
    a = suffixes.Array(columns([text], at))
    raw = text.encode()
    assert [raw[p : p + 20] for p in a.c["pos"]] == sorted(raw[p : p + 20] for p in at)
    lcp = suffixes.common_prefix(a.c)
    for k in range(1, 700):
        x, y = raw[a.c["pos"][k - 1] :][:20], raw[a.c["pos"][k] :][:20]
        assert lcp[k] == next((i for i in range(20) if x[i] != y[i]), 20)
    back = suffixes.unpack(*suffixes.pack(a.c))
    assert all((back[k] == a.c[k]).all() for k in suffixes.ENTRY.names)


def test_levels_tell_what_one_array_tells():
    rng = np.random.default_rng(2)
    n = 3000
    words = {k: rng.integers(0, 6, n).astype(suffixes.ENTRY[k]) for k in suffixes.WORDS}
    c = words | {"around": rng.integers(0, 3, n).astype(np.uint64), "doc": rng.integers(0, 500, n), "pos": np.arange(n)}
    whole, parts = suffixes.Levels(), suffixes.Levels()
    whole.add(suffixes.Array(c))
    for lo in range(0, n, 170):
        parts.add(suffixes.Array({k: x[lo : lo + 170] for k, x in c.items()}))
    assert len(parts.levels) > 1
    sizes = [len(a) for a in parts.levels]
    assert sizes == sorted(sizes, reverse=True)

    def told(family):
        rows = [dict(zip(e["pos"].tolist(), zip(same.tolist(), (part | same).tolist(), strict=True), strict=True)) for e, same, part in family.found()]
        return {k: v for r in rows for k, v in r.items()}

    one, many = told(whole), told(parts)
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in many.items()}
    assert all(many[k][1] for k in one if one[k][1])


def test_a_second_batch_finds_matches_in_kept_levels(spark, tmp_path):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    shared, twice = word(90), word(64)
    batches = [
        [(1, word(80) + shared + word(60)), (2, word(100)), (3, None)],
        [(4, shared + word(70)), (5, word(40) + twice + word(40)), (6, "")],
        [(7, word(30) + twice + word(20) + shared[10:75]), (8, word(200)), (9, shared + twice)],
    ]
    got, before = {}, None
    for rows in batches:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for r in suffixes.remove_repeats(docs, levels=f"file://{tmp_path}/levels", earlier=before).collect():
            got[r.doc_id] = r
        before = docs if before is None else before.union(docs)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r for b in batches for r in b])
    want = db.sql(Q.OP8_SQL)
    assert sorted(tuple(got[k][c] for c in want.columns) for k in got) == sorted(want.fetchall())
    assert got[4].n_removed == 90 and got[9].n_removed == 154
