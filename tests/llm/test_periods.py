"""Periodic runs against the definition, on random, periodic and planted texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from spikeloom.llm import periods
from spikeloom.llm import queries as Q

SCHEMA = "doc_id long, text string, start long, n_runs string"


def brute(w, least=1):
    """(start, end, period) of the maximal runs of a sequence, distance by distance."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, 4 * q) and not any(q % d == 0 and all(w[x] == w[x + d] for x in range(s, e - d)) for d in range(1, q)):
                out.append((s, e, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, rewrite):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "", re.ASCII)
    h = zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    r = [(s, e - s, q) for s, e, q in brute(w, 6)]
    best = max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
    gone = {i for s, n, q in r for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(r), *best, 1000 * best[1] // best[2] if r else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in r)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sample(r):
    n, k = r.randint(0, 120), r.choice([1, 2, 2, 3, 5, 50])
    w = [r.randrange(k) for _ in range(n)]
    if r.random() < 0.6 and n:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 10)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if r.random() < 0.4:
        w *= r.randint(1, 6)
    if r.random() < 0.3 and w:
        w[r.randrange(len(w))] = 99
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    r = random.Random(seed)
    for _ in range(60):
        docs = [sample(r) for _ in range(r.randint(1, 5))]
        last = np.cumsum([len(d) for d in docs])
        first = np.append(0, last[:-1])
        got = zip(*(x.tolist() for x in periods.runs(np.array([x for d in docs for x in d], np.int64), first, last)), strict=True)
        assert list(got) == [(s + f, e + f, q) for d, f in zip(docs, first.tolist(), strict=True) for s, e, q in brute(d)]


def test_nested_powers():
    w = ([0] * 9 + [1] * 4) * 5 + ([0, 1, 0, 1, 0, 1, 0, 1, 2] * 4) * 4
    got = list(zip(*(x.tolist() for x in periods.runs(np.array(w), np.array([0]), np.array([len(w)]))), strict=True))
    assert got == brute(w) and {q for _, _, q in got} >= {1, 2, 9, 13}


def test_mistaken_hashes_are_seen():
    ids = np.array([5, 1, 2, 1, 2, 1, 2, 1, 2, 7])
    assert periods.exact(ids, 3, 2, 0, 10, 0, 10) == (1, 9)
    assert periods.exact(ids, 8, 1, 7, 10, 0, 10) == (8, 8)


def test_long_period():
    unit = np.random.default_rng(3).integers(0, 50, 70_001)
    ids = np.concatenate([[9], np.tile(unit, 5)[:-3], [51, 52]])
    found = list(zip(*(x.tolist() for x in periods.runs(ids, np.array([0]), np.array([len(ids)]))), strict=True))
    want = 1 if ids[0] != unit[-1] else 0
    assert (want, len(ids) - 2, 70_001) in found


def test_documents(spark):
    r = random.Random(8)
    rows = [(k, " ".join(f"w{x}é" for x in sample(r)), 0, "x") for k in range(300)]
    rows += [(900, None, 0, "x"), (901, "", 0, "x"), (902, " \x0b\n", 0, "x"), (None, "a a a a a a", 0, "x"), (3, "b\tb\nb b b b \x0cb", 0, "x"), (3, "b\tb\nb b b b \x0cb", 0, "x"), (903, "a b c " * 60_000, 0, "x"), (904, "x x x x x", 0, "x"), (905, "Q\xa0Q Q Q Q Q Q", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    short = [x for x in rows if len(x[1] or "") < 10_000]
    for rewrite in (False, True):
        got = [tuple(x) for x in periods.periodic_runs(df, rewrite).collect()]
        key = lambda x: (x[0] is None, x)
        assert sorted((x for x in got if x[0] != 903), key=key) == sorted((expected(d, t, rewrite) for d, t, *_ in short), key=key)
        assert rewrite or next(x for x in got if x[0] == 903)[1:6] == (1, 0, 180_000, 3, 60_000_000)
    full = periods.periodic_runs(df, with_text=True).where("doc_id is null").first()
    assert full.collapsed == b"a" and [tuple(r) for r in full.runs] == [(0, 6, 1)]
    assert periods.periodic_runs(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [x for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(x.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in Q.op13_periodic_runs(spark, sf).collect()}
    for d in docs:
        assert got[d.doc_id] == expected(d.doc_id, d.text, True)
