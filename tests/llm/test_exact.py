"""Grace hash deduplication against plain Python: one level, many levels, and hashes that meet."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spikeloom.llm import exact

SCHEMA = "doc_id long, text string, h long, content string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(1, None, 0, "x"), (2, "", 0, "x"), (3, " \t\x0b\x0c\r\n", 0, "x"), (4, "a\xa0b", 0, None), (5, "ab", 0, "x"), (5, "ab", 0, "x"), (None, "a b", 0, "x"), (None, "a  b", 0, "x"), (6, "é \U0001f600", 0, "x"), (7, "é\U0001f600", 0, "x"), (8, "long " * 40_000, 0, "x"), (9, "long" * 40_000, 0, "x")]
    for k in range(10, 1500):
        kind = r.random()
        text = "a hot   text" if kind < 0.2 else "a hot text" if kind < 0.4 else "".join(r.choice("ab é\t") for _ in range(r.randint(1, 9)))
        out.append((k, text, k, "y"))
    r.shuffle(out)
    return out


def groups(rows):
    found = defaultdict(list)
    for doc, text, *_ in rows:
        found[re.sub(r"[\x20\x09-\x0D]", "", text or "", flags=re.ASCII)].append((-len(text or ""), doc is None, doc or 0))
    one = lambda k: None if k[1] else k[2]
    return Counter((one(k), one(min(m)), len(m), hashlib.sha256(x.encode()).hexdigest()) for x, m in found.items() for k in m), len(found)


@pytest.mark.parametrize("how", [{}, {"bucket_bytes": 40_000, "table_bytes": 20_000, "bits": 5}])
def test_groups(spark, rows, how, monkeypatch):
    monkeypatch.setattr(exact, "RECORD_ROWS", 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact.exact_duplicates(df, **how).collect()
    want, n = groups(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n and all(r.doc_id == r.keep_id for r in kept) and len({r.text_sha256 for r in kept}) == n


def test_a_bucket_that_does_not_fit_goes_on(spark, rows):
    exact_records = exact.scan(spark.createDataFrame(rows, SCHEMA).repartition(2))
    first = exact.level(exact_records.select(*exact._COLS).repartition(1, "h"), 2, 30_000)
    kinds = {r.kind: r.n for r in first.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"link", "rest"} and kinds["rest"] <= kinds["link"]
    alone = exact.level(exact_records.where("n_bytes > 100000").select(*exact._COLS).repartition(1, "h"), 2, 30_000)
    assert {r.kind for r in alone.collect()} == {"done"}  # one content fits, however long


def test_table_compares_contents():
    t = exact.Table()
    assert [t.put(7, x, 1, len(x), None, k) for k, x in enumerate([b"a", b"b", b"a", b"", b"b"])] == [0, 1, 0, 2, 1]
    for k in range(3000):
        assert t.put(k % 5, str(k).encode(), 2, k, k, k) == 3 + k
    assert t.entry(7, b"b") == 1 and t.rows[:3] == [2, 2, 1] and t.of(3 + 9) == (9, 9)


def test_empty(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
