"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.llm import bpe, decontaminate, graph, jaccard, langid, neighbors, pii, quality, sharding, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, n long, counts string, score double"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ROWS = [
    (1, None, "en", 1, "x", 0.0), (2, "", "en", 1, None, 0.0), (3, "one two", None, 1, "x", None), (4, "one two", "de", 1, "x", 0.0),
    (5, LONG, "en", 1, "x", 0.0), (6, LONG + " end", "en", 1, "x", 0.0), (6, LONG + " end", "en", 1, "x", 0.0), (7, "!!! 123 ???", "fr", 1, "x", 0.0),
    (None, "the quick brown fox jumps over", "en", 1, "x", 0.0), (8, "Ünïcødé text \U0001f600 with mail a.b@c.org and 10.1.2.3", "de", 1, "x", 0.0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_jaccard(docs, none):
    got = by_id(jaccard.jaccard_join(docs, 4, 85))
    assert (got[None].n_shingles, got[None].component_id, got[None].n_links) == (3, None, 0)
    assert [got[k].n_links for k in (1, 2, 3, 4, 5, 6, 7, 8)] == [0, 0, 1, 1, 1, 1, 0, 0]
    assert (got[1].n_shingles, got[2].n_shingles, got[3].n_shingles) == (0, 0, 1)
    assert [got[k].component_id for k in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 3, 5, 5, 7, 8]
    assert jaccard.jaccard_components(none).count() == 0


def test_tree_bound_never_loses_a_pair():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))]
    for _ in range(150):
        base = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], rng.integers(0, 1 << 60, 3).astype(np.uint64)])))
    for s in list(sets[:40]):  # sets of other sizes, with more and fewer groups
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 60, 8).astype(np.uint64)])))
    n, points, all_ = np.array([len(s) for s in sets]), jaccard.Points([jaccard.group_counts(s).tobytes() for s in sets]), np.arange(len(sets))
    assert len(set(points.groups)) > 1
    found = {(min(a, b), max(a, b)) for x, y in jaccard.block_pairs(points, all_, n, n, np.full(len(sets), 2), all_, 85) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= found


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 3), (None, 4), (10, 9), (5, 6), (6, 7), (7, 3)], "a long, b long")
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8, 10: 8}


def test_language(docs, none):
    got = by_id(langid.language_id(docs))
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and got[5].lang_pred != "und"
    assert langid.language_id(none).count() == 0


def test_bpe(docs, none):
    import public_tokenizers as P

    got = by_id(bpe.byte_bpe(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    assert got[1].n_tokens == got[2].n_tokens == 0
    assert got[8].decoded_sha256 == hashlib.sha256(ROWS[-1][1].encode()).hexdigest()
    assert bpe.byte_bpe(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_shards(docs, none):
    rows = sharding.shard_by_size(docs, 4).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.text_crc32 for r in rows}[1] == 0
    at = {(r.doc_id, r.shard) for r in rows}
    assert len({s for d, s in at if d in (3, 4)}) == 1 and len({s for d, s in at if d == 6}) == 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_size(none).count() == 0
    assert sharding.lpt([(5, 1), (4, 2), (3, 3), (3, 4)], 2) == {1: 0, 2: 1, 3: 1, 4: 0}


def test_pii(docs, none):
    got = by_id(pii.replace_pii(docs))
    assert got[1].new_text is None and got[2].new_text == "" and got[5].new_text == LONG
    assert got[8].n_entities == 2 and "a.b@c.org" not in got[8].new_text and "10.1.2.3" not in got[8].new_text
    assert pii.replace_pii(none).count() == 0


def test_surrogates_keep_format_and_differ():
    made = {pii.surrogate(b"k", "ip", f"10.0.{a}.{b}") for a in range(10, 40) for b in range(10, 40)}
    assert len(made) == 900
    s = pii.surrogate(b"k", "card", "4111111111111111")
    assert len(s) == 16 and pii._luhn(s) == 0
    assert pii.surrogate(b"k", "given_m", "Иван")[0].isupper()
    assert [x[2] for x in pii.detect("Frau Anna Berg, +1 (632) 555-4827, password=abc123def456, 078-05-1120")] == ["given_f", "surname", "phone", "secret", "ssn"]


def test_colliding_surrogates_are_turned(spark, monkeypatch):
    monkeypatch.setattr(pii, "_turned", lambda found, key: found.select("kind", "entity", "turn", F.when(F.col("turn") == 0, F.lit("same")).otherwise(F.concat("entity", F.lit("'"))).alias("surrogate")))
    found = spark.createDataFrame([("ip", "a"), ("ip", "b"), ("ip", "c")], "kind string, entity string")
    assert {(r.kind, r.entity) for r in pii.turns(found, b"k").collect()} == {("ip", "b"), ("ip", "c")}


def test_neighbours(spark):
    one, nan = [1.0, 0.0, 0.5], [float("nan"), 1.0, 1.0]
    rows = [(1, one, 0), (2, [2.0, 0.0, 1.0], 0), (3, one, 0), (4, one, 1), (5, None, 0), (6, nan, 0), (7, [0.0, 0.0, 0.0], 0), (8, one, None), (9, [0.0, 1.0, 0.0], 0), (None, one, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbors.near_duplicates(v).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)} | {k: (0, k, True) for k in (4, 5, 6, 7, 8, 9)} | {None: (0, None, None)}
    assert neighbors.near_duplicates(v.limit(0)).count() == 0


def test_quality_and_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 9)], "doc_id long, quality int, toxic int")
    for out in (quality.quality(docs, labels), toxicity.toxicity(docs, labels)):
        rows = out.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(none, labels).count() == toxicity.toxicity(none, labels.limit(0)).count() == 0


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    e, trans = rng.normal(size=7), np.array([[0, 0.3], [0, 1.2], [0, -0.4]])
    begin = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    want = np.zeros(7)
    for lo, hi in ((0, 4), (4, 7)):
        total = 0
        for bits in range(2 ** (hi - lo)):
            y = [bits >> k & 1 for k in range(hi - lo)]
            w = np.exp(trans[2, y[0]] + sum(e[lo + k] * y[k] for k in range(len(y))) + sum(trans[y[k - 1], y[k]] for k in range(1, len(y))))
            total += w
            want[lo:hi] += w * np.array(y)
        want[lo:hi] /= total
    assert np.allclose(toxicity.marginals(e, begin, trans), want)


def test_repeats(docs, none, spark):
    got = by_id(suffixes.remove_repeats(docs))
    assert (got[1].n_bytes, got[2].n_bytes, got[5].n_removed) == (0, 0, 0)
    assert got[6].n_removed == len(LONG) + 1 and got[6].n_spans == 1  # the blank too: the words go round
    assert suffixes.remove_repeats(none).count() == 0
    text = "abcdefghij" * 30
    same = spark.createDataFrame([(1, text), (2, text), (3, text[:49])], "doc_id long, text string")
    assert {k: r.n_removed for k, r in by_id(suffixes.remove_repeats(same)).items()} == {1: 0, 2: 300, 3: 0}


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(1, "Quick brown FOX"), (2, None), (3, ""), (4, "!!!")], "item_id long, text string")
    got = by_id(decontaminate.decontaminate(docs, bench))
    assert got[None]["items"] == [1] and got[None].n_hit == 3 and got[None].cut_text == "the  jumps over"
    assert not got[1].contaminated and got[2].n_words == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    comp = by_id(jaccard.jaccard_components(docs, 5, 80))
    hit = by_id(decontaminate.decontaminate(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")))
    assert {r.doc_id for r in out} == {k for k, r in comp.items() if r.component_id == k and not hit[k].contaminated}
