"""Several texts under one doc_id are judged one by one, in every operator that compares documents."""

import hashlib

import corpus_pipeline

from spikeloom.llm import graph, jaccard, suffixes

A = "the quick brown fox jumps over the lazy dog and then some more words follow it home"
B = "nothing of this sentence is in any way related to what stands above or is it after all"
SCHEMA = "doc_id long, text string"


def test_numbers_keep_the_order_of_ids(spark):
    rows = [(7, A), (7, B), (-3, A), (9, A), (9, A), (None, B), (7, None), (7, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    new, old, span = graph.told_apart(df)
    got = {(r.doc_id, r.text): r._new for r in new.collect()}
    assert span == 4 and len({v for v in got.values() if v is not None}) == 6 and got[None, B] is None
    order = sorted((v, k[0]) for k, v in got.items() if v is not None)
    assert [d for _, d in order] == sorted(d for _, d in order) and len({v // span for v, _ in order}) == 3
    assert {r._new: r.doc_id for r in old.collect()} == dict(order)
    assert graph.told_apart(df.where("doc_id = 9")) is None and graph.told_apart(df.limit(0)) is None


def test_components_and_links(spark):
    df = spark.createDataFrame([(1, A), (5, A), (5, B), (7, B), (8, "alone here")], SCHEMA)
    got = sorted((r.doc_id, r.component_id, r.n_links, r.n_shingles) for r in jaccard.jaccard_join(df, 4, 85).collect())
    n = len(A.split()) - 3, len(B.split()) - 3
    assert got == sorted([(1, 1, 1, n[0]), (5, 1, 1, n[0]), (5, 5, 1, n[1]), (7, 5, 1, n[1]), (8, 8, 0, 1)])


def test_near_duplicate_stage_loses_no_text(spark):
    df = spark.createDataFrame([(1, A, "x"), (5, A, "y"), (5, B, "z"), (None, A, "w")], SCHEMA + ", own string")
    got = sorted(r.own for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect())
    assert got == ["w", "x", "z"]


def test_repeats_are_removed_from_their_own_text(spark):
    base, other = (" ".join(hashlib.sha256(f"{s}{k}".encode()).hexdigest() for k in range(7))[:400] for s in "ab")
    rows = [(1, base), (2, "w" + base), (2, other), (3, other[:200]), (2, "v" + base[:100])]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), 50).collect()}
    assert got == {(1, 400): (0, 0), (2, 401): (400, 1), (2, 400): (0, 0), (3, 200): (200, 1), (2, 101): (100, 1)}
    pair = [(4, base), (4, "x" + base)]  # one id never counts against itself
    assert all(r.n_removed == 0 for r in suffixes.remove_repeats(spark.createDataFrame(pair, SCHEMA), 50).collect())


def test_a_hot_text_stays_where_it_is(spark):
    df = spark.range(2000).selectExpr("id as doc_id", f"if(id % 2 = 0, '{A}', concat('text ', id)) as text", "'en' as lang").repartition(8)
    plan = corpus_pipeline._back(corpus_pipeline.langid.identify(corpus_pipeline._carried(df), None, carry=True), df)
    assert plan.rdd.getNumPartitions() == 8 and plan.columns == df.columns
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
