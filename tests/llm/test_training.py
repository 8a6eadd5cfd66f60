"""Bounds on what classifiers learn from: by rows, and by bytes of their texts."""

from spikeloom.llm.training import balanced, within


def test_bytes_bound_whole_texts_and_long_ones_keep_no_other_out(spark):
    rows = [(k, k % 2, "é" * (5 + k % 7)) for k in range(200)] + [(200, 0, "x" * 5000), (200, 0, "y" * 5000), (201, 1, None), (202, 1, "")]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, y int").distinct()
    everything = within(docs, balanced(known, "y", 1000), "y", 1 << 20)
    assert {tuple(r) for r in everything.collect()} == {(i, y) for i, y, _ in rows}
    got = within(docs, balanced(known, "y", 1000), "y", 600).collect()
    size = {}
    for i, _, t in rows:
        size[i] = size.get(i, 0) + len((t or "").encode())
    for y in (0, 1):
        mine = [r.doc_id for r in got if r.y == y]
        # as full as can be: no text that was passed over fits into what is left
        left = 600 - sum(size[i] for i in mine)
        assert 0 <= left < min(size[i] for i, v, _ in rows if v == y and i not in mine)
    assert 200 not in {r.doc_id for r in got} and {201, 202} <= {r.doc_id for r in got}


def test_nothing_chosen(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, y int")
    assert within(docs, balanced(none, "y", 10), "y", 10).count() == 0
