"""The pipeline on nulls, empty tables, repeated rows and extra columns with clashing names."""

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, n_chars long, own string, spans string, row long, hash int, doc int"
PLAIN = "the quick brown fox jumps over the lazy dog and then some more words follow it home"
LEAK = "one two three four five six seven eight nine ten eleven twelve"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, None if k % 3 else "en", 0, "o", "s", 1, 2, k) for k, (d, t) in enumerate(rows)], SCHEMA)


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(1, LEAK), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_every_stage_has_a_result_for_every_row(spark, sf_dir):
    rows = [(1, PLAIN), (2, PLAIN), (2, PLAIN), (3, None), (4, ""), (5, "123 !!!"), (None, PLAIN), (None, None), (None, LEAK), (6, "x " + LEAK), (7, "mail a.b@c.org here"), (8, PLAIN + " end " * 40_000)]
    stages = dict(corpus_pipeline.STAGES)
    d = docs(spark, rows)
    kept = stages["language_id"](spark, d, sf_dir)
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted((d or -1, t) for d, t in rows if t and any(c.isalpha() for c in t))
    one = stages["near_duplicates"](spark, kept, sf_dir)
    assert sorted(r.doc_id or -1 for r in one.collect()) == [-1, -1, 1, 6, 7, 8]  # without an id a row is in no group
    clean = stages["decontamination"](spark, one, sf_dir)
    assert sorted(r.doc_id or -1 for r in clean.collect()) == [-1, 1, 7, 8]
    new = stages["pii_surrogates"](spark, clean, sf_dir)
    assert new.columns == d.columns and "a.b@c.org" not in " ".join(r.text for r in new.collect())
    assert {r.own for r in new.collect()} == {"o"}
    out = stages["byte_bpe"](spark, new, sf_dir).collect()
    assert len(out) == 4 and all(r.n_tokens > 0 for r in out)


def test_empty_tables(spark, sf_dir):
    d = docs(spark, [(1, PLAIN)]).where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf_dir)
        assert out.count() == 0
    d.write.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
