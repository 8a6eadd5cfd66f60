"""Blocks of benchmark windows give what one broadcast gives."""

from spikeloom.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_blocks_are_the_whole(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (None, "a b c"), (7, "")], "doc_id long, text string"))
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(decontaminate.decontaminate(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -(-decontaminate.benchmark_windows(bench, 10).count() // 3))
    got = decontaminate.decontaminate(docs, bench)
    assert key(got) == want and got.where("contaminated").count() > 0
