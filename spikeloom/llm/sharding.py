"""Sharding by longest processing time: whole groups, largest first, to the least-loaded shard.

Groups of equal texts stay together. The heap handles a bounded number of
items: groups above 1 / (shards * FINE) of all bytes are items of their own, of
which there can be no more than shards * FINE; all others are bundled by hash
into a fixed number of items of three graded sizes, the smallest of which even
out the loads at the end.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FINE = 256
#: Bundles of each grade; the later grades take 1 / 16 and 1 / 256 of the small groups.
BUNDLES = (4096, 1024, 1024)
#: Rows that one sort for slots gets at most, about.
CHUNK_ROWS = 200_000


def lpt(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Item to shard: items as (size, id), largest first, ties by id, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        out[item] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def _bundle():
    """Bundle number of a small group."""
    h = F.col("h1")
    grade = F.pmod(F.shiftrightunsigned(h, 20), F.lit(256))
    n1, n2, n3 = BUNDLES
    low = F.shiftrightunsigned(h, 32)
    return F.when(grade == 0, F.lit(n1 + n2) + F.pmod(low, F.lit(n3))).when(grade < 16, F.lit(n1) + F.pmod(low, F.lit(n2))).otherwise(F.pmod(low, F.lit(n1))).cast("long")


def shard_by_size(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot per input row; documents with equal texts share a shard.

    size is the text's UTF-8 bytes (null: none) plus 1; a null text's crc32 is
    0, as that of no bytes, and null texts are one group apart from empty ones. Slots of a shard
    are gapless from 0. Groups are told apart by 64-bit hash and length, so
    different texts stay together only if both agree.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(-1)).otherwise(F.xxhash64(F.col("text"), F.octet_length("text"))).alias("h1"),
    )
    groups = rows.groupBy("h1").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    limit = max(1, total // (shards * FINE))
    items = groups.groupBy(F.when(F.col("bytes") > limit, F.col("h1")).otherwise(_bundle()).alias("item")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max(F.col("bytes") > limit).alias("large")).collect()
    place = lpt([(r.bytes, r.item) for r in items], shards)
    large = {r.item for r in items if r.large}
    spark = docs.sparkSession
    table = spark.createDataFrame([(r.item, place[r.item], max(1, -(-r.rows // CHUNK_ROWS))) for r in items] or [(0, 0, 1)], "item long, shard int, chunks long")
    big = spark.createDataFrame([(x,) for x in sorted(large)], "h1 long")
    put = rows.join(F.broadcast(big.withColumn("own", F.lit(True))), "h1", "left")
    put = put.withColumn("item", F.when(F.col("own"), F.col("h1")).otherwise(_bundle()))
    put = put.join(F.broadcast(table), "item").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    count = put.groupBy("shard", "item", "chunk").agg(F.count("*").alias("n"))
    first = count.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("item", "chunk")) - F.col("n")).select("item", "chunk", "first")
    slot = F.row_number().over(W.partitionBy("item", "chunk").orderBy("doc_id")) - 1
    out = put.withColumn("at", slot).join(first, ["item", "chunk"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"))
