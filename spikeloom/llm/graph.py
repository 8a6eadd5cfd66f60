"""Connected components of an edge table, and checkpointing that survives lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where none is set and all runs on one machine (tests) a local one is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which goes when the driver ends; smaller than a checkpoint, and columns are read one by one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of what is no longer used before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates large-star and small-star steps, so paths shrink by half or
    more each round; hubs stay rows of a join and are never gathered. Null
    ends and loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = saved(e)
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = saved(small.union(down.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame, int] | None:
    """For tables in which one doc_id has several texts: each text of an id gets an id of its own.

    Gives docs with `_new` (in order of doc_id; null without one), the table
    (_new, doc_id), and how many numbers each doc_id spans, so that new // span
    tells whether two are of one doc_id. None where no id has two texts; rows
    that repeat as a whole stay one document.
    """
    spark = docs.sparkSession
    own = docs.select("*", F.col("doc_id").cast("long").alias("_doc"))
    ids = own.select("_doc").where("_doc is not null")
    if ids.groupBy("_doc").count().where("count > 1").isEmpty():
        return None
    own = own.withColumn("_hash", F.xxhash64(F.col("text").cast("string"), F.col("text").isNull()))
    pairs = written(own.select("_doc", "_hash").where("_doc is not null").distinct())
    span = pairs.groupBy("_doc").count().agg(F.max("count")).first()[0]
    if span == 1:
        return None
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = written(pairs.select("_doc").distinct().repartitionByRange(n, "_doc").withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in order.groupBy("_part").count().collect())  # a number for each partition
    before = spark.createDataFrame([(p, sum(m for q, m in sizes if q < p)) for p, _ in sizes], "_part int, _before long")
    place = F.row_number().over(W.partitionBy("_part").orderBy("_doc")) - 1
    rank = order.withColumn("_at", place).join(F.broadcast(before), "_part").select("_doc", (F.col("_at") + F.col("_before")).alias("_rank"))
    new = pairs.join(rank, "_doc").withColumn("_new", F.col("_rank") * span + F.row_number().over(W.partitionBy("_doc").orderBy("_hash")) - 1)
    new = written(new.select("_doc", "_hash", "_new"))
    out = own.join(new, ["_doc", "_hash"], "left").select(*docs.columns, "_new")
    return out, new.select("_new", F.col("_doc").alias("doc_id")), span
