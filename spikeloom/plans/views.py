"""The given tables seen as recordings: one 64-channel signal, spike trains of four grids, and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views for DuckDB, as common table expressions.
SIG = "sig AS (SELECT 'r' AS recording_id, CAST(0 AS INTEGER) AS grid, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS channel, CAST(vec_id AS BIGINT) AS sample, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
PARTS = "parts AS (SELECT 'r' || (sample // 125) AS recording_id, grid, channel, sample % 125 AS sample, value FROM sig)"
SPK = "spk AS (SELECT 'r' || (user_id % 4) AS recording_id, user_id AS unit_uid, CAST(user_id // 4 % 4 AS INTEGER) AS grid, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS sample, max(value) AS value FROM events GROUP BY ALL)"
MIN = "m AS (SELECT recording_id, unit_uid, grid, sample // 60 AS sample, max(value) AS value FROM spk GROUP BY ALL)"
CH = "ch AS (SELECT 'r' || c_nationkey AS recording_id, c_custkey AS row_no, CASE WHEN c_custkey % 5 = 0 THEN 'MISC' ELSE 'EMG' END AS type, CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE 'Grid' || (c_custkey % 12) END AS \"group\", CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END AS target_muscle, CASE WHEN c_custkey % 2 = 0 THEN 'n/a' ELSE CAST(2000 + c_custkey AS VARCHAR) END AS sampling_frequency, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || ' Hz' END AS low_cutoff, 'n/a' AS high_cutoff, CAST(c_nationkey // 20 * c_custkey AS VARCHAR) AS gain FROM customer)"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel rows: customers as channels, their nations as recordings."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    row = {
        "recording_id": F.concat(F.lit("r"), text(F.col("c_nationkey"))), "row_no": k,
        "type": F.when(k % 5 == 0, "MISC").otherwise("EMG"), "group": F.when(k % 13 == 0, "n/a").otherwise(F.concat(F.lit("Grid"), text(k % 12))),
        "target_muscle": F.when(k % 4 == 0, " ").otherwise(F.col("c_mktsegment")), "sampling_frequency": F.when(k % 2 == 0, "n/a").otherwise(text(k + 2000)),
        "low_cutoff": F.when(k % 3 == 0, F.concat(text(k), F.lit(" Hz"))), "high_cutoff": F.lit("n/a"), "gain": text(F.floor(F.col("c_nationkey") / 20) * k),
    }
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(*(c.alias(n) for n, c in row.items()))


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples: vectors as samples of a 64-channel grid."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.lit("r").alias("recording_id"), F.lit(0).alias("grid"), F.posexplode("embedding").alias("channel", "v"), F.col("vec_id").alias("sample")).select("recording_id", "grid", "channel", "sample", F.col("v").cast("double").alias("value"))


def parts(spark: SparkSession, sf_dir: str, length: int = 125) -> DataFrame:
    """samples: the same signal as many recordings, each of so many samples, so that their number grows with the table."""
    s = sig(spark, sf_dir)
    return s.withColumn("recording_id", F.concat(F.lit("r"), F.floor(F.col("sample") / length).cast("string"))).withColumn("sample", F.col("sample") % length)


def spk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pulses and spikes: users as units, their events as spikes in seconds of the month; users are dealt out to four recordings and four grids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1704067200
    rows = e.select(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("recording_id"), F.col("user_id").alias("unit_uid"), (F.floor(F.col("user_id") / 4) % 4).cast("int").alias("grid"), sec.alias("sample"), "value")
    return rows.groupBy("recording_id", "unit_uid", "grid", "sample").agg(F.max("value").alias("value"))


def minutes(spikes: DataFrame) -> DataFrame:
    """The spike trains by minutes, which gives coincidences."""
    return spikes.groupBy("recording_id", "unit_uid", "grid", F.floor(F.col("sample") / 60).alias("sample")).agg(F.max("value").alias("value"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
