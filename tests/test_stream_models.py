"""Models of a stream are computed once, not again in each micro-batch."""

import uuid

from pyspark.sql import functions as F

from spikeloom.streaming import adaptive as A


def test_models_are_computed_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def noted(batches):
        (seen / uuid.uuid4().hex).touch()
        yield from batches

    model = ("a", 0, 0, [1.0, 0.0, 0.0, 1.0], [[1.0, 0.0]], [0.5], [4.0])
    schema = "recording_id string, grid int, start long, whitening array<double>, vectors array<array<double>>, low array<double>, high array<double>"
    models = spark.createDataFrame([model], schema).coalesce(1).mapInPandas(noted, schema)
    frames = spark.range(20).select(F.lit("a").alias("recording_id"), F.lit(0).alias("grid"), F.col("id").alias("sample"), F.array(F.sin("id"), F.cos("id")).alias("x"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 10_000).alias("ts"))
    for part in (0, 1):
        frames.where(F.floor(F.col("sample") / 10) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = A.adaptive_stream(live, models, A.Config(5), 100.0)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    assert len(list(seen.iterdir())) == 1
