"""Surveys that arrive one after another: counts of soundings and surveys per pixel that go on growing.

The batch operators fold by pixel, so a stream needs no more than the same aggregation with state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def pixel_counts(points: DataFrame, size: float) -> DataFrame:
    """row, col, n, v: soundings of each pixel and their mean depth; works on streams and tables alike."""
    at = points.select(F.floor(F.col("n") / size).cast("int").alias("row"), F.floor(F.col("e") / size).cast("int").alias("col"), "depth")
    return at.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.avg("depth").alias("v"))


def kept_up(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the state after each trigger as one Parquet folder a batch, until what there is has been read."""
    put = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
