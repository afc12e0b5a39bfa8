"""Event windows as streams: an extension, since the batch library has no notion of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.session import scratch_path


def windowed_values(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by kind in tumbling windows, on a stream or a table."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def run_once(spark: SparkSession, folder: str, pattern: str, schema: StructType, time: str, kind: str, value: str, width: str = "1 hour") -> DataFrame:
    """Streams the files of a folder that fit the pattern once and returns what the windows gave."""
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    made = windowed_values(stream, time, kind, value, width)
    query = made.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)
