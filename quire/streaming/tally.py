"""The tally over a stream of events: windowed counts that late rows still reach, up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def windowed_tally(events: DataFrame, key: str, at: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each key in tumbling windows; rows later than `late` are left out, and a window closes once it is that old."""
    counts = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), key, "n")


def first_seen(events: DataFrame, key: str, at: str, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Works off what is there and gives the result as a table in memory (for tests and small results)."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
