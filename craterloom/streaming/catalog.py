"""Structured Streaming forms of catalog operators (an extension: the batch engine defines the results).

* ingest(): files that land in a folder, classified as they come.
* latest_by(): the latest product for each key, as an update stream.
* windowed_counts(): event counts in time windows with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Catalog rows of Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest_by(products: DataFrame, key: str) -> DataFrame:
    """One row for each key: its latest usable product so far (outputMode update or complete)."""
    at = F.coalesce(F.unix_micros(F.try_to_timestamp("acquisition_time")), F.lit(-(1 << 62)))
    usable = products.where(F.col("status").isin("validated", "partial", "parsed"))
    return usable.groupBy(key).agg(F.max(F.struct(at.alias("at"), "product_id", "acquisition_time")).alias("m")).select(key, "m.product_id", "m.acquisition_time")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Rows and sums for each window and key; rows later than ``late`` may be left out, as streams do."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", key, "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains what is there into a Parquet table and stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_into_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drains what is there; every micro-batch writes the whole result so far below path, the last one is read back.

    The result stays with the executors; a batch that is run again writes the same folder.
    """
    done: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        done.append(batch)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch={max(done)}")
