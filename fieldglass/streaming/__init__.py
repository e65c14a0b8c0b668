"""Continuous collection: late rows excluded by arrival, buckets counted per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldglass.operators import collect


def windowed_counts(stream: DataFrame, column: str, length: str, late: str, *by: str) -> DataFrame:
    """Counts by time window and further columns; rows later than `late` behind the newest are left out, and old state goes."""
    stream = stream.withColumn(column, F.col(column).cast("timestamp"))
    window = F.window(column, length)
    return stream.withWatermark(column, late).groupBy(window.alias("window"), *by).agg(F.count(F.lit(1)).alias("Count")).select("window.start", "window.end", *by, "Count")


def collect_stream(stream: DataFrame, path: str, checkpoint: str, buckets: int, columns: list[str]) -> StreamingQuery:
    """Writes each micro-batch into bucket folders and stops when what was there is written; a batch repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        collect.with_bucket(batch, buckets, columns).write.mode("overwrite").partitionBy("DumpPartition").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
