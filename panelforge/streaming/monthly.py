"""Extensions: batch operators over streams. The panel itself is batch; these have no counterpart to match but their own batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_window(stream: DataFrame, key: str, at: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """The last value of each key in each window; rows later than ``late`` are dropped, state goes with the watermark."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(F.window(at, window).alias("w"), key).agg(F.max_by(value, at).alias(value), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, value, "n")


def sessions(stream: DataFrame, key: str, at: str, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Runs of a key's rows at most ``gap`` apart."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def append_only(stream: DataFrame, path: str, key: str, checkpoint: str):
    """An idempotent sink: each batch adds the keys that aren't there yet."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(path).select(key)
        except Exception as e:  # noqa: BLE001  nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = None
        new = batch.dropDuplicates([key])
        (new if seen is None else new.join(seen, key, "left_anti")).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
