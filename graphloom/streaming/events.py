"""Structured Streaming over event tables: windows under a watermark, sessions, and moments that grow with the stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by event-time window; rows later than the watermark are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


def drain(stream: Callable[[], DataFrame], out: str, state: str) -> Callable[[SparkSession, str], DataFrame]:
    """Read what a stream has now into the Parquet folder out; what is returned reads what has come since, with the same
    state, and gives all closed rows. Both reads end when the source is used up."""

    def go() -> None:
        stream().writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    def rest(spark: SparkSession, schema: str) -> DataFrame:
        go()
        return spark.read.schema(schema).parquet(out)

    go()
    return rest


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of sessions that end after a gap without events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


def moments(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Sums that determine a line of least squares; they add up over batches of a stream."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy"))


def line_fit(sums: DataFrame) -> DataFrame:
    """(slope, intercept, r2) from moments()."""
    cov, var = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    spread = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    return sums.select((cov / var).alias("slope"), ((F.col("sy") - cov / var * F.col("sx")) / F.col("n")).alias("intercept"), (cov * cov / (var * spread)).alias("r2"))
