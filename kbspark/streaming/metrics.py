"""Streaming request metrics (T1): tumbling windows over the request log, late rows counted.

:func:`run_request_metrics` places every row of a micro-batch in a lane: ``window`` (its window is still open), ``late``
(the watermark, the largest event time of earlier batches less the allowed delay, has passed its window's end) or
``undated`` (no event time).  Rows of a batch lie in the folder of its epoch, so a replayed batch overwrites itself.
Windows that a batch closes are summarised once, exactly (quantiles included), from the rows of their time range.  So
closed windows, open rows, late and undated rows add up to all rows, over any number of batches and runs.

:func:`windowed_metrics` is the same aggregation as Spark's own windowed stream: partial aggregates as state, no
quantiles, and rows behind an emitted window are dropped uncounted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.metrics import daily_metrics, metric_columns
from kbspark.streaming.runner import landed_stream, run_available_now, stream_dir

ROWS = "epoch long, lane string, start timestamp, end timestamp, ts timestamp, kind string, response_time_s double"
MARKS = "epoch long, latest timestamp"


def windowed_metrics(log: DataFrame, ts: str = "ts", kind: str = "kind", value: str = "response_time_s",
                     window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """``(day, kind, requests, avg_s, max_s)`` per closed window, as a plan over a stream."""
    agg = (log.withWatermark(ts, watermark)
           .groupBy(F.window(F.col(ts), window).alias("w"), F.col(kind).alias("kind"))
           .agg(*metric_columns(value)))
    return agg.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "kind", "requests", "avg_s", "max_s")


def events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The landed request log as a stream: ``(ts timestamp, kind, response_time_s)``."""
    src = landed_stream(spark, path, max_files)
    return src.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
                      F.col("value").cast("double").alias("response_time_s"))


def watermark_before(spark: SparkSession, root: str, epoch: int, delay: str):
    """The watermark that a batch meets (one value): what the batches before it have seen, less the delay."""
    marks = spark.read.schema(MARKS).parquet(f"{root}/marks") if epoch else spark.createDataFrame([], MARKS)
    return marks.filter(F.col("epoch") < epoch).agg(
        (F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("at")).first()[0]


def window_summary(rows: DataFrame) -> DataFrame:
    """Metrics of whole windows (``start``) by kind."""
    return daily_metrics(rows.select(F.col("start").alias("ts"), "kind", "response_time_s"))


def apply_batch(spark: SparkSession, batch: DataFrame, epoch: int, root: str, window: str, delay: str) -> None:
    """One micro-batch: rows to their lanes, the watermark on, windows that it closes summarised."""
    before = watermark_before(spark, root, epoch, delay)
    passed = F.lit(False) if before is None else F.col("w.end") <= F.lit(before)
    lane = F.when(F.col("ts").isNull(), "undated").when(passed, "late").otherwise("window")
    # F.window drops rows without a time; its bounds as expressions keep them.
    dated = batch.filter("ts IS NOT NULL").withColumn("w", F.window("ts", window))
    none = F.lit(None).cast(dated.schema["w"].dataType)
    rows = dated.unionByName(batch.filter("ts IS NULL").withColumn("w", none))
    here = f"{root}/rows/epoch={epoch}"
    (rows.select(lane.alias("lane"), "w.start", "w.end", "ts", "kind", "response_time_s")
     .write.mode("overwrite").partitionBy("lane").parquet(here))
    stored = spark.read.schema(ROWS).parquet(f"{root}/rows")
    (stored.filter(F.col("epoch") == epoch).agg(F.max("ts").alias("latest"))
     .write.mode("overwrite").parquet(f"{root}/marks/epoch={epoch}"))
    after = watermark_before(spark, root, epoch + 1, delay)
    closing = (F.col("lane") == "window") & (F.col("end") <= F.lit(after)) & (F.col("epoch") <= epoch)
    if before is not None:
        closing &= F.col("end") > F.lit(before)
    window_summary(stored.filter(closing)).write.mode("overwrite").parquet(f"{root}/closed/epoch={epoch}")


def run_request_metrics(spark: SparkSession, path: str, window: str = "1 day", watermark: str = "1 hour",
                        root: str | None = None, max_files: int | None = None) -> DataFrame:
    """Run the stream over what has landed and return the closed windows,
    ``(day, kind, requests, avg_s, max_s, p50_s, p95_s)``.

    Everything is in ``root``: a later run with the same folder goes on, and closes windows that were still open.
    Without one, a fresh folder is taken.  ``max_files`` bounds a batch: files that come later than the delay allows are
    then late rows, which :func:`late_rows` counts.
    """
    base = root or stream_dir(spark, "request_metrics")

    def apply(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            apply_batch(batch.sparkSession, batch, epoch, base, window, watermark)

    run_available_now(events_stream(spark, path, max_files), f"{base}/_checkpoint", foreach_batch=apply)
    return closed_windows(spark, base)


def closed_windows(spark: SparkSession, root: str) -> DataFrame:
    """The summaries of all windows that have been closed."""
    schema = "day string, kind string, requests long, avg_s double, max_s double, p50_s double, p95_s double"
    return spark.read.schema(schema).parquet(f"{root}/closed/epoch=*")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """``(lane, day, kind, requests)`` of the rows that no window has: ``late`` and ``undated``."""
    rows = spark.read.schema(ROWS).parquet(f"{root}/rows").filter("lane <> 'window'")
    return rows.groupBy("lane", F.date_format("start", "yyyy-MM-dd").alias("day"), "kind").agg(
        F.count("*").alias("requests"))


def open_rows(spark: SparkSession, root: str, watermark: str = "1 hour") -> DataFrame:
    """``(day, kind, requests)`` of windows that are still open."""
    rows = spark.read.schema(ROWS).parquet(f"{root}/rows").filter("lane = 'window'")
    at = spark.read.schema(MARKS).parquet(f"{root}/marks").agg(
        (F.max("latest") - F.expr(f"INTERVAL {watermark}")).alias("at")).first()[0]
    return (rows.filter(F.col("end") > F.lit(at)).groupBy(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind")
            .agg(F.count("*").alias("requests")))
