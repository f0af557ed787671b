"""Request metrics over time (A3), batch form; the streaming form is in :mod:`kbspark.streaming.metrics`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.quantiles import quantiles

QUANTILES = {"p50_s": 0.5, "p95_s": 0.95}


def metric_columns(value: str = "response_time_s") -> list:
    v = F.col(value)
    return [F.count("*").alias("requests"), F.round(F.avg(v), 6).alias("avg_s"), F.max(v).alias("max_s")]


def daily_metrics(log: DataFrame, ts: str = "ts", kind: str = "kind", value: str = "response_time_s") -> DataFrame:
    """A3: per UTC day and request kind: count, mean, max, median and 95th percentile (exact, by rank selection).

    Everything is a partial aggregate, so a hot day or kind is reduced map-side before the shuffle.
    """
    rows = log.select(F.date_format(F.col(ts), "yyyy-MM-dd").alias("day"), F.col(kind).alias("kind"),
                      F.col(value).cast("double").alias("value"))
    counted = rows.groupBy("day", "kind").agg(*metric_columns("value"))
    ranked = quantiles(rows, ["day", "kind"], "value", QUANTILES).select(
        F.col("day").alias("_day"), F.col("kind").alias("_kind"), *QUANTILES)
    same = F.col("day").eqNullSafe(F.col("_day")) & F.col("kind").eqNullSafe(F.col("_kind"))
    return counted.join(ranked, same, "left").drop("_day", "_kind")
