"""Exact quantiles of groups of any size by distributed rank selection.

Sorting a group in one task does not scale to a hot group, and a sketch is not exact.  Here every round counts the rows
of each group in bins of its value range (a partial aggregate: a task sends a row per group and bin, whatever the number
of rows), finds the bin that holds the wanted rank from the running counts, and goes on inside the values that bin has.
A round cuts a range by the number of bins, ranges over several orders of magnitude by bins of the logarithm, and ends
when the range is one value.  Nothing is collected; no group is in one task; the rows themselves are never shuffled
unless their group table is too large to broadcast (adaptive execution decides by its size in bytes).

Values order as Spark orders them (NaN last); nulls take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import ensure_checkpoint_dir

BINS = 2048


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of a value in ``[lo, hi]`` (finite bounds): a monotone function, with the bounds in different bins.

    Infinite values and NaN have bins of their own beyond both ends.
    """
    def linear(x, a, b):
        # Halved before subtracting: the difference of the bounds may overflow.
        return F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * BINS)

    positive = (lo > 0) & (hi / lo > BINS)
    negative = (hi < 0) & (lo / hi > BINS)
    inner = (F.when(positive, linear(F.log(v), F.log(lo), F.log(hi)))
             .when(negative, -linear(F.log(-v), F.log(-hi), F.log(-lo)) + BINS - 1)
             .otherwise(linear(v, lo, hi)))
    # The upper bound has the last bin to itself, so that a round always cuts.
    inside = F.when(v >= hi, BINS).when(v <= lo, -1).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(BINS - 1)))
    return (F.when(F.isnan(v), BINS + 2).when(v == float("inf"), BINS + 1).when(v == float("-inf"), -2)
            .otherwise(inside).cast("int"))


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """``g, k, value``: the value of rank ``k`` (from 0) of each group, for the rows ``g, k`` of ``wanted``.

    ``g`` is the struct of the group's keys; ``wanted`` has ranks below the number of non-null values only.
    """
    ensure_checkpoint_dir(df.sparkSession)
    v = F.col("v")
    rows = (df.select(F.struct(*keys).alias("g"), F.col(value).cast("double").alias("v")).filter(v.isNotNull()))
    # An interval of a group, with the ranks wanted in it (from the interval's first row).
    spans = (rows.groupBy("g").agg(F.min(_finite(v)).alias("lo"), F.max(_finite(v)).alias("hi"))
             .select("g", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"),
                     F.lit(True).alias("whole")))
    open_ = wanted.join(spans, "g").select("g", "lo", "hi", "whole", "k", F.col("k").alias("rank"))
    done = []
    while True:
        open_ = open_.checkpoint()
        if open_.isEmpty():
            break
        spans = open_.select("g", "lo", "hi", "whole").distinct()
        inside = F.col("whole") | v.between(F.col("lo"), F.col("hi"))
        counts = (rows.join(spans, "g").filter(inside)
                  .groupBy("g", "lo", "hi", _bin(v, F.col("lo"), F.col("hi")).alias("bin"))
                  .agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
        # At most BINS + 5 rows for each interval.
        running = Window.partitionBy("g", "lo", "hi").orderBy("bin")
        counts = counts.withColumn("before", F.sum("n").over(running) - F.col("n"))
        found = (open_.join(counts, ["g", "lo", "hi"])
                 .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
                 .select("g", F.col("least").alias("lo"), F.col("most").alias("hi"), F.lit(False).alias("whole"), "k",
                         (F.col("rank") - F.col("before")).alias("rank"))).checkpoint()
        done.append(found.filter(F.col("lo") == F.col("hi")).select("g", "k", F.col("lo").alias("value")))
        open_ = found.filter(F.col("lo") != F.col("hi"))
    out = wanted.select("g", "k", F.lit(None).cast("double").alias("value")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], interpolate: bool = False
              ) -> DataFrame:
    """``keys`` and one column per named fraction, exact for every group of ``df``.

    The smallest value with at least that share of the group's values up to it (as ``percentile_disc``), or, with
    ``interpolate``, the point between the two values around it (as ``percentile``).  A group without values has nulls.
    """
    sizes = (df.groupBy(F.struct(*keys).alias("g")).agg(F.count(value).alias("n"))).checkpoint()
    ranks = []
    for share in fractions.values():
        at = (F.col("n") - 1) * F.lit(float(share)) if interpolate else F.ceil(F.col("n") * F.lit(float(share))) - 1
        low = F.greatest(F.floor(at), F.lit(0))
        ranks += [low, F.least(F.greatest(F.ceil(at), F.lit(0)), F.col("n") - 1)]
    wanted = (sizes.filter("n > 0").select("g", F.explode(F.array_distinct(F.array(*[r.cast("long") for r in ranks])))
                                           .alias("k")).checkpoint())
    found = order_statistics(df, keys, value, wanted).groupBy("g").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))     # a few ranks per group
    joined = sizes.join(found, "g", "left")
    columns = []
    for i, (name, share) in enumerate(fractions.items()):
        low, high = F.col("at")[ranks[2 * i].cast("long")], F.col("at")[ranks[2 * i + 1].cast("long")]
        at = (F.col("n") - 1) * F.lit(float(share))
        between = F.when(low == high, low).otherwise(
            (F.ceil(at) - at) * low + (at - F.floor(at)) * high) if interpolate else low
        columns.append(F.when(F.col("n") > 0, between).alias(name))
    return joined.select("g.*", *columns)
