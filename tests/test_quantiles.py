"""Exact quantiles equal Spark's own sorting aggregates, whatever the values and the skew."""

import random

from pyspark.sql import functions as F

from kbspark.operators.quantiles import quantiles

SHARES = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0, "p3": 0.333}


def both(spark, df):
    df.createOrReplaceTempView("measured")
    disc = ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v) AS {n}" for n, p in SHARES.items())
    cont = ", ".join(f"percentile(v, {p}) AS {n}" for n, p in SHARES.items())
    for interpolate, columns in ((False, disc), (True, cont)):
        got = quantiles(df, ["kind", "k2"], "v", SHARES, interpolate).collect()
        want = spark.sql(f"SELECT kind, k2, {columns} FROM measured GROUP BY kind, k2").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_quantiles_equal_percentile(spark):
    rng, rows = random.Random(1), []
    odd = [float("nan"), float("inf"), float("-inf"), 1e308, -1e308, 5e-324, 0.0]
    for kind, n in [("one", 1), ("two", 2), ("wide", 2000), (None, 150), ("nulls", 50), ("odd", 300), ("ties", 500)]:
        for i in range(n):
            v = rng.choice([rng.random(), rng.lognormvariate(0, 20), -rng.lognormvariate(0, 20), 1.5, None])
            v = {"one": 4.0, "nulls": None, "ties": float(i % 3)}.get(kind, v)
            rows.append((kind, i % 2 if kind == "wide" else None, rng.choice(odd) if kind == "odd" and i % 3 == 0 else v))
    both(spark, spark.createDataFrame(rows, "kind string, k2 int, v double").repartition(4))
    assert quantiles(spark.createDataFrame([], "kind string, v double"), ["kind"], "v", SHARES).count() == 0


def test_quantiles_of_a_hot_group(spark):
    df = spark.range(0, 300_000, numPartitions=8).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(100).alias("kind"), F.lit(1).alias("k2"),
        F.exp(F.randn(3) * 3).alias("v"))
    both(spark, df)
