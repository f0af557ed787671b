"""First-wins, last-wins and retry resolution.

All three are keyed reductions written as aggregates (``min_by`` /
``max_by`` / ``min``; over structs Spark plans sort aggregates), not windows: the partial aggregate runs before the
shuffle, so a key that holds a third of all rows is reduced map-side to one
row per task instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_occurrence(df: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """C4: one row per ``key``, the one with the smallest ``order`` (the visited set of one run)."""
    others = [c for c in df.columns if c not in (key, order)]
    if not others:
        return df.groupBy(key).agg(F.min(order).alias(order)).select(order, key)
    best = F.min_by(F.struct(order, *others), F.col(order))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b.*").select(df.columns)


def last_write_wins(df: DataFrame, key: str = "path", order: str = "ord") -> DataFrame:
    """One row per ``key``, the one with the largest ``order`` (later write replaces earlier)."""
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*others), F.col(order))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b.*").select(df.columns)


def collisions(df: DataFrame, key: str = "path", item: str = "url") -> DataFrame:
    """C5 report: keys written by more than one distinct item, with how many."""
    return (df.groupBy(key).agg(F.countDistinct(item).alias("writers"))
            .filter(F.col("writers") > 1))


def resolve_attempts(log: DataFrame, key: str = "url", accept_last_response: bool = False,
                     with_body: bool = True) -> DataFrame:
    """Outcome of up to N fetch attempts per ``key``.

    ``log`` has ``attempt``, ``status`` (null = the attempt raised) and ``body``.
    The first attempt with status 200 wins; without one, the last response
    is kept.  ``outcome`` is ``ok``, ``error_response`` or ``no_response``; with
    ``accept_last_response`` the error response counts as the page (the
    original's behaviour), otherwise it goes to the error lane.  Without
    ``with_body`` only keys are read and shuffled, no page bodies.
    """
    ok = F.col("status") == 200
    # Smaller is better: first success, else latest response; raised attempts
    # have no rank and are skipped by ``min_by``.  One aggregate, one shuffle.
    rank = F.when(F.col("status").isNotNull(), F.struct(
        (~ok).cast("int").alias("failed"), F.when(ok, F.col("attempt")).otherwise(-F.col("attempt")).alias("turn")))
    kept = ["attempt", "status", *(["body"] if with_body else [])]
    out = (log.groupBy(key).agg(F.min_by(F.struct(*kept), rank).alias("_b"))
           .select(key, *[f"_b.{c}" for c in kept]))
    outcome = (F.when(F.col("status").isNull(), F.lit("no_response"))
               .when(F.col("status") == 200, F.lit("ok"))
               .otherwise(F.lit("accepted_error" if accept_last_response else "error_response")))
    return out.withColumn("outcome", outcome)
