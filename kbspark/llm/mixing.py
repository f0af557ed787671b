"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source gets a target: its weight's share of ``share`` times all words, at most ``repeat`` times its own words, the
excess shared again by weight among the others.  Words are dealt in blocks of ``block`` words: the sources' targets
compete for all blocks by highest quotients ``target / (2 q + 1)``, and within a source its shards compete for the
source's blocks by their words, so every shard has an integer quota.  A shard lays its documents end to end in an order
that the seed decides, cut into blocks; a quota of more than its blocks takes them all that often, and the rest are
chosen by a seeded permutation of the blocks.

A shard is a bounded number of documents by a hash of key and text, so a source that holds a third of all rows is many
shards, and so is a key that many texts share (rows alike in both stay in one shard); sums per source and shard are partial aggregates.  Only tables of one row per source or per shard are ranked
together.  All steps are DataFrame expressions; ``mixed`` alone cuts texts in Python.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined results: a null text has no words; a null source is a source of its own
and comes last; documents without words take nothing; rows with one key are documents of their own; ties are broken by
key and size, so that reruns agree; an empty table gives an empty table; only the named columns are read, and ``mixed``
returns the columns of its input, whatever else they are called.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Multipliers of block permutations; primes above any count of blocks, so that each is a permutation.
PRIMES = (2147483647, 2147483659, 2147483693, 2147483713, 2147483743, 2147483777)


@dataclass(frozen=True)
class MixParams:
    weights: tuple = (3, 1, 2)
    share: float = 1.5
    repeat: int = 2
    block: int = 8
    shard_docs: int = 50_000
    seed: int = 20240229


def targets(sources: DataFrame, p: MixParams) -> DataFrame:
    """``source, source_size`` with ``target``: shares by weight, filled up to the caps from the lowest on.

    One row per source is ranked in one task; sums before it are running sums.
    """
    every = Window.partitionBy()
    ranked = sources.withColumn("place", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.col("place") % len(p.weights) + 1).cast("int"))
    rows = (ranked.withColumn("weight", weight.cast("double"))
            .withColumn("cap", p.repeat * F.col("source_size").cast("double"))
            .withColumn("budget", p.share * F.sum("source_size").over(every)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                           / F.sum("weight").over(onward))
    free = F.col("cap") > F.col("weight") * F.col("level")
    rows = rows.withColumn("rank", F.row_number().over(up))
    rows = rows.withColumn("water", F.min_by(F.when(free, F.col("level")), F.when(free, F.col("rank"))).over(every))
    return rows.select("source", "source_size", F.coalesce(
        F.least("cap", F.col("weight") * F.col("water")), F.col("cap")).alias("target"))


def apportion(df: DataFrame, group: list[str], order: list, weight: str, total: str, most: str,
              name: str) -> DataFrame:
    """Adds ``name``: Sainte-Laguë seats of each row, of ``total`` seats of its group, ``most`` at most.

    With n rows the deciding divisor gives the rows between ``total - n / 2`` and ``total + n / 2`` seats' worth of
    shares, so each row surely has the seats of the one and never more than those of the other; only the seats between
    (about four a row) are ranked by their quotients ``weight / (2 q + 1)``.
    """
    all_ = Window.partitionBy(*group)
    share = F.try_divide(F.col(weight), F.sum(weight).over(all_))
    n = F.count(F.lit(1)).over(all_)
    limit = F.when(F.col(weight) > 0, F.col(most)).otherwise(0)

    def seats(at: Column, more: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(F.coalesce(share, F.lit(0.0)) * at + 0.5) + more, limit))

    df = df.withColumn("__sure", seats(F.col(total) - n / 2, -1)).withColumn("__top", seats(F.col(total) + n / 2, 2))
    df = df.withColumn("__rest", F.col(total) - F.sum("__sure").over(all_))
    ids = [c for c in df.columns if not c.startswith("__")]
    tries = df.withColumn("__seat", F.explode_outer(F.when(
        F.col("__top") > F.col("__sure"), F.sequence(F.col("__sure"), F.col("__top") - 1))))
    best = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("__seat") + 1)).desc_nulls_last(), *order)
    won = (F.col("__seat").isNotNull() & (F.row_number().over(best) <= F.col("__rest"))).cast("long")
    return (tries.withColumn("__won", won).groupBy(*ids, "__sure").agg(F.sum("__won").alias("__won"))
            .select(*ids, (F.col("__sure") + F.col("__won")).alias(name)))


def decide(df: DataFrame, p: MixParams = MixParams(), key: str = "doc_id", text: str = "text",
           source: str = "source") -> DataFrame:
    """``key, source, size, source_size, target, taken, passes, spans``: what the mix takes of every row: all of it
    ``passes`` times, and the word ranges ``spans`` (from, to) once more."""
    sized = df.select(F.col(key).alias("doc_key"), F.col(source).alias("source"),
                      F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                      F.xxhash64(text).alias("text_hash"))
    sized = sized.checkpoint()                     # four short columns, read several times
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), p)
    shards = sized.groupBy("source").agg(F.ceil(F.count("*") / p.shard_docs).alias("n_shards"))
    placed = (sized.alias("a").join(shards.alias("b"), F.expr("a.source <=> b.source"))
              .select("a.*", F.pmod(F.xxhash64("doc_key", "text_hash", F.lit(p.seed)), F.col("n_shards")).alias("shard")))
    blocks = F.ceil(F.col("words") / p.block)
    by_shard = (placed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
                .withColumn("n_blocks", blocks))
    wanted = (by_shard.groupBy("source").agg(F.sum("n_blocks").alias("source_blocks")).alias("a")
              .join(per_source.alias("b"), F.expr("a.source <=> b.source"))
              .select("b.*", (p.repeat * F.col("source_blocks")).alias("most"))
              .withColumn("total", F.round(F.sum("target").over(Window.partitionBy()) / p.block).cast("long")))
    quotas = apportion(wanted, [], [F.col("source").isNull(), "source"], "target", "total", "most", "source_quota")
    by_shard = (by_shard.alias("a").join(quotas.alias("b"), F.expr("a.source <=> b.source"))
                .select("a.*", "source_size", "target", "source_quota",
                        (p.repeat * F.col("n_blocks")).alias("most")))
    by_shard = apportion(by_shard, ["source"], ["shard"], "words", "source_quota", "most", "quota")
    by_shard = by_shard.withColumn("passes", F.when(F.col("n_blocks") > 0, F.expr("quota div n_blocks")).otherwise(0)) \
        .withColumn("extra", F.when(F.col("n_blocks") > 0, F.col("quota") % F.col("n_blocks")).otherwise(0))
    laid = Window.partitionBy("source", "shard").orderBy(
        F.xxhash64("doc_key", "text_hash", F.lit(p.seed + 1)), "doc_key", "size", "text_hash")
    rows = (placed.withColumn("stop", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("start", F.col("stop") - F.col("size")).alias("a")
            .join(by_shard.alias("b"), F.expr("a.source <=> b.source AND a.shard = b.shard"))
            .select("a.*", "b.n_blocks", "b.passes", "b.extra", "b.source_size", "b.target"))
    draw = F.xxhash64(F.lit(p.seed), "source", "shard")
    prime = F.element_at(F.array(*[F.lit(x).cast("long") for x in PRIMES]),
                         (F.pmod(draw, F.lit(len(PRIMES))) + 1).cast("int"))
    some = F.greatest("n_blocks", F.lit(1))
    rows = rows.withColumn("step", prime % some).withColumn("turn", F.pmod(draw, some))
    rows = rows.withColumn("spans", F.expr(f"""
        CASE WHEN size > 0 AND extra > 0 THEN transform(
            filter(sequence(start div {p.block}, (stop - 1) div {p.block}),
                   j -> (step * j + turn) % n_blocks < extra),
            j -> named_struct('from', greatest(j * {p.block}, start) - start,
                              'to', least((j + 1) * {p.block}, stop) - start))
        ELSE array() END"""))
    taken = F.col("passes") * F.col("size") + F.aggregate(
        "spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    return rows.select(F.col("doc_key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"),
                       "passes", "spans")


def cut(text: str, spans: list[dict]) -> str:
    """The text from the first to the last word of each run of adjoining word ranges, runs joined by a newline."""
    ends = [m.span() for m in re.finditer(WORD, text)]
    joined: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["from"]):
        if joined and joined[-1][1] == s["from"]:
            joined[-1][1] = s["to"]
        else:
            joined.append([s["from"], s["to"]])
    return "\n".join(text[ends[a][0]:ends[b - 1][1]] for a, b in joined)


def _written(batches: Iterator[pa.RecordBatch], text: str, chars: str | None):
    for batch in batches:
        n = len(batch.schema) - 2
        passes, spans = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
        base = pa.RecordBatch.from_arrays(batch.columns[:n], schema=pa.schema([batch.schema.field(i)
                                                                               for i in range(n)]))
        whole = [i for i, k in enumerate(passes) for _ in range(k)]
        part = [i for i, s in enumerate(spans) if s]
        if whole:
            yield base.take(pa.array(whole, pa.int64()))
        if part:
            rows = base.take(pa.array(part, pa.int64()))
            at = rows.schema.get_field_index(text)
            texts = [cut(t, spans[i]) for t, i in zip(rows.column(at).to_pylist(), part)]
            rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
            if chars is not None:
                c = rows.schema.get_field_index(chars)
                rows = rows.set_column(c, rows.schema.field(c), pa.array(map(len, texts), rows.schema.field(c).type))
            yield rows


def mixed(df: DataFrame, p: MixParams = MixParams(), key: str = "doc_id", text: str = "text",
          source: str = "source", chars: str | None = "n_chars") -> DataFrame:
    """The rows of the mix, columns as in ``df``: a document taken twice comes twice, one taken in part comes with the
    words taken (and ``chars``, where that column exists, their length)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    own = "__"                                     # names that no column of the input begins with
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    of_key, of_source, of_size, nth, passes, spans = (own + x for x in ("key", "source", "size", "nth", "passes", "spans"))
    decisions = decide(df, p, key, text, source).select(
        F.col(key).alias(of_key), F.col("source").alias(of_source), F.col("size").alias(of_size),
        F.col("passes").alias(passes), F.col("spans").alias(spans))
    # Rows alike in key, source and size are numbered, so that each meets one decision.
    like = Window.partitionBy(of_key, of_source, of_size)
    decisions = decisions.withColumn(nth, F.row_number().over(like.orderBy(passes, F.size(spans))))
    rows = df.select("*", F.col(key).alias(of_key), F.col(source).alias(of_source), size.alias(of_size))
    rows = rows.withColumn(nth, F.row_number().over(like.orderBy(F.xxhash64(F.col(text)))))
    met = rows.alias("a").join(decisions.alias("b"), F.expr(" AND ".join(
        f"a.{c} <=> b.{c}" for c in (of_key, of_source, of_size, nth))))
    met = met.filter(f"b.{passes} > 0 OR size(b.{spans}) > 0").select(
        *[F.col(f"a.`{c}`") for c in df.columns], f"b.{passes}", f"b.{spans}")
    return met.mapInArrow(functools.partial(
        _written, text=text, chars=chars if chars in df.columns else None), df.schema)
