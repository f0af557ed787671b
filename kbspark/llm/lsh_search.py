"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner products are made distances: a vector x becomes ``(x, sqrt(M^2 - |x|^2)) / M`` with M the largest norm, a query
``(q / |q|, 0)``; the nearest points are then the largest inner products.  Each of ``tables`` tables hashes a point by
``hashes`` functions ``floor((a . x + b) / w)`` with normal a; a bucket is the tuple.  A query visits the buckets of a
table in order of their estimated success: the probability, under the query's position within its slots and the
distance r of a k-th neighbour, that such a neighbour lies there, until the visited buckets sum to ``success``.  The
candidates of all tables are merged and ranked by their exact inner products on the original vectors in double
precision.

The distance r is fitted on at most ``sample`` vectors (smallest hashes of the id); every vector is indexed.  Buckets
are split into blocks of about ``block`` vectors, and the queries of a bucket into blocks of ``queries``, so a bucket
that holds a third of all vectors is many groups; a group is one matrix product and keeps ``k`` per query.  Queries that
find fewer than k are searched again against all blocks, so small tables give all there is.

Defined results: vectors that are null, zero, of another size than most (ties: the larger), or hold null or non-finite
components take no part, nor do rows without an id; equal scores are ordered by the smaller id; rows with one id are
one candidate, at its best score; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.arrowtext import mix


@dataclass(frozen=True)
class LshParams:
    k: int = 20
    tables: int = 2
    hashes: int = 4
    width: float = 1.5          # of a slot, in distances of a k-th neighbour
    success: float = 0.85       # summed success of the buckets visited in a table
    reach: int = 3              # slots to either side that are considered
    sample: int = 2000
    block: int = 4096
    queries: int = 2048
    seed: int = 20240229


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec array<double>`` of the rows that take part."""
    rows = (df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
            .select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")))
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = most[0]["dim"] if most else 0                                    # one number
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("vec") == dim) & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))


@dataclass(frozen=True)
class Hashing:
    a: np.ndarray               # table x hash x (dim + 1)
    b: np.ndarray
    w: float
    r: float
    top: float

    @staticmethod
    def make(p: LshParams, dim: int, r: float, top: float) -> "Hashing":
        rng = np.random.Generator(np.random.PCG64(p.seed))
        w = p.width * r
        return Hashing(rng.normal(size=(p.tables, p.hashes, dim + 1)), rng.uniform(0, w, (p.tables, p.hashes)), w, r,
                       top)

    def slots(self, points: np.ndarray) -> np.ndarray:
        """Positions in slots: point x table x hash."""
        return (np.einsum("nd,tkd->ntk", points, self.a) + self.b) / self.w

    def points(self, vecs: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top ** 2 - (vecs ** 2).sum(1), 0))
        return np.concatenate([vecs, rest[:, None]], 1) / self.top

    def asked(self, vecs: np.ndarray) -> np.ndarray:
        length = np.sqrt((vecs ** 2).sum(1))
        return np.concatenate([vecs / length[:, None], np.zeros((len(vecs), 1))], 1)


def bucket_ids(slots: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit id of each row of integer slots."""
    acc = np.full(len(slots), np.uint64(table + 1), np.uint64)
    for column in slots.T:
        acc = mix(acc + column.astype(np.int64).view(np.uint64))
    return acc.view(np.int64)


_ERF = np.vectorize(math.erf, otypes=[float])


def probes(position: np.ndarray, w_in_r: float, p: LshParams) -> np.ndarray:
    """The slot tuples that a query at ``position`` visits in one table, by falling success."""
    home = np.floor(position).astype(np.int64)
    offsets = np.arange(-p.reach, p.reach + 1)
    low = (offsets[None, :] - (position - home)[:, None]) * w_in_r
    chance = 0.5 * (_ERF((low + w_in_r) / math.sqrt(2)) - _ERF(low / math.sqrt(2)))
    order = np.argsort(-chance, axis=1, kind="stable")
    cost = -np.log(np.maximum(np.take_along_axis(chance, order, 1), 1e-300))
    n = len(home)
    first = (0,) * n
    heap, seen, total, out = [(float(cost[:, 0].sum()), first)], {first}, 0.0, []
    while heap and total < p.success:
        spent, at = heapq.heappop(heap)
        total += math.exp(-spent)
        out.append([home[i] + offsets[order[i, at[i]]] for i in range(n)])
        for i in range(n):
            if at[i] + 1 < len(offsets):
                then = (*at[:i], at[i] + 1, *at[i + 1:])
                if then not in seen:
                    seen.add(then)
                    heapq.heappush(heap, (spent - cost[i, at[i]] + cost[i, at[i] + 1], then))
    return np.array(out, np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _fit(batches: Iterator[pa.RecordBatch], total: int, top: float, k: int):
    table = pa.Table.from_batches(list(batches))
    if table.num_rows < 2:
        r = 1.0
    else:
        x = _matrix(table.sort_by("id").column("vec").combine_chunks())
        norms = np.sqrt((x ** 2).sum(1))
        s = (x @ x.T) / norms[:, None] / top
        np.fill_diagonal(s, -np.inf)
        # The k-th of all is about this rank among the sample.
        rank = min(max(1, round(k * len(x) / max(total, 1))), len(x) - 1)
        kth = np.sort(s, axis=1)[:, -rank]
        r = float(np.sqrt(np.maximum(2 - 2 * np.mean(kth), 1e-6)))
    yield pa.RecordBatch.from_pydict({"r": [r]})


def _index(batches: Iterator[pa.RecordBatch], h: Hashing):
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            slots = np.floor(h.slots(h.points(_matrix(part.column(1)))))
            for t in range(slots.shape[1]):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket_ids(slots[:, t], t)),
                                                  "id": part.column(0), "vec": part.column(1)})


def _ask(batches: Iterator[pa.RecordBatch], h: Hashing, p: LshParams):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            at = h.slots(h.asked(_matrix(part.column(1))))
            row, bucket = [], []
            for i in range(len(at)):
                for t in range(at.shape[1]):
                    visited = bucket_ids(probes(at[i, t], h.w / h.r, p), t)
                    row.append(np.full(len(visited), i))
                    bucket.append(visited)
            if row:
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.concatenate(bucket)),
                                                  "id": part.column(0).take(take), "vec": part.column(1).take(take)})


_BEST = "query_id long, ids array<long>, scores array<double>"


def _score(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k best vectors of a block for each query of a block."""
    out = {"query_id": [], "ids": [], "scores": []}
    if queries.num_rows and vectors.num_rows:
        ids = vectors.column("id").to_numpy()
        x = _matrix(vectors.column("vec").combine_chunks())
        q = _matrix(queries.column("vec").combine_chunks())
        for i, query in enumerate(queries.column("id").to_pylist()):
            rough = x @ q[i]
            rough[ids == query] = -np.inf
            n = int(np.isfinite(rough).sum())
            if not n:
                continue
            # Rows within rounding of the k-th are summed again in a fixed order: equal vectors get equal scores.
            cut = np.partition(rough, len(rough) - min(k, n))[len(rough) - min(k, n)]
            near = np.flatnonzero(rough >= cut - 1e-9 * max(1.0, abs(cut)))
            exact = (x[near] * q[i]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:k]
            out["query_id"].append(query)
            out["ids"].append(ids[near][best].tolist())
            out["scores"].append(exact[best].tolist())
    return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())),
                                           ("scores", pa.list_(pa.float64()))]))


def _blocks(index: DataFrame, asked: DataFrame, p: LshParams) -> DataFrame:
    """The best of every (bucket, block of vectors, block of queries), from ``bucket, id, vec`` on both sides."""
    zero = F.lit(0).cast("long")
    held = index.groupBy("bucket").agg(F.ceil(F.count("*") / p.block).alias("n_v"))
    wanted = asked.groupBy("bucket").agg(F.ceil(F.count("*") / p.queries).alias("n_q"))
    sizes = held.join(wanted, "bucket")
    vectors = (index.join(sizes, "bucket")
               .select("bucket", F.pmod(F.xxhash64("id"), F.col("n_v")).alias("v"),
                       F.explode(F.sequence(zero, F.col("n_q") - 1)).alias("q"), "id", "vec"))
    queries = (asked.join(sizes, "bucket")
               .select("bucket", F.explode(F.sequence(zero, F.col("n_v") - 1)).alias("v"),
                       F.pmod(F.xxhash64("id"), F.col("n_q")).alias("q"), F.col("id").alias("id"),
                       F.col("vec").alias("vec")))
    score = functools.partial(_score, k=p.k)
    return (queries.groupBy("bucket", "v", "q").cogroup(vectors.groupBy("bucket", "v", "q"))
            .applyInArrow(lambda a, b: score(a, b), _BEST))


def _ranked(best: DataFrame, k: int) -> DataFrame:
    each = (best.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("c"))
            .groupBy("query_id", F.col("c.ids").alias("vec_id")).agg(F.max("c.scores").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def search(df: DataFrame, is_query, p: LshParams = LshParams(), key: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that the condition ``is_query`` (on ``id``) holds for, the
    nearest other rows."""
    rows = usable(df, key, vector)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.sqrt(F.max(F.aggregate(
        "vec", F.lit(0.0), lambda acc, x: acc + x * x))).alias("top")).first()
    n, dim, top = facts["n"], facts["dim"] or 1, facts["top"] or 1.0
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(p.sample).coalesce(1)
    found = sample.mapInArrow(functools.partial(_fit, total=n, top=top, k=p.k), "r double").first() if n else None
    h = Hashing.make(p, dim, found["r"] if found else 1.0, top)
    schema = "bucket long, id long, vec array<double>"
    index = rows.mapInArrow(functools.partial(_index, h=h), schema).checkpoint()
    queries = rows.filter(is_query)
    asked = queries.mapInArrow(functools.partial(_ask, h=h, p=p), schema)
    held = index.groupBy("bucket").agg(F.count("*").alias("n"))
    asked = asked.join(held.select("bucket"), "bucket", "left_semi").checkpoint()
    first = _ranked(_blocks(index, asked, p), p.k).checkpoint()

    # Queries that found fewer than there are: against all blocks.
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(p.k, max(n - 1, 0)))
    short = queries.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti")
    n_all = max(1, math.ceil(n / p.block))
    all_rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_all)).alias("bucket"), "id", "vec")
    everywhere = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_all - 1).cast("long")))
                              .alias("bucket"), "id", "vec")
    again = _ranked(_blocks(all_rows, everywhere, p), p.k)
    done = first.join(enough.select("query_id"), "query_id", "left_semi")
    return done.unionByName(again).withColumn("rank", F.col("rank").cast("int"))
