"""Approximate nearest neighbours over an inverted file of quantised codes.

The vector services searched approximately.  Here a bounded sample of the corpus (``train_rows`` vectors, taken by the
hash of their id) fits ``n_lists`` centroids and, for ``code_bytes`` slices of the vector, 256 sub-centroids each.  Every
corpus row goes to the list of its nearest centroid as a code of ``code_bytes`` bytes; a question probes the ``n_probe``
lists with the nearest centroids, scores their codes by a product with the vectors that they name, and its best
``k * rerank`` rows of a group are scored again on the vectors themselves, which lie beside the codes.  So what leaves a
group is ``k`` rows per question, and what a search moves are the rows once per block of questions.  The best ``k`` are
joined with the vectors by id, as all rows of an id and of a question answer.

Without ``n_probe`` the number of probes is fitted to a recall on sampled questions; with ``n_probe >= n_lists`` the search
is the exact one (:func:`kbspark.operators.topk.topk`).

Skew: a list may hold a large share of the rows.  Lists are packed into groups of about ``max_group_rows`` codes, a larger
list is salted, and questions are dealt into blocks of about ``max_group_questions``, or smaller ones that occupy the
cores; a question is sent once to every group in which it probes a list.  A group is scored in tasks, which keep the best rows per question; no pair rows are
produced.

Vectors of another size than most, null ones and those with numbers that are not finite take no part; :func:`unfit` lists
them.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.operators.topk import (_GROUP_WORK, _ROWS, _SCORE_CELLS, _TILE, _by_size, _ids, _kind, _own_rows, _packed,
                                     _pair_scores, _reduce, _squared, _unpacked, topk)
from kbspark.session import ship_package

# Bytes of the vectors of a group.
_GROUP_BYTES = 64 << 20


def lloyd(points: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """``n`` centroids of a sample (k-means; an empty one takes a random point)."""
    centres = points[rng.choice(len(points), n, replace=False)]
    for _ in range(rounds):
        chunk = max(1, _SCORE_CELLS // n)
        own = np.concatenate([_squared(points[i:i + chunk], centres).argmin(axis=1) for i in range(0, len(points), chunk)])
        count = np.bincount(own, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], points[rng.choice(len(points), n)])
    return centres


@dataclass(frozen=True)
class Codebook:
    """Centroids of the lists, and per slice of the vector the sub-centroids that its bytes name."""

    dim: int
    lists: np.ndarray
    slices: list
    books: list

    @staticmethod
    def fit(sample: np.ndarray, n_lists: int, code_bytes: int, seed: int) -> "Codebook":
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        slices = np.array_split(np.arange(dim), min(code_bytes, dim))
        return Codebook(dim, lloyd(sample, min(n_lists, len(sample)), rng), slices,
                        [lloyd(sample[:, s], min(256, len(sample)), rng) for s in slices])

    def place(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of each vector."""
        own = _squared(vecs, self.lists).argmin(axis=1)
        codes = [_squared(vecs[:, s], b).argmin(axis=1) for s, b in zip(self.slices, self.books)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def near(self, vecs: np.ndarray) -> np.ndarray:
        """All lists of each question, nearest first."""
        return np.argsort(_squared(vecs, self.lists), axis=1, kind="stable")

    def named(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        out = np.zeros((len(codes), self.dim), np.float32)
        for j, (s, b) in enumerate(zip(self.slices, self.books)):
            out[:, s] = b[codes[:, j]]
        return out


def _of_size(vecs, dim: int):
    for at, matrix in _by_size(vecs):
        if matrix.shape[1] == dim:
            return at, matrix
    return np.zeros(0, np.int64), np.zeros((0, dim))


def _encode(batches, book: Codebook, kind: str):
    for pdf in batches:
        for lo in range(0, len(pdf), _ROWS):
            part = pdf.iloc[lo:lo + _ROWS]
            at, vecs = _of_size(part["cv"].to_numpy(), book.dim)
            own, codes = book.place(vecs)
            v, nnz = _packed(vecs, kind)
            yield pd.DataFrame({"id": part["id"].to_numpy()[at], "list": own.astype(np.int32),
                                "code": [c.tobytes() for c in codes], "nnz": nnz, "v": v})


def _probe(batches, book: Codebook, n_probe: int, group_of: np.ndarray, kind: str):
    """Each question once per group in which it probes a list."""
    n = int(group_of.max()) + 1
    for pdf in batches:
        for lo in range(0, len(pdf), _ROWS):
            part = pdf.iloc[lo:lo + _ROWS]
            at, vecs = _of_size(part["qv"].to_numpy(), book.dim)
            asks = np.zeros((len(at), n), bool)
            np.put_along_axis(asks, group_of[book.near(vecs)[:, :n_probe]], True, axis=1)
            v, nnz = _packed(vecs, kind)
            some = part.iloc[at].drop(columns="qv").assign(nnz=nnz, v=v)
            row, group = np.nonzero(asks)
            for i in range(0, len(row), _ROWS):
                yield some.iloc[row[i:i + _ROWS]].assign(group=group[i:i + _ROWS].astype(np.int32))


def _score_codes(codes: pd.DataFrame, qs: pd.DataFrame, book: Codebook, n_probe: int, keep: int, k: int, metric: str,
                 exclude: bool, kinds: tuple[str, str]) -> pd.DataFrame:
    """The best ``k`` rows of a group for each question: by the vectors, of the best ``keep`` by the codes of the lists
    that it probes."""
    none = pd.DataFrame({"qid": qs["qid"].iloc[:0], "id": codes["id"].iloc[:0], "score": np.zeros(0)})
    if not len(codes) or not len(qs):
        return none
    codes = codes.iloc[np.argsort(codes["list"].to_numpy(), kind="stable")]
    ids, C = _ids(codes["id"]), _unpacked(codes["v"].to_numpy(), codes["nnz"].to_numpy(), book.dim, kinds[1])
    names, first = np.unique(codes["list"].to_numpy(), return_index=True)
    last = np.r_[first[1:], len(codes)]
    named = book.named(np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1))
    if metric != "dot":        # larger is better: q.c - c.c / 2
        named = np.concatenate([named, -np.einsum("ij,ij->i", named, named)[:, None] / 2], axis=1)
    order = np.argsort(ids, kind="stable") if exclude else None
    out = []
    for lo in range(0, len(qs), _TILE[0]):
        some = qs.iloc[lo:lo + _TILE[0]]
        Q = _unpacked(some["v"].to_numpy(), some["nnz"].to_numpy(), book.dim, kinds[0])
        probes = np.zeros((len(Q), len(book.lists)), bool)
        np.put_along_axis(probes, book.near(Q.astype(np.float64))[:, :n_probe], True, axis=1)
        left = Q.astype(np.float32)
        if metric != "dot":
            left = np.concatenate([left, np.ones((len(left), 1), np.float32)], axis=1)
        own_r, own_c = _own_rows(_ids(some["qx"]), ids, order) if exclude else (np.zeros(0, np.int64),) * 2
        least = np.full(len(Q), -np.inf, np.float32)
        best = (np.zeros(0, np.int64), ids[:0], np.zeros(0), np.zeros(0, np.int64))
        fresh, waiting = [], 0

        def settle(best, fresh):
            r, c, x = (np.concatenate(y) for y in zip((best[0], best[3], -best[2]), *fresh))
            r, c, key = _kept(r, c, ids, -x, keep)
            return r, ids[c], key, c

        for name, begin, end in zip(names.tolist(), first.tolist(), last.tolist()):
            q = np.flatnonzero(probes[:, name])
            for t in range(begin, end if len(q) else begin, _TILE[1]):
                stop = min(t + _TILE[1], end)
                S = left[q] @ named[t:stop].T
                hit = (own_c >= t) & (own_c < stop) & probes[own_r, name]
                S[np.searchsorted(q, own_r[hit]), own_c[hit] - t] = -np.inf
                flat = np.flatnonzero((S >= least[q][:, None]) & (S > -np.inf))
                fresh.append((q[flat // S.shape[1]], flat % S.shape[1] + t, S.ravel()[flat].astype(np.float64)))
                waiting += len(flat)
                if waiting > 8 * keep * len(Q):
                    best = settle(best, fresh)
                    fresh, waiting = [], 0
                    count = np.bincount(best[0], minlength=len(Q))
                    enough = count == keep
                    least[enough] = -best[2][(np.cumsum(count) - 1)[enough]]
        if fresh:
            best = settle(best, fresh)
        key = _pair_scores(Q, C, best[0], best[3], metric)
        fine = np.isfinite(key)
        r, i, key = _reduce(best[0][fine], best[1][fine], key[fine], k)
        out.append((some["qid"].to_numpy()[r], i, key if metric != "dot" else -key))
    qid, i, score = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"qid": qid, "id": i, "score": score}) if len(qid) else none


def _rescore(batches, metric: str):
    """Exact scores of (question, corpus row) pairs."""
    for pdf in batches:
        if not len(pdf):
            continue
        q, c = (np.stack(pdf[x].to_numpy()).astype(np.float64) for x in ("qv", "cv"))
        score = (q * c).sum(axis=1) if metric == "dot" else ((q - c) ** 2).sum(axis=1)
        yield pdf[["qid", "id"]].assign(score=score)


def _kept(rows, at, ids, key, keep):
    """Best ``keep`` per question row by ``(key, id)``, with their places."""
    order = np.lexsort((ids[at], key, rows))
    rows, at, key = rows[order], at[order], key[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[rank < keep], at[rank < keep], key[rank < keep]


def _fitted_probes(qs: DataFrame, cs: DataFrame, coded: DataFrame, book: Codebook, k: int, metric: str, recall: float,
                   sample: int) -> int:
    """The fewest probes that find ``recall`` of the exact neighbours of a sample of questions, taken by hash."""
    rows = qs.orderBy(F.xxhash64("qid"), "qid").limit(sample).collect()            # sample rows
    rows = [r for r in rows if r["qv"] is not None and len(r["qv"]) == book.dim and np.isfinite(r["qv"]).all()]
    if not rows:
        return 1
    asked = qs.sparkSession.createDataFrame(rows, qs.schema)
    exact = topk(asked, cs, k, metric, q_vec="qv", c_vec="cv", exclude="qx" if "qx" in qs.columns else None)
    found = exact.select("qid", "id").join(coded.select("id", "list"), "id").select("qid", "list").collect()
    if not found:
        return 1
    place = np.argsort(book.near(np.stack([r["qv"] for r in rows]).astype(np.float64)), axis=1)
    at = {r["qid"]: i for i, r in enumerate(rows)}
    needed = np.sort([place[at[r["qid"]], r["list"]] + 1 for r in found])
    return int(needed[math.ceil(recall * len(needed)) - 1])


def _sampled(cs: DataFrame, n: int, train_rows: int) -> np.ndarray | None:
    """Vectors of the most common size among ``train_rows`` corpus rows, taken by the hash of their id."""
    share = min(1.0, 0.95 * train_rows / max(n, 1))
    some = cs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(train_rows).select("id", "cv")
    groups = [m for _, m in _by_size([r["cv"] for r in sorted(some.collect(), key=lambda r: r["id"])])]   # bounded
    return max(groups, key=len, default=None)


def unfit(df: DataFrame, dim: int, key: str = "id", vec: str = "embedding") -> DataFrame:
    """V4: rows that a search leaves out, ``(key, size)``: not ``dim`` numbers, or one that is not finite."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.filter(F.coalesce((F.size(vec) != dim) | odd, F.lit(True)))
            .select(key, F.coalesce(F.size(vec), F.lit(-1)).alias("size")))


def ivf_topk(questions: DataFrame, corpus: DataFrame, k: int = 5, n_lists: int | None = None,
             n_probe: int | None = None, metric: str = "dot", q_id: str = "qid", q_vec: str = "embedding",
             c_id: str = "id", c_vec: str = "embedding", exclude: str | None = None,
             max_group_rows: int = 200_000, max_group_questions: int = 20_000, seed: int = 7,
             recall: float = 0.97, sample: int = 256, train_rows: int = 16_384, code_bytes: int = 16,
             rerank: int = 20, max_lists: int = 4096) -> DataFrame:
    """Approximate top-``k`` ``(qid, rank, id, score)``; exact when ``n_probe >= n_lists``.

    ``train_rows``, ``max_lists`` and ``sample`` bound what is fitted on the driver; every corpus row is coded and every
    row of a probed list is scored.  Scores are those of the vectors, not of the codes.
    """
    spark = questions.sparkSession
    ship_package(spark)            # the scoring function runs in Python workers
    cs = corpus.select(F.col(c_id).alias("id"), F.col(c_vec).alias("cv"))
    qs = questions.select(F.col(q_id).alias("qid"), F.col(q_vec).alias("qv"),
                          *([F.col(exclude).alias("qx")] if exclude else []))
    n = cs.select("id").count()
    vecs = _sampled(cs, n, train_rows)
    lists = n_lists if n_lists is not None else max(1, min(max_lists, int(math.sqrt(n))))

    def exact() -> DataFrame:
        return topk(questions, corpus, k, metric, q_id, q_vec, c_id, c_vec, exclude)

    if vecs is None or (n_probe is not None and n_probe >= min(lists, len(vecs))):
        return exact()
    book = Codebook.fit(vecs, lists, code_bytes, seed)
    id_field = T.StructField("id", cs.schema["id"].dataType)
    kinds = _kind(qs, "qv"), _kind(cs, "cv")
    packed = [T.StructField("nnz", T.IntegerType()), T.StructField("v", T.BinaryType())]
    coded = cs.mapInPandas(functools.partial(_encode, book=book, kind=kinds[1]), T.StructType(
        [id_field, T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()), *packed])).checkpoint()
    if n_probe is None:
        n_probe = _fitted_probes(qs, cs, coded, book, k, metric, recall, sample)
    # One row per list (bounded by max_lists): lists that are neighbours along the main axis share a group.
    count = np.zeros(len(book.lists), np.int64)
    for r in coded.groupBy("list").count().collect():
        count[r["list"]] = r["count"]
    axis = np.linalg.svd(book.lists - book.lists.mean(axis=0), full_matrices=False)[2][0]
    group_of, salts, held = np.zeros(len(count), np.int64), [1], 0
    max_group_rows = max(1, min(max_group_rows, _GROUP_BYTES // (4 * book.dim)))
    for name in np.argsort(book.lists @ axis, kind="stable"):
        if held and held + count[name] > max_group_rows:
            salts.append(1)
            held = 0
        group_of[name] = len(salts) - 1
        held += count[name]
        salts[-1] = max(salts[-1], math.ceil(held / max_group_rows))
    of = spark.createDataFrame([(i, int(g), salts[g]) for i, g in enumerate(group_of.tolist())],
                               "list int, group int, salts int")
    # Blocks of questions, and as many more as occupy the cores.
    n_qs = qs.select("qid").count()
    share = math.ceil(4 * spark.sparkContext.defaultParallelism / sum(salts))
    work = math.ceil(n_qs * n * book.dim / sum(salts) / _GROUP_WORK)
    n_blocks = max(1, math.ceil(n_qs / max_group_questions), min(share, work))
    q_fields = [*[f for f in qs.schema.fields if f.name != "qv"], *packed]
    asked = qs.mapInPandas(
        functools.partial(_probe, book=book, n_probe=n_probe, group_of=group_of, kind=kinds[0]),
        T.StructType([*q_fields, T.StructField("group", T.IntegerType())]))
    of_group = F.broadcast(of.select("group", "salts").distinct())          # max_lists rows at most, as below
    left = (coded.join(F.broadcast(of), "list").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
            .select("group", "salt", "block", "id", "list", "code", "nnz", "v"))
    right = (asked.join(of_group, "group").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).cast("int"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .select("group", "salt", "block", *[f.name for f in q_fields]))
    q_field = T.StructField("qid", qs.schema["qid"].dataType)
    keep, keys = k * rerank, ["group", "salt", "block"]

    def score(codes: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return _score_codes(codes, some, book, n_probe, keep, k, metric, exclude is not None, kinds)

    # The work of a group is not in its bytes, by which adaptive execution would put many into one task.
    parts = max(1, min(2000, 2 * sum(salts) * n_blocks))
    cand = left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)) \
        .applyInPandas(score, T.StructType([q_field, id_field, T.StructField("score", T.DoubleType())]))
    order = F.col("score").desc() if metric == "dot" else F.col("score").asc()
    first = Window.partitionBy("qid").orderBy(order, "id")
    short = cand.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).select("qid", "id")
    pairs = short.join(cs, "id").join(qs.select("qid", "qv"), "qid").select("qid", "id", "qv", "cv")
    scored = pairs.filter(F.size("cv") == F.size("qv")).mapInPandas(
        functools.partial(_rescore, metric=metric), T.StructType([q_field, id_field, T.StructField("score", T.DoubleType())]))
    w = Window.partitionBy("qid").orderBy(order, F.col("id").asc())
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("qid").alias(q_id), "rank", "id", F.round("score", 6).alias("score")))


def recall_at_k(approx: DataFrame, exact: DataFrame, q_id: str = "qid") -> DataFrame:
    """Share of the exact top-k ids that the approximate search also returned."""
    hit = approx.select(q_id, "id").withColumn("_hit", F.lit(1))
    j = exact.select(q_id, "id").join(hit, [q_id, "id"], "left")
    return j.agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"), F.count("*").alias("total")) \
        .select("hits", "total", F.round(F.col("hits") / F.col("total"), 6).alias("recall"))
