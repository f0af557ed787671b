"""A learned text embedding (V5, V11): latent semantic vectors by a randomized singular value decomposition.

A text is a row of hashed term weights (``1 + ln tf`` times a smoothed inverse document frequency, unit length); its
embedding is the row times the leading right singular vectors of the whole matrix, unit length again.  Texts are read
once, into their term counts; a dense matrix is never built: a round sends a block of ``dim + over`` directions to the tasks and takes back ``A' A`` times that block, as sums of
the tasks' partial products.  What the driver holds is a table of terms by directions, whatever the number of texts.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.session import ensure_checkpoint_dir, ship_package

_TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class LsaParams:
    dim: int = 64
    over: int = 10       # further directions that steady the leading ones
    terms: int = 4096    # columns that tokens are hashed to
    rounds: int = 4
    seed: int = 7


@functools.lru_cache(maxsize=1 << 18)
def _column(token: str, terms: int) -> int:
    return zlib.crc32(token.encode()) % terms


def term_counts(texts, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of the tokens of texts; a null has none."""
    rows, columns = [], []
    for i, text in enumerate(texts):
        found = [_column(t, terms) for t in _TOKEN.findall(text.lower())] if text else []
        columns.extend(found)
        rows.extend([i] * len(found))
    cell, count = np.unique(np.array(rows, np.int64) * terms + np.array(columns, np.int64), return_counts=True)
    return cell // terms, cell % terms, count


def weighted(texts, idf: np.ndarray) -> np.ndarray:
    """Unit rows of term weights, dense: a bounded batch of texts by ``terms``."""
    return _unit_rows(len(texts), *term_counts(texts, len(idf)), idf)


def _unit_rows(size: int, r: np.ndarray, c: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((size, len(idf)))
    out[r, c] = (1 + np.log(n)) * idf[c]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def _batches(batches, size: int = 256):
    for pdf in batches:
        for lo in range(0, len(pdf), size):
            yield pdf.iloc[lo:lo + size]


_COUNT = np.dtype([("column", "<u4"), ("n", "<u4")])


def _counted(batches, terms: int):
    """Each text as the (column, count) of its tokens."""
    for pdf in _batches(batches):
        r, c, n = term_counts(pdf["text"].tolist(), terms)
        found = np.empty(len(r), _COUNT)
        found["column"], found["n"] = c, n
        end = np.searchsorted(r, np.arange(len(pdf)), "right")
        yield pd.DataFrame({"counts": [x.tobytes() for x in np.split(found, end[:-1])] if len(pdf) else []})


def _read_counts(counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of the tokens of counted texts."""
    found = np.frombuffer(b"".join(counts), _COUNT)
    return (np.repeat(np.arange(len(counts)), [len(x) // _COUNT.itemsize for x in counts]), found["column"].astype(np.int64),
            found["n"].astype(np.int64))


def _frequencies(batches, terms: int):
    """One row a task: texts and, per column, texts that have it."""
    total = np.zeros(terms + 1)
    for pdf in _batches(batches):
        _, c, _ = _read_counts(pdf["counts"].tolist())
        total[:terms] += np.bincount(c, minlength=terms)
        total[terms] += len(pdf)
    yield pd.DataFrame({"v": [total]})


def _products(batches, idf: np.ndarray, block: np.ndarray):
    """The rows of ``A' A block`` that the task's texts add to."""
    total = np.zeros_like(block)
    for pdf in _batches(batches):
        a = _unit_rows(len(pdf), *_read_counts(pdf["counts"].tolist()), idf)
        total += a.T @ (a @ block)
    at = np.flatnonzero(np.abs(total).sum(axis=1))
    if len(at):
        yield pd.DataFrame({"term": at, "v": list(total[at])})


@dataclass(frozen=True)
class LsaModel:
    idf: np.ndarray
    vectors: np.ndarray      # terms x dim
    values: np.ndarray       # singular values

    def embed(self, texts) -> np.ndarray:
        out = weighted(texts, self.idf) @ self.vectors
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit_lsa(df: DataFrame, text: str = "text", p: LsaParams = LsaParams()) -> LsaModel:
    """Fit on all texts of ``df``: one pass over the texts, and over their counts one for the frequencies and
    ``rounds + 1`` for the directions."""
    ship_package(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    texts = (df.select(F.col(text).alias("text"))
             .mapInPandas(functools.partial(_counted, terms=p.terms), "counts binary").checkpoint())
    summed = texts.mapInPandas(functools.partial(_frequencies, terms=p.terms), "v array<double>")
    row = summed.groupBy(F.lit("all")).agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).first()
    total = np.array(row["v"]) if row is not None else np.zeros(p.terms + 1)
    n = total[p.terms]
    idf = np.log((1 + n) / (1 + total[:p.terms])) + 1

    def gram(block: np.ndarray) -> np.ndarray:
        part = texts.mapInPandas(functools.partial(_products, idf=idf, block=block), "term int, v array<double>")
        sums = part.groupBy("term").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        out = np.zeros_like(block)
        for r in sums.collect():                    # a row per term at most
            out[r["term"]] = r["v"]
        return out

    block = np.linalg.qr(np.random.default_rng(p.seed).normal(size=(p.terms, p.dim + p.over)))[0]
    for _ in range(p.rounds):
        block = np.linalg.qr(gram(block))[0]
    small = block.T @ gram(block)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:p.dim]
    return LsaModel(idf, block @ turn[:, order], np.sqrt(np.maximum(values[order], 0)))


def embed_lsa(df: DataFrame, model: LsaModel, text: str = "text", out: str = "embedding") -> DataFrame:
    """Add ``out`` (array<float>, unit length; zeros for a text without tokens)."""
    ship_package(df.sparkSession)

    def embed(s):
        return pd.Series(list(np.concatenate([model.embed(s.iloc[i:i + 256].tolist()) for i in range(0, len(s), 256)]))
                         if len(s) else [], dtype=object)

    embed.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(embed, "array<float>")(F.col(text)))
