"""Toxicity by multiple-instance learning: a document is a bag of sentences and only documents carry labels.

A sentence's score is a logistic function of its words; a document's score is the noisy-or of its sentences,
``1 - prod(1 - p)``: one offending sentence is enough.  The weights are fitted on document labels by gradient steps
through the noisy-or (AdaGrad, with an L1 proximal step that keeps few words), and the sentence scores then say where
the offence is (``locate``).

A sentence's features are its words, runs of letters (ASCII letters as a-z, and all bytes of non-ASCII characters), and
the first 4, 5 and 6 bytes of longer words, so that stems carry over to forms not seen in fitting; sentences end at
``.!?`` and newlines.  Features are known by 64-bit hashes: unseen ones weigh nothing and no two share a weight.

Fitting takes a bounded sample of labelled keys that have a text, one row a key: the ``max_docs`` smallest by a hash of
the key, long texts last, each taken if its text still fits into ``max_chars`` characters and passed over if not.  Keys
and lengths alone decide; then the chosen texts are read and fitted in one task, on the ``max_words`` features whose document counts differ
most between the classes, and that model goes to the driver.  Scoring streams over all rows with NumPy, about a megabyte of text at a time.

Defined results: a null or empty text scores 0; labels that are null are not learned from; without rows of both classes
every score is 0; repeated rows score alike; a key with several texts is learned from the one with the smallest hash,
one with several labels is toxic if any is; ties in the sample are broken by the key; an empty table gives an empty table; ``score`` and ``locate`` read only the named columns, ``keep`` returns all columns of its input unchanged.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.arrowtext import LOWER, mix, raw_text, rows_of, runs, slices, span_hashes


@dataclass(frozen=True)
class FitParams:
    max_docs: int = 6000
    max_chars: int = 16_000_000
    max_words: int = 16_384
    min_docs: int = 3          # a feature counts if that many sample documents hold it
    epochs: int = 200
    rate: float = 0.5
    l1: float = 1e-4
    bias: float = -8.0


@dataclass(frozen=True)
class Model:
    words: np.ndarray          # sorted 64-bit hashes
    weights: np.ndarray
    bias: float

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, words=self.words, weights=self.weights, bias=np.array([self.bias]))
        return out.getvalue()

    @staticmethod
    def unpacked(raw: bytes) -> "Model":
        with np.load(io.BytesIO(raw)) as z:
            return Model(z["words"], z["weights"], float(z["bias"][0]))


_LETTER = np.ones(256, bool)                      # True: not part of a word
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


PREFIXES = (4, 5, 6)
LONG = 64                  # a text of more than this part of max_chars is taken after the others


def parse(column: pa.Array):
    """(feature hashes, sentence of each, row of each sentence, sentence starts, sentence ends, bytes, bounds)."""
    data, bounds = raw_text(column)
    lower = LOWER[data]
    starts, ends = runs(data, bounds, _LETTER)
    s_starts, s_ends = runs(data, bounds, _STOP)
    sentence = np.searchsorted(s_starts, starts, side="right") - 1
    hashes, of = [span_hashes(lower, starts, ends)], [sentence]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        hashes.append(mix(span_hashes(lower, starts[longer], starts[longer] + size) + np.uint64(size)))
        of.append(sentence[longer])
    return np.concatenate(hashes), np.concatenate(of), rows_of(s_starts, bounds), s_starts, s_ends, data, bounds


def _sums(index: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights, minlength=n)


def _once(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two index arrays, b below width."""
    return np.divmod(np.unique(a.astype(np.int64) * width + b), width)


def screened(parts: list[pa.Array], labels: list[np.ndarray], p: FitParams) -> np.ndarray:
    """The features whose document counts differ most between the classes, by a two-sample z score; sorted."""
    pos, neg = [], []
    for part, y in zip(parts, labels):
        hashes, sentence, row, *_ = parse(part)
        values, index = np.unique(hashes, return_inverse=True)
        if len(values):
            doc, feature = _once(row[sentence], index, len(values))
            pos.append(values[feature[y[doc] == 1]])
            neg.append(values[feature[y[doc] != 1]])
    if not pos:
        return np.zeros(0, np.uint64)
    n_pos, n_neg = (sum(int((y == k).sum()) for y in labels) for k in (1, 0))
    a_values, a_counts = np.unique(np.concatenate(pos), return_counts=True)
    b_values, b_counts = np.unique(np.concatenate(neg), return_counts=True)
    values = np.union1d(a_values, b_values)
    a, b = np.zeros(len(values)), np.zeros(len(values))
    a[np.searchsorted(values, a_values)] = a_counts
    b[np.searchsorted(values, b_values)] = b_counts
    share = (a + b) / (n_pos + n_neg)
    z = (a / n_pos - b / n_neg) / np.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg) + 1e-12)
    frequent = np.flatnonzero(a + b >= p.min_docs)
    best = frequent[np.argsort(-np.abs(z[frequent]), kind="stable")[:p.max_words]]
    return np.sort(values[best])


def fit_texts(parts: list[pa.Array], labels: list[np.ndarray], p: FitParams) -> Model:
    """Weights from texts and their labels, given in runs of rows."""
    both = np.concatenate(labels) if labels else np.zeros(0, np.int64)
    if len(both) == 0 or both.min() == both.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), -np.inf)
    words = screened(parts, labels, p)
    s, f, row = [], [], []
    n_s = n_d = 0
    for part, y in zip(parts, labels):
        hashes, sentence, of, *_ = parse(part)
        at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
        known = np.flatnonzero(words[at] == hashes) if len(words) else np.zeros(0, np.int64)
        a, b = _once(sentence[known], at[known], max(len(words), 1))          # a feature counts once a sentence
        s.append(a + n_s)
        f.append(b)
        row.append(of + n_d)
        n_s, n_d = n_s + len(of), n_d + len(y)
    s, f, row = np.concatenate(s), np.concatenate(f), np.concatenate(row)
    w, b = np.zeros(len(words)), p.bias
    g2, b2 = np.full(len(words), 1e-6), 1e-6
    y = both[row].astype(bool)
    for _ in range(p.epochs):
        z = b + _sums(s, w[f], n_s)
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none_bad = np.exp(np.clip(_sums(row, -np.logaddexp(0, z), n_d), -50, -1e-9))       # 1 - P of the bag
        d_z = np.where(y, -(none_bad / (1 - none_bad))[row], 1.0) * prob / n_d
        grad, grad_b = _sums(f, d_z[s], len(words)), d_z.sum()
        g2 += grad ** 2
        b2 += grad_b ** 2
        step = p.rate / np.sqrt(g2)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * p.l1, 0)
        b -= p.rate * grad_b / np.sqrt(b2)
    heavy = np.flatnonzero(w)
    return Model(words[heavy], w[heavy].astype(np.float32), float(b))


def _fit(batches: Iterator[pa.RecordBatch], p: FitParams):
    table = pa.Table.from_batches(list(batches))
    if table.num_rows:
        table = table.sort_by([("fit_order", "ascending"), ("fit_text", "ascending")])
        parts = [part for batch in table.combine_chunks().to_batches() for part in slices(batch, "fit_text")]
        model = fit_texts([part.column(part.schema.get_field_index("fit_text")) for part in parts],
                          [part.column(part.schema.get_field_index("fit_label")).to_numpy() for part in parts], p)
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.packed()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, params: FitParams = FitParams(), key: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """A model from the rows of ``labels`` (key, 0/1) and the texts of ``docs``."""
    learn = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
             .groupBy(F.col(key).alias("fit_key")).agg(F.max(F.col(label).cast("int")).alias("fit_label")))
    texts = (docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
             .select(F.col(key).alias("fit_key"), F.length(text).cast("long").alias("fit_size"),
                     F.xxhash64(text).alias("fit_hash"), F.col(text).alias("fit_text")))
    # Of the texts of one key that fit at all the one with the smallest hash; numbers only, reduced before the shuffle.
    sized = (texts.filter(F.col("fit_size") <= params.max_chars).groupBy("fit_key")
             .agg(F.min_by("fit_size", "fit_hash").alias("fit_size"), F.min("fit_hash").alias("fit_hash")))
    first = (sized.join(learn, "fit_key").withColumn("fit_order", F.xxhash64("fit_key"))
             .orderBy(F.col("fit_size") > params.max_chars // LONG, "fit_order", "fit_key").limit(params.max_docs))
    chosen, left = [], params.max_chars
    for row in first.collect():                                        # max_docs rows of a key and four numbers
        if row["fit_size"] <= left:
            chosen.append(row)
            left -= row["fit_size"]
    # The chosen keys: a broadcast of a proven size.
    sample = (texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, first.schema)),
                         ["fit_key", "fit_size", "fit_hash"])
              .dropDuplicates(["fit_key"]).select("fit_order", "fit_text", "fit_label"))
    rows = sample.coalesce(1).mapInArrow(functools.partial(_fit, p=params), "model binary").collect()
    if not rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), -np.inf)
    return Model.unpacked(bytes(rows[0][0]))


def sentence_scores(model: Model, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """The log-odds of each of n sentences; a word counts once a sentence."""
    z = np.full(n, model.bias)
    if len(model.words) and len(hashes):
        at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
        known = np.flatnonzero(model.words[at] == hashes)
        if len(known):
            of, feature = _once(sentence[known], at[known], len(model.words))
            z += _sums(of, model.weights[feature].astype(float), n)
    return z


def measure(model: Model, column: pa.Array):
    """(document scores, sentence log-odds, and what ``parse`` found)."""
    found = parse(column)
    hashes, sentence, row = found[:3]
    z = sentence_scores(model, hashes, sentence, len(row))
    clean = _sums(row, -np.logaddexp(0, z), len(column))
    return 0.0 - np.expm1(clean), z, found


def _score(batches: Iterator[pa.RecordBatch], model: Model, key: str, text: str):
    for batch in batches:
        for part in slices(batch, text):
            score, _, _ = measure(model, part.column(part.schema.get_field_index(text)))
            yield pa.RecordBatch.from_pydict({key: part.column(part.schema.get_field_index(key)),
                                              "score": pa.array(score, pa.float64())})


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score``: the noisy-or of every text's sentences."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(functools.partial(_score, model=model, key=key, text=text),
                                           f"`{key}` {kind}, score double")


def _keep(batches: Iterator[pa.RecordBatch], model: Model, text: str, threshold: float):
    for batch in batches:
        for part in slices(batch, text):
            got, _, _ = measure(model, part.column(part.schema.get_field_index(text)))
            yield part.filter(pa.array(got < threshold))


def keep(df: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that score below the threshold, all columns as they are."""
    return df.mapInArrow(functools.partial(_keep, model=model, text=text, threshold=threshold), df.schema)


def _locate(batches: Iterator[pa.RecordBatch], model: Model, key: str, text: str, threshold: float):
    for batch in batches:
        for part in slices(batch, text):
            _, z, (_, _, row, starts, ends, data, bounds) = measure(
                model, part.column(part.schema.get_field_index(text)))
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            hit = np.flatnonzero(z >= np.log(threshold / (1 - threshold)))
            keys = part.column(part.schema.get_field_index(key)).take(pa.array(row[hit]))
            base = point[bounds[row[hit]]]
            yield pa.RecordBatch.from_pydict({
                key: keys, "start": pa.array(point[starts[hit]] - base, pa.int64()),
                "end": pa.array(point[ends[hit]] - base, pa.int64()),
                "sentence_score": pa.array(1 / (1 + np.exp(-z[hit])), pa.float64())})


def locate(df: DataFrame, model: Model, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start, end, sentence_score``: the offending sentences, in code points from 0."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(
        functools.partial(_locate, model=model, key=key, text=text, threshold=threshold),
        f"`{key}` {kind}, start long, end long, sentence_score double")
