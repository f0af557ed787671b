"""Periodic runs of words: stretches that repeat one root three times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(least, 3 * q)`` words that no neighbouring word extends.  Per document, by internal pattern matching:

* a suffix array of the words by prefix doubling; the suffixes that agree on a dyadic block (2**j words) are one range
  of it, known when the array has been sorted to that depth;
* for every aligned block of B = 2**j words its next occurrences in the window of 2 * B words after it, by range
  successor in a wavelet tree over the suffix array.  Occurrences less than B / 2 apart are a progression: the block
  itself is periodic then, and the search goes on after the stretch with that small period;
* candidates for a period are the distance to an occurrence and, for progressions, the distances between the ends of
  the two stretches.  Every candidate is extended to both sides and kept if it is long enough; of equal stretches the
  smallest period stays.

No run is missed: with B the largest power of two up to q (8 for smaller q) a run holds an aligned block together with
its copy q words on.  If B >= q that copy is the next occurrence.  Else, if the block is not periodic, all occurrences in
the window are visited; if it is, its stretch and that of the copy are different ones (else the root would be a power)
and begin or end q words apart, since they cannot reach over both ends of the run.

Documents of a batch are searched together, a bounded run of rows at a time; memory follows the longest text, not the
partition.  Nothing is shuffled.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated rows give repeated
rows; a null key is carried along; an empty table gives an empty table; only the named columns are read.  Words are
compared by 64-bit hashes, and every run that is reported has been compared word by word.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.arrowtext import SPACE, mix, raw_text, rows_of, runs, slices, span_hashes
from kbspark.llm.suffixes import Stretches, WaveletTree

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class RunParams:
    least: int = 24        # words of the shortest run
    block: int = 8         # smallest dyadic block (3 * block <= least)
    window: int = 4 << 20  # bytes of text searched at once


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first index of each entry's group in that order)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    return order, first[np.cumsum(new) - 1]


def block_ranges(symbols: np.ndarray, offset: np.ndarray, p: RunParams, longest: int):
    """Suffix array by prefix doubling, and the range of it for every aligned block that occurs twice.

    ``symbols`` hold unique separators around rows, ``offset`` the place in its row (-1 for separators).
    Returns (array, blocks), blocks being (place, words, low, high) with ranges of the returned array, which has only
    the suffixes that agree with another on the smallest block.
    """
    n = len(symbols)
    order, first = _groups(symbols)
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = first, n
    slots = np.arange(n)
    depth, array, found = 1, None, []

    def shared(slots, first):
        """The slots whose group has two members at least."""
        same = first[1:] == first[:-1]
        keep = np.zeros(len(slots), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return keep

    while True:
        keep = shared(slots, first)
        slots, order, first = slots[keep], order[keep], first[keep]
        if not len(slots) or depth * 3 > longest and depth >= p.block:
            break
        if depth >= p.block:
            if array is None:
                base, array = slots, np.empty(len(slots), np.int64)
            at = np.flatnonzero((offset[order] >= 0) & (offset[order] % depth == 0))
            low = first[at]
            size = np.searchsorted(first, low, side="right") - np.searchsorted(first, low, side="left")
            found.append((order[at], np.full(len(at), depth), low, low + size))
            array[np.searchsorted(base, slots)] = order
        # The entry and the one ``depth`` words on; beyond the end there is a separator, which is alone.
        after = rank[np.minimum(order + depth, n)]
        by = np.lexsort((after, first))
        order, first, after = order[by], first[by], after[by]
        new = np.ones(len(slots), bool)
        new[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        first = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank[order] = first
        if array is not None:
            array[np.searchsorted(base, slots)] = order
        depth *= 2
    if not found:
        return np.zeros(0, np.int64), None
    place, words, low, high = (np.concatenate(x) for x in zip(*found))
    return array, (place, words, np.searchsorted(base, low), np.searchsorted(base, high))


def find(words: np.ndarray, bounds: np.ndarray, p: RunParams = RunParams()):
    """(row, start, length, period) of all runs of rows of word hashes, by row, start and period."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes >= p.least)
    if not len(rows):
        return none
    # A separator before every row and one at the end; a row's words are symbols of its own.
    count = sizes[rows]
    base = np.cumsum(count + 1) - count
    n = int(base[-1] + count[-1]) + 1
    owner = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    symbols = mix(np.arange(n, dtype=np.uint64) + np.uint64(0x5EB0000000000000))
    place = base[owner] + offset
    symbols[place] = mix(words[bounds[rows][owner] + offset] ^ mix(owner.astype(np.uint64)))
    offsets = np.full(n, -1, np.int64)
    offsets[place] = offset
    array, blocks = block_ranges(symbols, offsets, p, int(count.max()))
    if blocks is None:
        return none
    tree, text = WaveletTree(array), Stretches(symbols)

    def stretch(at, period):
        """The bounds of the stretch around ``at`` that has a period."""
        right = text.ahead(at, at + period, n - at - period)
        left = text.behind(at, at + period, at)
        return at - left, at + period + right

    found = []

    def candidate(at, period):
        ok = period > 0
        at, period = at[ok], period[ok]
        ok = at + period < n
        at, period = at[ok], period[ok]
        at, period = np.unique(np.stack([at, period]), axis=1)
        a, b = stretch(at, period)
        ok = b - a >= np.maximum(p.least, 3 * period)
        found.append(np.unique(np.stack([a[ok], b[ok], period[ok]]), axis=1))

    s, size, low, high = blocks
    last, bound = s, s + 1
    while len(s):
        got = tree.successor(low, high, bound)
        ok = (got >= 0) & (got - s < 2 * size)
        s, size, low, high, last, got = (x[ok] for x in (s, size, low, high, last, got))
        if not len(s):
            break
        candidate(s, got - s)
        bound = got + 1
        step = got - last
        i = np.flatnonzero(2 * step <= size)
        if len(i):
            a, b = stretch(last[i], step[i])
            own_a, own_b = stretch(s[i], step[i])
            candidate(s[i], a - own_a)
            candidate(s[i], b - own_b)
            bound[i] = np.maximum(bound[i], b - size[i] + 1)
        last = got
    a, b, period = np.unique(np.concatenate(found, axis=1), axis=1)
    # Of one stretch the smallest period (np.unique has sorted them).
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, period = a[first], b[first], period[first]
    exact = [_exact(symbols, *run) for run in zip(a.tolist(), b.tolist(), period.tolist())]
    got = sorted({x for x in exact if x[1] - x[0] >= max(p.least, 3 * x[2])}, key=lambda x: (x[0], x[2]))
    if not got:
        return none
    a, b, period = np.array(got).T
    row = np.searchsorted(base, a, side="right") - 1
    return rows[row], a - base[row], b - a, period


def _exact(symbols: np.ndarray, a: int, b: int, q: int) -> tuple[int, int, int]:
    """The run as it is, should two different stretches ever have had one hash: cut at the first word that differs."""
    wrong = np.flatnonzero(symbols[a:b - q] != symbols[a + q:b])
    return (a, b, q) if not len(wrong) else (a, a + int(wrong[0]) + q, q)


Rewrite = Callable[[object, int], "np.ndarray | None"]


def _search(batches: Iterator[pa.RecordBatch], p: RunParams, rewrite: Rewrite | None):
    for batch in batches:
        for part in slices(batch, "text", p.window):
            data, ends = raw_text(part.column(1))
            starts, stops = runs(data, ends, SPACE)
            words, n = span_hashes(data, starts, stops), part.num_rows
            bounds = np.searchsorted(rows_of(starts, ends), np.arange(n + 1))
            changed = {}
            if rewrite is not None:
                for row, key in enumerate(part.column(0).to_pylist()):
                    size = int(bounds[row + 1] - bounds[row])
                    source = rewrite(key, size) if size else None
                    if source is not None:
                        changed[row] = source
                        words[bounds[row]:bounds[row + 1]] = words[bounds[row] + source]
            row, start, length, period = find(words, bounds, p)
            at = np.searchsorted(row, np.arange(n + 1))
            text, whole = [], data.tobytes()
            for i in range(n):
                own = whole[ends[i]:ends[i + 1]].split()
                if i in changed:
                    own = [own[k] for k in changed[i].tolist()]
                if at[i] < at[i + 1]:
                    drop = np.zeros(len(own) + 1, np.int64)
                    np.add.at(drop, start[at[i]:at[i + 1]] + period[at[i]:at[i + 1]], 1)
                    np.add.at(drop, start[at[i]:at[i + 1]] + length[at[i]:at[i + 1]], -1)
                    own = [own[k] for k in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
                text.append(b" ".join(own))
            found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), found),
                 pa.array(text, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])


def detect(df: DataFrame, p: RunParams = RunParams(), key: str = "doc_id", text: str = "text",
           rewrite: Rewrite | None = None) -> DataFrame:
    """``key, n_words, runs, collapsed``: all runs (start, length, period; by start, then period) of every row's text,
    and its words, joined by one space, without those that a run holds after its first period.

    ``rewrite(key, n_words)`` may name, per row, the words to take instead (an array of word numbers, or None).
    """
    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(functools.partial(_search, p=p, rewrite=rewrite),
                        f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                        "collapsed string").withColumnRenamed("key", key))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the number of runs, its strongest run (greatest length / period, then smallest start and period) and
    digests of all runs and of the collapsed text."""
    def better(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (a > b) | ((a == b) & ((x["start"] < y["start"])
                                      | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))

    # The first run, then whichever is better; without runs it stays null.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(better(y, x), y).otherwise(x))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return (found.withColumn("best", best)
            .select(key, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
