"""Suffix-array removal of repeated text: maximal repeats with all their occurrences, as a common-prefix interval tree.

A repeat is a string of at least ``length`` bytes that starts at two places or more, in one text or in several; matches
never cross texts.  Its bytes are removed at every place.

1. ``texts``: equal texts are one text with a number of copies (keyed by half of their SHA-256), so copies are never
   expanded.
2. ``pieces``: every window of ``length`` bytes has an anchor, the smallest hash of its ``gram``-byte strings.  A run of
   windows with one anchor value is a piece.  Equal windows have equal anchors, so they lie in pieces of one anchor
   value, and only those are compared.  Of a piece only hashes are shuffled, about one row per 80 bytes of text.
3. An anchor value met once repeats nothing.  If all its pieces are equal, all are repeats.  Else its distinct pieces
   are cut out of one example text each and sorted together:
4. ``maximal_repeats``: an enhanced suffix array (suffixes and the lengths of common prefixes of neighbours) over the
   pieces of a block; a stack scan finds its intervals of common prefix ``length`` and more, and those whose suffixes
   differ in the byte to their left (or have none) are the maximal repeats, each with all its occurrences.  Suffixes
   whose whole window class has one byte to the left start no such interval and are left out first.
5. An anchor value with many different pieces (a passage that many texts embed) is dealt into blocks of bounded size by
   the pieces' hashes.  Each block then has one row per window class, the rows are counted over all blocks, and windows
   that are alone in their block and met in another are repeats too.
6. The repeated spans of a text are merged and cut out of it.

Repeats longer than a piece show as repeats of consecutive pieces, merged into one span per text.

Scale: pieces are reduced by key before and in each shuffle; joins are plain equi-joins on hashed keys that adaptive
execution splits where they are skewed.  Texts are shuffled once, into a table bucketed by their key, and later joined
there.  Tables between the steps lie in the shared checkpoint folder and go when no later step reads them.

Defined results: a null text has no bytes and nothing is removed; texts shorter than ``length`` are left alone; a repeated
row's text is a repeat if it is long enough; null keys are carried along; an empty table gives an empty table; only the
named columns are read.  Equality of strings is that of 64-bit hashes within an anchor value, itself 64 bits.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.arrowtext import _BYTE, raw_text, rows_of, slices
from kbspark.llm.components import forget_shuffles
from kbspark.llm.suffixes import Stretches
from kbspark.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class RepeatParams:
    length: int = 200      # bytes of the shortest repeat
    gram: int = 32         # bytes that an anchor is the hash of
    span: int = 4096       # windows of a piece at most
    block: int = 2 << 20   # bytes of pieces in one suffix array
    window: int = 1 << 20  # bytes of text cut into pieces at once


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values, by running minima to both sides of every width-th place."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)
    rows = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1:width - 1 + n])


def cut(data: np.ndarray, bounds: np.ndarray, p: RepeatParams):
    """(row, start, size, anchor, hash, inner) of the pieces of a run of texts; ``inner`` marks pieces that may hold two
    equal windows themselves (an anchor gram twice)."""
    none = np.zeros(0, np.int64)
    n, width = len(data), p.length - p.gram + 1
    if n < p.length:
        return none, none, none, none, none, none.astype(bool)
    text = Stretches(_BYTE[data])
    at = np.arange(n - p.gram + 1)
    grams = text.hashes(at, p.gram)
    least = sliding_least(grams, width)
    # Windows that would leave their row.
    steps = np.zeros(len(least) + 1, np.int64)
    ends = bounds[1:]
    np.add.at(steps, np.clip(ends - p.length + 1, 0, len(least)), 1)
    np.add.at(steps, np.clip(ends, 0, len(least)), -1)
    inside = np.cumsum(steps)[:-1] <= 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none, none, none.astype(bool)
    # A piece ends before the next one or before windows outside.
    total = np.concatenate([[0], np.cumsum(inside)])
    count = total[np.concatenate([first[1:], [len(least)]])] - total[first]
    if count.max() > p.span:
        parts = -(-count // p.span)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(np.repeat(count, parts) - k * p.span, p.span)
        first = np.repeat(first, parts) + k * p.span
    size = count + p.length - 1
    # Two neighbouring anchor grams of one value within a piece.
    anchor = least[first]
    chosen = np.flatnonzero(_chosen(grams, least, width))
    pair = np.flatnonzero(grams[chosen[1:]] == grams[chosen[:-1]])
    left, right = chosen[pair], chosen[pair + 1]
    nearest = np.searchsorted(left, first)
    inner = np.zeros(len(first), bool)
    some = nearest < len(left)
    inner[some] = right[nearest[some]] <= (first + size - p.gram)[some]
    row = rows_of(first, bounds)
    return (row, first - bounds[row], size, anchor.view(np.int64), text.hashes(first, size).view(np.int64), inner)


def _chosen(grams, least, width):
    """Grams that are the smallest of some window: the largest minimum of the windows around a gram is the gram itself."""
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = ~sliding_least(~padded, width)
    return most[:len(grams)] == grams


def _cut_rows(batches: Iterator[pa.RecordBatch], p: RepeatParams):
    """Pieces of ``sha, copies, text``; a text longer than the window is cut in overlapping parts."""
    for batch in batches:
        for part in slices(batch, "text", p.window):
            data, bounds = raw_text(part.column(2))
            keys, copies = part.column(0), part.column(1)
            for lo in range(0, max(1, len(data)), p.window) if part.num_rows == 1 else (0,):
                if part.num_rows == 1:
                    some = data[lo:lo + p.window + p.length - 1]
                    row, start, size, anchor, name, inner = cut(some, np.array([0, len(some)]), p)
                    start = start + lo
                else:
                    row, start, size, anchor, name, inner = cut(data, bounds, p)
                rows = pa.array(row)
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(anchor), "piece": pa.array(name), "sha": keys.take(rows), "start": pa.array(start),
                    "size": pa.array(size.astype(np.int32)), "copies": copies.take(rows), "inner": pa.array(inner)})


def suffix_array(data: np.ndarray, bounds: np.ndarray, p: RepeatParams):
    """The suffixes of pieces that may start a maximal repeat, sorted, with the length of the prefix each shares with the
    next one (0 where that is shorter than ``length``), the byte to the left (-1: none), and the class of every window:
    (array, common, left, window starts, window hashes)."""
    text = Stretches(_BYTE[data])
    stop = np.repeat(bounds[1:], np.diff(bounds))
    windows = np.flatnonzero(np.arange(len(data)) + p.length <= stop)
    names = text.hashes(windows, p.length)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    left = np.full(len(data), -1, np.int64)
    left[1:] = data[:-1]
    left[bounds[:-1][np.diff(bounds) > 0]] = -1
    own = left[windows[order]]
    begin = np.flatnonzero(new)
    if len(begin):
        mixed = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
        mixed |= np.minimum.reduceat(own, begin) < 0
        many = np.diff(np.concatenate([begin, [len(order)]])) > 1
        use = (mixed & many)[group]
    else:
        use = np.zeros(0, bool)
    at, rank = windows[order[use]], group[use].astype(np.int64)
    # Refine by eight bytes at a time where suffixes still agree; a shorter one goes first.
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    live, depth = np.arange(len(at)), p.length
    while len(live):
        here = at[live]
        rest = np.clip(stop[here] - here - depth, 0, 8)
        index = np.minimum(here[:, None] + depth + np.arange(8), len(padded) - 1)
        word = np.where(np.arange(8) < rest[:, None], padded[index], 0).astype(np.uint64)
        word = (word << np.arange(56, -8, -8).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
        by = np.lexsort((rest, word, rank[live]))
        at[live] = here[by]
        rank_, word, rest = rank[live], word[by], rest[by]     # ranks are sorted already
        same = np.zeros(len(live), bool)
        same[1:] = (rank_[1:] == rank_[:-1]) & (word[1:] == word[:-1]) & (rest[1:] == rest[:-1]) & (rest[1:] == 8)
        rank[live] = live[np.flatnonzero(~same)][np.cumsum(~same) - 1] + len(data)
        keep = same.copy()
        keep[:-1] |= same[1:]
        live, depth = live[keep], depth + 8
    common = np.zeros(len(at), np.int64)
    if len(at) > 1:
        one, two = np.minimum(at[:-1], at[1:]), np.maximum(at[:-1], at[1:])
        close = names[np.searchsorted(windows, at[:-1])] == names[np.searchsorted(windows, at[1:])]
        most = np.minimum(stop[one] - one, stop[two] - two)
        common[:-1][close] = text.ahead(one[close], two[close], most[close])
    return at, common, left[at], windows, names


def maximal_repeats(common: np.ndarray, left: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """All maximal repeats of a suffix array as intervals ``(low, high, length)``, and for every suffix the longest of
    those that it begins (0: none).

    A stack scan over the common prefixes; an interval holds the suffixes that share ``length`` bytes, and is kept if the
    bytes to their left differ.
    """
    groups, longest = [], np.zeros(len(common), np.int64)
    stack: list[list] = []          # [length, low, byte to the left (-1: differs), suffixes without a repeat so far]
    shared, befores = common.tolist(), left.tolist()
    for i, before in enumerate(befores):
        low, byte, open_ = i, before, [i]
        length = shared[i]
        # Intervals deeper than the prefix shared with the next suffix end here.
        while stack and stack[-1][0] > length:
            top = stack.pop()
            byte = byte if byte == top[2] else -1
            if len(open_) > len(top[3]):
                open_, top[3] = top[3], open_
            top[3].extend(open_)
            open_, low = top[3], top[1]
            if byte < 0:
                groups.append((low, i + 1, top[0]))
                longest[open_] = top[0]
                open_ = []
        if length:
            if stack and stack[-1][0] == length:
                top = stack[-1]
                top[2] = byte if byte == top[2] else -1
                if len(open_) > len(top[3]):
                    open_, top[3] = top[3], open_
                top[3].extend(open_)
            else:
                stack.append([length, low, byte, open_])
    return groups, longest


SORTED = "anchor long, salt int, piece long, first int, last int, name long"


def _sorted_block(anchors, salts, pieces, copies, split, texts, p: RepeatParams) -> pa.RecordBatch:
    """Covered stretches of the pieces of a block (``name`` null), and for anchor values of several blocks a row per window
    that is alone here and one per class of equal windows (no piece)."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at, common, left, windows, names = suffix_array(data, bounds, p)
    _, longest = maximal_repeats(common, left)
    steps = np.zeros(len(data) + 1, np.int64)
    hit = longest > 0
    np.add.at(steps, at[hit], 1)
    np.add.at(steps, at[hit] + longest[hit], -1)
    covered = np.cumsum(steps)[:-1] > 0
    whole = np.repeat(copies > 1, np.diff(bounds))
    covered |= whole
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[:-1]] = True
    begin = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate([[False], covered[:-1]])))
    end = np.flatnonzero(covered & (edge[1:] | ~np.concatenate([covered[1:], [False]]))) + 1
    owner = rows_of(begin, bounds)
    out = [(owner, begin - bounds[owner], end - bounds[owner], None)]
    if split.any():
        of = rows_of(windows, bounds)
        some = split[of]
        w, name, of = windows[some], names[some], of[some]
        order = np.lexsort((w, name))
        new = np.ones(len(order), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        single = new.copy()
        single[:-1] &= new[1:]
        single &= copies[of[order]] == 1
        lone = order[single]
        out.append((of[lone], w[lone] - bounds[of[lone]], w[lone] - bounds[of[lone]] + p.length, name[lone]))
        rest = order[new & ~single]
        out.append((of[rest], np.full(len(rest), -1), np.full(len(rest), -1), name[rest]))
    owner = np.concatenate([x[0] for x in out])
    named = np.concatenate([np.zeros(len(x[0]), np.uint64) if x[3] is None else x[3] for x in out]).view(np.int64)
    plain = np.concatenate([np.full(len(x[0]), x[3] is None) for x in out])
    return pa.RecordBatch.from_pydict({
        "anchor": pa.array(anchors[owner]), "salt": pa.array(salts[owner]), "piece": pa.array(pieces[owner]),
        "first": pa.array(np.concatenate([x[1] for x in out]).astype(np.int32)),
        "last": pa.array(np.concatenate([x[2] for x in out]).astype(np.int32)),
        "name": pa.array(named, mask=plain)})


def _sort_blocks(batches: Iterator[pa.RecordBatch], p: RepeatParams):
    """Rows sorted by (anchor, salt): whole groups, as many as a block holds, in one suffix array each."""
    held, texts, size, last = [], [], 0, None

    def done():
        columns = [np.array(x) for x in zip(*held)]
        return _sorted_block(*(c.astype(t) for c, t in zip(columns, (np.int64, np.int32, np.int64, np.int64, bool))), texts, p)

    for batch in batches:
        for anchor, salt, piece, copies, split, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (anchor, salt) != last and size >= p.block:
                yield done()
                held, texts, size = [], [], 0
            last = (anchor, salt)
            held.append((anchor, salt, piece, copies, split))
            texts.append(text)
            size += len(text)
    if held:
        yield done()


def _examples(batches: Iterator[pa.RecordBatch]):
    """The bytes of the wanted pieces of texts, in batches of bounded size."""
    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
            names=["anchor", "salt", "piece", "copies", "split", "bytes"])

    rows, size = [], 0
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for w in wanted.as_py():
                rows.append((w["anchor"], w["salt"], w["piece"], w["copies"], w["split"], raw[w["start"]:w["start"] + w["size"]]))
                size += w["size"]
                if size >= 1 << 20:
                    yield table(rows)
                    rows, size = [], 0
    if rows:
        yield table(rows)


def _without(batches: Iterator[pa.RecordBatch]):
    """``sha, text, spans`` to what is left of the text without its merged spans."""
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for sha, text, spans in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                raw = text.as_buffer().to_pybytes()
                flat = spans.values.flatten()
                first, last = (x.to_numpy() for x in flat)
                steps = np.zeros(len(raw) + 1, np.int32)
                np.add.at(steps, first, 1)
                np.add.at(steps, last, -1)
                gone = np.cumsum(steps)[:-1] > 0
                n = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((sha, int(gone.sum()), n, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["sha", "n_removed", "n_spans", "kept"])


def _key(sha) -> Column:
    """Half of a SHA-256 in hex, as bytes."""
    return F.unhex(F.substring(sha, 1, 32))


class Repeats:
    """The tables of one run, in a folder of the shared checkpoint folder."""

    def __init__(self, df: DataFrame, p: RepeatParams, text: str):
        self.spark, self.p = df.sparkSession, p
        run = uuid.uuid4().hex
        self.folder = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/repeats-{run}"
        long_enough = (df.select(F.col(text).alias("text")).filter(F.octet_length("text") >= p.length)
                       .select(_key(F.sha2("text", 256)).alias("sha"), "text"))
        # Bucketed by key: texts are joined three times, and only what they are joined with is shuffled then.
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = f"repeats_{run}"
        (long_enough.groupBy("sha").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
         .select("sha", "copies", "text").write.option("compression", "zstd").option("path", f"{self.folder}/texts")
         .bucketBy(buckets, "sha").saveAsTable(self.table))
        forget_shuffles(df)
        self.texts = self.spark.table(self.table)
        self.pieces = self._kept("pieces", self.texts.mapInArrow(
            functools.partial(_cut_rows, p=p),
            "anchor long, piece long, sha binary, start long, size int, copies long, inner boolean"))

    def _drop(self, name: str) -> None:
        """Delete a table of this run that no later step reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        forget_shuffles(df)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def shared(self) -> DataFrame:
        """Pieces whose anchor value repeats; ``mixed`` where its pieces differ or one may repeat itself."""
        anchors = (self.pieces.groupBy("anchor")
                   .agg(F.min("piece").alias("low"), F.max("piece").alias("high"), F.sum("copies").alias("n"),
                        F.max("inner").alias("inner"))
                   .filter("n > 1 OR inner").select("anchor", F.expr("low <> high OR inner").alias("mixed")))
        return self.pieces.drop("inner").join(anchors, "anchor")

    def sorted_blocks(self, shared: DataFrame) -> DataFrame:
        """The rows of ``_sorted_block`` for the distinct pieces of mixed anchor values."""
        p = self.p
        distinct = (shared.filter("mixed").groupBy("anchor", "piece")
                    .agg(F.sum("copies").alias("copies"), F.min(F.struct("sha", "start", "size")).alias("at")))
        blocks = (distinct.groupBy("anchor")
                  .agg(F.ceil(F.sum(F.col("at.size")) / p.block).cast("int").alias("salts")))
        wanted = (distinct.join(blocks, "anchor")
                  .select(F.col("at.sha").alias("sha"), F.struct(
                      "anchor", F.expr("cast(pmod(xxhash64(piece), salts) as int)").alias("salt"), "piece",
                      F.least("copies", F.lit(2)).alias("copies"), (F.col("salts") > 1).alias("split"),
                      F.col("at.start").alias("start"), F.col("at.size").alias("size")).alias("want"))
                  .groupBy("sha").agg(F.collect_list("want").alias("wanted")))
        cut_out = (self.texts.select("sha", "text").join(wanted, "sha").select("text", "wanted")
                   .mapInArrow(_examples, "anchor long, salt int, piece long, copies long, split boolean, bytes binary"))
        return (cut_out.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
                .mapInArrow(functools.partial(_sort_blocks, p=p), SORTED))

    def spans(self) -> DataFrame:
        """``sha, spans``: the repeated stretches (first, last) of every distinct text that has one."""
        shared = self._kept("shared", self.shared())
        self._drop("pieces")
        rows = self._kept("sorted", self.sorted_blocks(shared))
        across = (rows.filter("name IS NOT NULL").groupBy("anchor", "name").agg(F.count("*").alias("blocks"))
                  .filter("blocks > 1").select("anchor", "name"))
        lone = rows.filter("name IS NOT NULL AND first >= 0").join(across, ["anchor", "name"])
        found = (rows.filter("name IS NULL").select("anchor", "piece", "first", "last")
                 .union(lone.select("anchor", "piece", "first", "last"))
                 .groupBy("anchor", "piece").agg(F.collect_list(F.struct("first", "last")).alias("parts")))
        place = F.struct((F.col("start") + F.col("part.first")).alias("first"),
                         (F.col("start") + F.col("part.last")).alias("last"))
        mixed = (shared.filter("mixed").select("anchor", "piece", "sha", "start").join(found, ["anchor", "piece"])
                 .select("sha", "start", F.explode("parts").alias("part")).select("sha", place.alias("span")))
        equal = shared.filter("NOT mixed").select("sha", F.struct(
            F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("last")).alias("span"))
        return equal.union(mixed).groupBy("sha").agg(F.collect_list("span").alias("spans"))

    def cut_texts(self) -> DataFrame:
        """``sha, n_removed, n_spans, kept`` of the texts that lose something."""
        return (self.texts.select("sha", "text").join(self.spans(), "sha").select("sha", "text", "spans")
                .mapInArrow(_without, "sha binary, n_removed long, n_spans long, kept binary"))


def remove(df: DataFrame, p: RepeatParams = RepeatParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every row: bytes, bytes in repeats, maximal removed runs and
    the SHA-256 of what is left."""
    run = Repeats(df, p, text)
    lost = run._kept("lost", run.cut_texts().select("sha", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    for name in ("shared", "sorted"):
        run._drop(name)
    run.spark.sql(f"DROP TABLE {run.table}")         # its folder stays with the others of the run
    own = (df.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                     F.sha2(F.coalesce(text, F.lit("")), 256).alias("whole")).withColumn("sha", _key(F.col("whole"))))
    zero = F.lit(0).cast("long")
    return (own.join(lost.withColumnRenamed("kept_sha256", "rest"), "sha", "left")
            .select(F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                    F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("rest", "whole").alias("kept_sha256")))
