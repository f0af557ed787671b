"""Line-first quality rules.

Every line of a text is judged alone by three rules; lines that fail are removed, and a document that loses more than
``max_removed`` percent of its words with them is rejected:

* punctuation: two or more words, and ``mark_percent`` or more of them end in, or consist of, a run of two or more
  characters of ``!?#*$%&@~^+=_`` (decorated or shouted text);
* navigation: ``min_separators`` or more words are a bare separator (``| > < / - : » « · •``), and they are
  ``separator_percent`` or more of the line's words;
* boilerplate: the line, with A-Z as a-z, holds a phrase of ``BOILERPLATE`` and has at most ``boilerplate_words``
  words.

Beside these the text statistics of ``statistics`` are returned and two document rules on them reject first: fewer
than ``min_words`` words, or more than ``max_repeat`` percent of the words inside repeated three-word windows.

Words are ``[^\\x20\\x09-\\x0D]+``.  All counts are found with NumPy over the bytes of Arrow batches, about a megabyte
of text at a time; equal words, windows and lines are compared by 64-bit hashes within one document.

Defined results: a null or empty text has no words and fails the base rules; a line without words is removed silently
and counts for nothing; texts of any length are read whole; repeated rows are judged alike; an empty table gives an
empty table.  ``judge`` reads only the named columns; ``keep`` returns all columns of its input unchanged, whatever
their names; ``keep_clean`` changes the text of documents that lose lines, and its length column.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.llm.arrowtext import SPACE, per_row, raw_text, rows_of, runs, shingle_hashes, slices, span_hashes

# Characters counted as symbols, decoration marks, separators, boilerplate phrases.
SYMBOLS = "#*$%&|<>"
MARKS = "!?#*$%&@~^+=_"
SEPARATORS = ("|", ">", "<", "/", "-", ":", "»", "«", "·", "•")
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "use of cookies",
    "we use cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "click here",
    "read more", "sign up for", "subscribe to our", "share on facebook", "share on twitter", "follow us on",
    "skip to content", "back to top", "powered by", "add to cart",
)
# End of fixed values.


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat: int = 50
    max_removed: int = 50
    mark_percent: int = 30
    min_separators: int = 2
    separator_percent: int = 25
    boilerplate_words: int = 20


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SEPARATOR_HASHES = np.sort(span_hashes(
    np.frombuffer("".join(SEPARATORS).encode(), np.uint8),
    np.cumsum([0, *(len(s.encode()) for s in SEPARATORS)])[:-1], np.cumsum([len(s.encode()) for s in SEPARATORS])))
_PHRASES = [p.encode() for p in BOILERPLATE]


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of its group, size of its group) of the entries sorted by (row, hash), earliest first."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    return order, new, np.bincount(group)[group] if len(r) else group


def measure(column: pa.Array, rules: LineRules) -> dict[str, np.ndarray]:
    """Statistics and verdicts of each text of a column."""
    data, bounds = raw_text(column)
    n = len(bounds) - 1
    starts, ends = runs(data, bounds, SPACE)
    rows = rows_of(starts, bounds)
    words = span_hashes(data, starts, ends)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])         # code points before each byte
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {"n_words": per_row(rows, n), "word_chars": per_row(rows, n, begins[ends] - begins[starts]),
           "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]]}

    # Lines: between newlines within a row; each word lies in one.
    line_starts, line_ends = runs(data, bounds, _NEWLINE)
    line_rows = rows_of(line_starts, bounds)
    line_of = np.searchsorted(line_starts, starts, side="right") - 1
    in_line = per_row(line_of, len(line_starts))
    worded = np.flatnonzero(in_line > 0)
    order, new, _ = _repeats(line_rows[worded], span_hashes(data, line_starts, line_ends)[worded])
    out["n_dup_lines"] = per_row(line_rows[worded][order][~new], n)

    # Words inside three-word windows that occur twice or more in their text.
    windows = np.flatnonzero(rows[:-2] == rows[2:]) if len(rows) > 2 else np.zeros(0, np.int64)
    triple, owner = shingle_hashes(words, rows, n, 3)
    order, _, size = _repeats(owner[:len(windows)], triple[:len(windows)])
    hit = windows[order[size > 1]] if len(windows) else windows
    repeated = np.zeros(len(words), bool)
    for k in range(3):
        repeated[hit + k] = True
    out["n_repeat_words"] = per_row(rows[repeated], n)

    # Line rules.
    def by_line(flags: np.ndarray) -> np.ndarray:
        return per_row(line_of[flags], len(line_starts))

    last = ends - 1
    decorated = (ends - starts >= 2) & _MARK[data[last]] & _MARK[data[np.maximum(last - 1, 0)]] \
        if len(starts) else np.zeros(0, bool)
    # A stop after the run does not hide it ("word!!." ends a shouted sentence).
    if len(starts):
        decorated |= (ends - starts >= 3) & ~_MARK[data[last]] & _MARK[data[last - 1]] & _MARK[data[last - 2]]
    where = np.minimum(np.searchsorted(_SEPARATOR_HASHES, words), len(_SEPARATOR_HASHES) - 1)
    separator = _SEPARATOR_HASHES[where] == words
    n_marks, n_separators = by_line(decorated), by_line(separator)
    shouted = (in_line >= 2) & (100 * n_marks >= rules.mark_percent * in_line)
    navigation = (n_separators >= rules.min_separators) & (100 * n_separators >= rules.separator_percent * in_line)
    boilerplate = np.zeros(len(line_starts), bool)
    text = data.tobytes().lower()                                             # ASCII only, so positions stay
    for phrase in _PHRASES:
        at = text.find(phrase)
        while at >= 0:
            line = int(np.searchsorted(line_starts, at, side="right")) - 1
            if at + len(phrase) <= line_ends[line] and in_line[line] <= rules.boilerplate_words:
                boilerplate[line] = True
            at = text.find(phrase, at + 1)
    failed = shouted | navigation | boilerplate
    out["n_lines"] = per_row(line_rows[worded], n)
    out["n_failed_lines"] = per_row(line_rows[failed & (in_line > 0)], n)
    out["removed_words"] = per_row(line_rows, n, np.where(failed, in_line, 0))
    out["base_failed"] = (out["n_words"] < rules.min_words) | (
        100 * out["n_repeat_words"] > rules.max_repeat * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["removed_words"] <= rules.max_removed * out["n_words"])
    out["_spans"] = (line_starts, line_ends, line_rows, failed & (in_line > 0))
    return out


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
           "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_lines": "long",
           "n_failed_lines": "long", "removed_words": "long"}


def _judge(batches: Iterator[pa.RecordBatch], rules: LineRules, key: str, text: str):
    for batch in batches:
        for part in slices(batch, text):
            got = measure(part.column(part.schema.get_field_index(text)), rules)
            yield pa.RecordBatch.from_pydict({key: part.column(part.schema.get_field_index(key))}
                                             | {c: pa.array(got[c]) for c in COLUMNS})


def judge(df: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the key, the statistics, the line counts and the verdict ``kept``."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return df.select(key, text).mapInArrow(functools.partial(_judge, rules=rules, key=key, text=text), schema)


def _keep(batches: Iterator[pa.RecordBatch], rules: LineRules, text: str):
    for batch in batches:
        for part in slices(batch, text):
            kept = measure(part.column(part.schema.get_field_index(text)), rules)["kept"]
            yield part.filter(pa.array(kept))


def keep(df: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The rows whose text is kept, all columns as they are."""
    return df.mapInArrow(functools.partial(_keep, rules=rules, text=text), df.schema)


def without_failed(column: pa.Array, got: dict) -> list[str]:
    """The texts without their failed lines."""
    data, bounds = raw_text(column)
    starts, ends, rows, failed = got["_spans"]
    gone = [[] for _ in range(len(column))]
    for line in np.flatnonzero(failed):
        gone[rows[line]].append((int(starts[line]), int(ends[line])))
    raw = data.tobytes()
    texts = []
    for row, spans in enumerate(gone):
        at, pieces = int(bounds[row]), []
        for a, b in spans:
            pieces.append(raw[at:a])
            at = min(b + 1, int(bounds[row + 1]))                             # with its newline
        texts.append(b"".join([*pieces, raw[at:int(bounds[row + 1])]]).decode())
    return texts


def _keep_clean(batches: Iterator[pa.RecordBatch], rules: LineRules, text: str, size: str):
    for batch in batches:
        for part in slices(batch, text):
            got = measure(part.column(part.schema.get_field_index(text)), rules)
            whole = part.filter(pa.array(got["kept"] & (got["n_failed_lines"] == 0)))
            if whole.num_rows:
                yield whole
            some = got["kept"] & (got["n_failed_lines"] > 0)
            if some.any():
                cut = part.filter(pa.array(some))
                column = cut.column(cut.schema.get_field_index(text))
                texts = without_failed(column, measure(column, rules))
                for name, values in ((text, texts), (size, [len(t) for t in texts])):
                    if (at := cut.schema.get_field_index(name)) >= 0:
                        field = cut.schema.field(at)
                        cut = cut.set_column(at, field, pa.array(values, field.type))
                yield cut


def keep_clean(df: DataFrame, rules: LineRules = LineRules(), text: str = "text", size: str = "n_chars") -> DataFrame:
    """The rows whose text is kept, without the lines that failed; ``size``, if it is a column, is the new length of a
    text that lost lines.  All other columns as they are."""
    return df.mapInArrow(functools.partial(_keep_clean, rules=rules, text=text, size=size), df.schema)


def _clean(batches: Iterator[pa.RecordBatch], rules: LineRules, key: str, text: str):
    for batch in batches:
        for part in slices(batch, text):
            column = part.column(part.schema.get_field_index(text))
            got = measure(column, rules)
            yield pa.RecordBatch.from_pydict({key: part.column(part.schema.get_field_index(key)),
                                              "clean_text": pa.array(without_failed(column, got), pa.string()),
                                              "kept": pa.array(got["kept"])})


def clean(df: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, clean_text, kept``: texts without the lines that failed."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(functools.partial(_clean, rules=rules, key=key, text=text),
                                           f"`{key}` {kind}, clean_text string, kept boolean")
