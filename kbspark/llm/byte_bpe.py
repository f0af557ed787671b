"""Byte-level BPE encoding and decoding.

The ``tokenizers`` library runs over Arrow batches.  A rank file (base64 token, rank) gives the vocabulary: every byte
is written as one printable character, every pair of tokens whose bytes join to a token is a merge, ordered by that
token's rank, and a whole match of the split pattern that is itself a token stays whole.

Work is kept small by cutting texts where no match of the pattern can cross (before white space that follows
something else): a distinct piece is split and its matches merged once, its ids kept as packed bytes, and a document's
ids are the pieces' bytes joined.  The memory held is bounded by ``CACHE_PIECES`` short pieces per Python worker.

Decoding maps ids to their characters, reverses the byte table and joins bytes before any UTF-8 decoding, so
characters split over tokens come back whole.

Defined results: a null text is an empty one; an empty text has no ids; special tokens are never added and their
strings are ordinary text; duplicate rows give duplicate results; an empty table gives an empty table; only the named
columns are read, so other columns may have any names.  A lone surrogate cannot occur in an Arrow string.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.llm.arrowtext import raw_text, slices

CACHE_PIECES = 500_000
LONGEST_KEPT = 48
#: What the split pattern's \s matches (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

#: A piece of one Latin word and at most one mark after it: one match of the split pattern for each.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)")


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow from
    U+0100 on."""
    keep = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    shifted = (b for b in range(256) if b not in set(keep))
    table = [chr(b) for b in range(256)]
    for i, b in enumerate(shifted):
        table[b] = chr(256 + i)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        table = byte_table()
        ranks = read_ranks(path)
        name = {token: "".join(table[b] for b in token) for token in ranks}
        merges = [(name[t[:i]], name[t[i:]])
                  for t in sorted(ranks, key=ranks.__getitem__)
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges,
                                              ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        back = {c: b for b, c in enumerate(table)}
        chars = {i: c for c, i in self.tokenizer.get_vocab().items()}
        self.token_bytes = [bytes(back[c] for c in chars[i]) if i in chars else b"" for i in range(max(chars) + 1)]
        self.token_sizes = np.array([len(t) for t in self.token_bytes], np.int64)
        self.spell = {b: c for b, c in enumerate(table)}
        self.model, self.vocab = self.tokenizer.model, self.tokenizer.get_vocab()
        self.pieces: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def split(self, piece: str) -> list[str]:
        """The matches of the split pattern in a piece, a character for each byte."""
        plain = PLAIN.fullmatch(piece)
        if plain:
            word = plain[1].encode().decode("latin-1").translate(self.spell)
            return [word, plain[2]] if plain[2] else [word]
        return [m for m, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def encode_match(self, match: str) -> bytes:
        whole = self.vocab.get(match)
        ids = [whole] if whole is not None else [t.id for t in self.model.tokenize(match)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(match) <= LONGEST_KEPT:
            self.matches[match] = packed
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        if len(self.matches) > CACHE_PIECES:
            self.matches = {}
        kept, matches, out = self.pieces, self.matches, []
        for text in texts:
            pieces = PIECES.findall(text)
            long = []
            for piece in set(pieces).difference(kept):
                kept[piece] = b"".join([matches.get(m) or self.encode_match(m) for m in self.split(piece)])
                if len(piece) > LONGEST_KEPT:
                    long.append(piece)
            out.append(b"".join(map(kept.__getitem__, pieces)))
            for piece in long:
                del kept[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for; an id outside the vocabulary is an error."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each token in code points: the characters that hold its first and last byte.  Tokens that
        split a character all point at it."""
        sizes = self.token_sizes[np.frombuffer(ids, "<u4")]
        ends = np.cumsum(sizes)
        if not len(ends):
            return ends, ends
        character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
        return character[ends - sizes], character[ends - 1] + 1


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per Python worker and rank file."""
    return Codec(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, key: str, text: str, offsets: bool):
    c = codec(path)
    for batch in batches:
        for part in slices(batch, text):
            texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            ids = c.encode(texts)
            cols = {key: part.column(part.schema.get_field_index(key)),
                    "ids": pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32()))}
            if offsets:
                where = [c.offsets(t.encode(), i) for t, i in zip(texts, ids)]
                cols["starts"] = pa.array([a for a, _ in where], pa.list_(pa.int64()))
                cols["ends"] = pa.array([b for _, b in where], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """``key, ids array<int>`` and, if asked for, ``starts, ends array<long>`` (code points) of every text."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + ", starts array<long>, ends array<long>" * offsets
    return df.select(key, text).mapInArrow(
        functools.partial(_encode, path=path, key=key, text=text, offsets=offsets), schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str, key: str, ids: str):
    c = codec(path)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        yield pa.RecordBatch.from_pydict({
            key: batch.column(batch.schema.get_field_index(key)),
            "decoded": pa.array([c.decode(np.array(x or [], "<u4").tobytes()) for x in lists], pa.binary())})


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, decoded binary`` of id lists (null: empty); bytes, because a list may end within a character."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(functools.partial(_decode, path=path, key=key, ids=ids),
                                          f"`{key}` {kind}, decoded binary")


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, key: str, text: str):
    c = codec(path)
    for batch in batches:
        for part in slices(batch, text):
            ids = c.encode([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
            yield pa.RecordBatch.from_pydict({
                key: part.column(part.schema.get_field_index(key)),
                "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids], pa.string())})


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: texts encoded, the ids decoded again, both as digests, with no
    id list leaving the task."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(functools.partial(_round_trip, path=path, key=key, text=text),
                                           f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
