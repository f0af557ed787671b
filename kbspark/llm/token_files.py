"""Token counts from flat token files by a separator scan.

A flat token file is nothing but little-endian token ids; an end-of-document id closes every document and there is no
index.  ``write`` makes such files with Spark's own writer on any store: ids are shifted up by one, so that 0 is the
end-of-document id, and a line of the text sink with the separator as its line end is a document.

``scan`` finds the separators of each block of a file with one vectorised comparison and keeps their positions.  What
crosses blocks is then stitched by a prefix scan over one short row per block: running sums give every block its first
token and first document, a running maximum the last separator before it.  The scan has two levels, blocks within a
file and then files, so only one row per file meets the others; documents may cross blocks and files.

Defined results: a null or empty text is a document of no tokens; tokens after the last separator are one document with
``closed`` false; a file of no bytes holds nothing; a file whose size is no multiple of the token width is an error; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.arrowtext import slices
from kbspark.llm.byte_bpe import codec

#: Documents of a file; a file is read by one task.
FILE_DOCS = 2048
#: Tokens of a block.
BLOCK = 1 << 18


def _tokens(batches: Iterator[pa.RecordBatch], path: str, text: str, width: int):
    c = codec(path)
    for batch in batches:
        for part in slices(batch, text):
            ids = c.encode([t or "" for t in part.column(0).to_pylist()])
            rows = [(np.frombuffer(i, "<u4") + 1).astype(f"<u{width}").tobytes() for i in ids]
            yield pa.RecordBatch.from_pydict({"tokens": pa.array(rows, pa.binary())})


def write(df: DataFrame, folder: str, path: str, text: str = "text", width: int = 2, file_docs: int = FILE_DOCS) -> None:
    """Flat token files of all texts of ``df``, ids by the rank file ``path``, into a new folder."""
    if len(codec(path).token_bytes) >= 1 << 8 * width:
        raise ValueError(f"the vocabulary needs more than {width} bytes an id")
    lines = df.select(text).mapInArrow(functools.partial(_tokens, path=path, text=text, width=width), "tokens binary")
    (lines.select(F.col("tokens").cast("string").alias("value"))
     .write.option("lineSep", "\0" * width).option("maxRecordsPerFile", file_docs).text(folder))


def _blocks(batches: Iterator[pa.RecordBatch], width: int, separator: int, block: int):
    for batch in batches:
        for row in range(batch.num_rows):
            name, raw = batch.column(0)[row].as_py(), batch.column(1)[row].as_buffer()
            if raw.size % width:
                raise ValueError(f"{name}: {raw.size} bytes are no whole number of tokens")
            ids = np.frombuffer(raw, f"<u{width}")
            for lo in range(0, len(ids), block):
                part = ids[lo:lo + block]
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([name]), "block": pa.array([lo // block]), "n": pa.array([len(part)]),
                    "ends": pa.array([np.flatnonzero(part == separator)], pa.list_(pa.int64()))})


def scan(spark: SparkSession, folder: str, width: int = 2, separator: int = 0, block: int = BLOCK) -> DataFrame:
    """``doc_no, start, n_tokens, closed`` of every document of the files of a folder, in the order of their names:
    its number, its first token's place in the whole, its tokens without the separator."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    blocks = files.filter("length > 0").select("path", "content").mapInArrow(
        functools.partial(_blocks, width=width, separator=separator, block=block),
        "file string, block long, n long, ends array<long>")
    blocks = blocks.checkpoint()                       # positions of separators; the files are read once

    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = (blocks.select("file", "block", "n", F.size("ends").cast("long").alias("docs"),
                          F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
            .withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0)))
            .withColumn("no", F.coalesce(F.sum("docs").over(within), F.lit(0)))
            .withColumn("before", F.max(F.col("at") + F.col("last")).over(within)))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    per_file = (rows.groupBy("file").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"),
                                         F.max(F.col("at") + F.col("last")).alias("last"))
                .withColumn("file_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
                .withColumn("file_no", F.coalesce(F.sum("docs").over(before), F.lit(0)))
                .withColumn("file_before", F.max(F.col("file_at") + F.col("last")).over(before)))
    placed = (rows.select("file", "block", "at", "no", "before")
              .join(per_file.select("file", "file_at", "file_no", "file_before"), "file")
              .select("file", "block", (F.col("at") + F.col("file_at")).alias("at"),
                      (F.col("no") + F.col("file_no")).alias("no"),
                      F.coalesce(F.col("before") + F.col("file_at"), "file_before", F.lit(-1)).alias("before")))
    ends = F.transform("ends", lambda e: e + F.col("at"))
    stitched = blocks.select("file", "block", "ends").join(placed, ["file", "block"]).select(
        "no", ends.alias("ends"), F.concat(F.array("before"), ends).alias("opens"))
    closed = (stitched.select("no", "opens", F.posexplode("ends").alias("i", "end"))
              .select((F.col("no") + F.col("i")).alias("doc_no"),
                      (F.element_at("opens", F.col("i") + 1) + 1).alias("start"), "end"))
    closed = closed.select("doc_no", "start", (F.col("end") - F.col("start")).alias("n_tokens"),
                           F.lit(True).alias("closed"))
    rest = (per_file.agg(F.sum("n").alias("n"), F.sum("docs").alias("doc_no"),
                         F.max(F.col("file_at") + F.col("last")).alias("last"))
            .select("doc_no", (F.coalesce("last", F.lit(-1)) + 1).alias("start"), "n")
            .filter("n > start").select("doc_no", "start", (F.col("n") - F.col("start")).alias("n_tokens"),
                                        F.lit(False).alias("closed")))
    return closed.union(rest)


def new_folder(base: str) -> str:
    """A folder of its own below the shared one."""
    return f"{base.rstrip('/')}/tokens-{uuid.uuid4().hex}"
