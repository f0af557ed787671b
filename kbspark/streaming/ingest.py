"""Push ingest (S6, T3): pages landing in a folder -> text -> knowledge base, each url once.

Each micro-batch is written as one batch folder of the knowledge base, numbered
by the stream's epoch; within and across batches, and across runs, the later
landing wins.  The stream's checkpoint belongs to the knowledge base, so a later
run takes new landings only, and a replayed epoch overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions.html import extract_text
from kbspark.functions.urls import host_of, url_to_path
from kbspark.operators import store
from kbspark.params import DEFAULT, KbParams
from kbspark.streaming.runner import landed_stream, run_available_now

KB_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("host", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("version", T.LongType()),
])


def pages_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Landed pages as a stream; the merge by path (:func:`run_ingest`) keeps the latest landing of a page."""
    return landed_stream(spark, path, max_files)


def kb_rows(pages: DataFrame, landing: int, params: KbParams = DEFAULT) -> DataFrame:
    """One micro-batch of pages -> ``(path, url, host, text, version)``; version orders landings."""
    t = extract_text(pages.select("page_id", "url", "html"), "html", "text")
    return t.select(url_to_path(F.col("url"), params.base_path).alias("path"), "url",
                    host_of(F.col("url")).alias("host"), "text",
                    (F.lit(landing).cast("long") * F.lit(1 << 40) + F.col("page_id")).alias("version"))


def run_ingest(spark: SparkSession, stream: DataFrame, root: str, params: KbParams = DEFAULT) -> DataFrame:
    """Merge every available micro-batch into the knowledge base at ``root``; return it."""
    def apply(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        store.upsert_into(spark, root, kb_rows(batch, epoch + 1, params), "replace", schema=KB_SCHEMA, number=epoch + 1)

    run_available_now(stream, f"{root}/_checkpoint", foreach_batch=apply)
    return store.get_or_create(spark, root, KB_SCHEMA)
