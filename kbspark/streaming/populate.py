"""Incremental populate (T2): new documents -> vectors -> upsert into the collection, per micro-batch.

``foreachBatch`` applies each micro-batch with the collection's upsert
policy, under the stream's epoch as its batch number and version.  The
checkpoint belongs to the collection: a later run takes new landings only, an
updated document replaces the old one, and a replayed epoch overwrites its own
batch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.urls import doc_id, metadata_file_path
from kbspark.operators import store
from kbspark.operators.embed import hashing_tf_embed, truncate_for_embedding
from kbspark.params import DEFAULT, KbParams
from kbspark.streaming.runner import landed_stream, run_available_now


def vector_records(docs: DataFrame, params: KbParams = DEFAULT, version=None, max_tokens: int | None = None
                   ) -> DataFrame:
    """R3 core: ``(path, text)`` -> ``(id, embedding, metadata, document, version)``.

    The embedder here is the stateless hashed term-frequency one, so every
    micro-batch is embedded the same way without a fitted model; it reads
    the whole text unless ``max_tokens`` asks for a token window (V1).
    """
    t = truncate_for_embedding(docs, "text", max_tokens, "embed_text")
    e = hashing_tf_embed(t, "embed_text", params.dim)
    v = F.lit(0).cast("long") if version is None else F.lit(version).cast("long")
    return e.select(doc_id(F.col("path"), params.id_chars).alias("id"), "embedding",
                    metadata_file_path(F.col("path")).alias("metadata"), F.col("text").alias("document"),
                    v.alias("version"))


def docs_stream(spark: SparkSession, path: str, base: str, max_files: int | None = None) -> DataFrame:
    """Landed documents as a stream of ``(path, text)`` placed under ``base``."""
    src = landed_stream(spark, path, max_files)
    p = F.concat(F.lit(base.rstrip("/") + "/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return src.select(p.alias("path"), "text")


def run_populate(spark: SparkSession, stream: DataFrame, root: str, policy: str = "replace",
                 params: KbParams = DEFAULT) -> DataFrame:
    """Apply every available micro-batch to the collection at ``root``; return the final snapshot."""
    def apply(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():        # availableNow may end with an empty batch
            return
        store.upsert_into(spark, root, vector_records(batch, params, epoch + 1), policy, dim=params.dim,
                          number=epoch + 1)

    run_available_now(stream, f"{root}/_checkpoint", foreach_batch=apply)
    return store.get_or_create(spark, root)
