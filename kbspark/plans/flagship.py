"""The flagship query: leave-one-out retrieval over the landed vectors, then the context prompt.

embeddings (every vector a question) -> exact top-5 by dot product (V6)
-> best match (V8) -> document text by path (R1) -> prompt with context (P19).
The question text is the question vector's own document (when it has one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.prompts import prompt_for
from kbspark.operators.topk import best_match, topk
from kbspark.params import DEFAULT
from kbspark.plans.retrieve import fetch_context, lookup
from kbspark.session import ensure_checkpoint_dir
from kbspark.sources import fixtures as X


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = X.questions_v(spark, sf_dir)
    corpus = X.corpus_dot(spark, sf_dir)
    kb = X.kb_docs(spark, sf_dir)
    matches = topk(qs, corpus, k=DEFAULT.top_k, metric="dot", exclude="qid")
    best = best_match(qs, matches)
    ensure_checkpoint_dir(spark)
    best = best.checkpoint()         # one row per question; read by both lookups
    paths = lookup(best, corpus.select("id", F.col("metadata")["file_path"].alias("path")), "id")
    with_path = best.join(paths, "id", "left")
    ctx = fetch_context(with_path, kb)
    question = kb.select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    return (ctx.join(question, "qid", "left")
            .select("qid", "id", "score", "path",
                    prompt_for(F.coalesce(F.col("question"), F.lit("")), F.col("context")).alias("prompt"),
                    "error"))
