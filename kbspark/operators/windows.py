"""Overlapping token windows of long texts (V1, V5): for embedders that read a bounded number of tokens.

Cutting a text to its first tokens loses the rest of it.  Here a text becomes windows of ``size`` tokens that begin every
``stride`` tokens, so every token lies in a window, and a document is as near to a question as its nearest window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.topk import topk
from kbspark.params import DEFAULT

TOKEN = r"\S+"


def token_windows(df: DataFrame, key: str, text: str = "text", size: int = DEFAULT.max_embed_tokens,
                  stride: int | None = None) -> DataFrame:
    """``key, window, first, last, text``: the windows of every text, tokens ``first`` (from 0) up to ``last``, joined by
    one space.

    The last window ends with the text; a text without tokens (or null) has one empty window, so no document is lost.
    ``stride`` is three quarters of ``size`` unless named.
    """
    step = stride or max(1, size * 3 // 4)
    n = F.size("tokens")
    cut = df.select(key, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)).alias("tokens"))
    # The first start from which the window reaches the end is the last one.
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))
    at = cut.select(key, "tokens", F.explode(starts).alias("window"))
    first = F.col("window") * step
    return at.select(key, "window", first.alias("first"), F.least(first + size, n).alias("last"),
                     F.array_join(F.slice("tokens", first + 1, F.lit(size)), " ").alias("text"))


def nearest_document(questions: DataFrame, windows: DataFrame, doc: str, metric: str = "dot", q_id: str = "qid",
                     vec: str = "embedding") -> DataFrame:
    """``q_id, doc, window, score``: for every question the document with the nearest window, and which it is.

    ``windows`` has one embedded window a row; ties go to the smallest document, then the earliest window.
    """
    named = windows.select(F.struct(F.col(doc).alias("doc"), "window").alias("at"), F.col(vec).alias("embedding"))
    ids = named.withColumn("id", F.concat_ws("\x00", F.col("at.doc").cast("string"), F.lpad(F.col("at.window").cast("string"), 10, "0")))
    best = topk(questions, ids, k=1, metric=metric, q_id=q_id, q_vec=vec)
    kind = windows.schema[doc].dataType
    part = F.split("id", "\x00")
    return best.select(q_id, part[0].cast(kind).alias(doc), part[1].cast("int").alias("window"), "score")
