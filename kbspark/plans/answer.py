"""Question -> answer composites.

The generator is supplied by the user as ``DataFrame -> DataFrame`` adding a
string column ``output`` from ``prompt`` (:func:`model_generator` around a
model, or a native expression in tests), and where it knows them
``elapsed_s`` and ``generator_error``.  A batch
of questions is one plan: retrieve, prompt, generate, strip, cite.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from typing import Callable

import pandas as pd
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.prompts import prompt_for, strip_echo
from kbspark.functions.requests import normalized_columns, shown_seconds
from kbspark.functions.urls import citation_link, path_to_citation, with_citation
from kbspark.params import DEFAULT, KbParams
from kbspark.plans.retrieve import retrieve_dot, retrieve_l2

Generator = Callable[[DataFrame], DataFrame]
MODES = ("none", "dot", "l2")     # no retrieval, dot-product collection, squared-L2 collection
NO_RETRIEVAL, DOT, L2 = MODES


GENERATED = "output string, elapsed_s double, generator_error string"


def model_generator(make_predict: Callable, batch_size: int = 8, parameters: tuple[str, ...] = ()) -> Generator:
    """Wrap a text-generation model factory as a :data:`Generator`.

    ``make_predict()`` runs once per Python worker and returns ``predict``, called with a numpy array of at most
    ``batch_size`` prompts and, for every name in ``parameters``, a keyword array of that column's values (say
    temperature and token count of each request); it returns one text per prompt.  Rows without a prompt never reach
    the model.  ``elapsed_s`` is the wall time of the call that answered the row (U3).  A call that raises is repeated
    row by row, and a row that raises alone gets ``generator_error`` (U4).
    """
    key = uuid.uuid4()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = ModelCache.get(key)
        if predict is None:
            predict = make_predict()
            ModelCache.add(key, predict)

        def call(rows: pd.DataFrame) -> tuple[list, float]:
            start = time.perf_counter()
            texts = predict(rows["prompt"].to_numpy(), **{p: rows[p].to_numpy() for p in parameters})
            return list(texts), time.perf_counter() - start

        for pdf in batches:
            rows = pdf[pdf["prompt"].notna()]
            output, elapsed, error = {}, {}, {}
            for at in range(0, len(rows), batch_size):
                part = rows.iloc[at:at + batch_size]
                try:
                    texts, seconds = call(part)
                    output.update(zip(part.index, texts))
                    elapsed.update(dict.fromkeys(part.index, seconds))
                except Exception:  # noqa: BLE001 - whatever the model raises becomes the row's error
                    for i in part.index:
                        try:
                            texts, elapsed[i] = call(part.loc[[i]])
                            output[i] = texts[0]
                        except Exception as e:  # noqa: BLE001
                            error[i] = f"generator failed: {e}"
            yield pd.DataFrame({name: pd.Series([found.get(i) for i in pdf.index], dtype=kind) for name, found, kind in
                                (("output", output, object), ("elapsed_s", elapsed, float),
                                 ("generator_error", error, object))})

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, GENERATED)

    def generate(df: DataFrame) -> DataFrame:
        made = df.withColumn("__made", udf(F.struct("prompt", *parameters)))
        return made.select(*df.columns, "__made.*")

    return generate


def _with_generator_error(gen: DataFrame) -> DataFrame:
    """The generator's error of a row, where it reports one, in ``error`` (an earlier error stays)."""
    if "generator_error" not in gen.columns:
        return gen
    return gen.withColumn("error", F.coalesce("error", "generator_error")).drop("generator_error")


def contexts(questions: DataFrame, corpus_dot: DataFrame, docs: DataFrame, corpus_l2: DataFrame,
             params: KbParams = DEFAULT, q_id: str = "qid", exclude_dot: str | None = None,
             exclude_l2: str | None = None) -> DataFrame:
    """P20 retrieval dispatch: ``(qid, context, source)`` per question by its ``mode``.

    ``none`` -> empty context, no source; ``dot`` -> dot-product top-k,
    source = stored path; ``l2`` -> nearest by squared L2, source = stored id.
    Any other mode (or none) is an error row without context.  The
    branches are filtered from the same questions and unioned.
    ``exclude_dot`` / ``exclude_l2`` name question columns with a corpus id
    each backend must skip.
    """
    extra = [c for c in (exclude_dot, exclude_l2) if c]
    keys = questions.select(q_id, "mode", "embedding", *extra)
    none = keys.filter(F.col("mode") == NO_RETRIEVAL).select(
        q_id, F.lit("").alias("context"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("error"))
    dot_q = keys.filter(F.col("mode") == DOT)
    dot = retrieve_dot(dot_q, corpus_dot, docs, params, q_id, exclude_dot).select(
        q_id, "context", F.col("path").alias("source"), "error")
    l2_q = keys.filter(F.col("mode") == L2)
    l2 = retrieve_l2(l2_q, corpus_l2, q_id, exclude_l2, params=params).select(
        q_id, F.col("document").alias("context"), F.col("id").alias("source"),
        F.when(F.col("id").isNull(), F.lit("no match")).alias("error"))
    null = F.lit(None).cast("string")
    unknown = keys.filter(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))).select(
        q_id, null.alias("context"), null.alias("source"), F.lit("unknown mode").alias("error"))
    return none.unionByName(dot).unionByName(l2).unionByName(unknown)


def answer_questions(questions: DataFrame, corpus_dot: DataFrame, docs: DataFrame, corpus_l2: DataFrame,
                     generate: Generator, params: KbParams = DEFAULT, q_id: str = "qid",
                     exclude_dot: str | None = None, exclude_l2: str | None = None) -> DataFrame:
    """``(qid, mode, prompt, answer, error)`` for every question (U4: a failure is a row with ``error``).

    answer = generated output minus the echoed prompt (P21), followed by the
    citation of the source (P9, P10) when the mode retrieved one.
    """
    ctx = contexts(questions, corpus_dot, docs, corpus_l2, params, q_id, exclude_dot, exclude_l2)
    q = questions.drop("embedding").join(ctx, q_id)
    q = q.withColumn("prompt", prompt_for(F.col("text"), F.col("context")))
    gen = _with_generator_error(generate(q))
    stripped = strip_echo(F.col("output"), F.col("prompt"), params.echo_offset)
    cite = citation_link(path_to_citation(F.col("source"), params.base_path))
    ans = F.when(F.col("source").isNull(), stripped).otherwise(with_citation(stripped, cite))
    return gen.withColumn("answer", F.when(F.col("error").isNull(), ans)).drop("output")


def score_requests(requests: DataFrame, generate: Generator, body: str = "body",
                   params: KbParams = DEFAULT) -> DataFrame:
    """Request body -> defaults (P16) -> generate (U2) -> ``(..., response, response_time_s, error)``.

    A bad request becomes a row with ``error`` set and no response, instead of
    failing the batch.  ``response_time_s`` comes from the generator's
    ``elapsed_s`` column, rounded to 0.1 s (P25); null when it reports none.
    """
    keep = [c for c in requests.columns if c != body]
    norm = requests.select(*keep, *normalized_columns(F.col(body)))
    # One pass, no split-and-union: a bad request reaches the generator with
    # no prompt (and gets no output).  A filter on ``error`` would be pushed
    # below the projection and parse every body twice.
    ok = F.col("error").isNull()
    gen = _with_generator_error(generate(norm.withColumn("prompt", F.when(ok, F.col("prompt")))))
    if "elapsed_s" not in gen.columns:
        gen = gen.withColumn("elapsed_s", F.lit(None).cast("double"))
    out = gen.withColumn("response", F.when(ok, F.col("output"))).drop("output")
    return out.withColumn("response_time_s", shown_seconds(F.col("elapsed_s")))


def request_log_rows(scored: DataFrame) -> DataFrame:
    """K8: the metric triple logged per call: ``(prompt, response, response_time_s)`` (elapsed unrounded)."""
    return scored.filter(F.col("error").isNull()).select(
        "prompt", "response", F.col("elapsed_s").alias("response_time_s"))

