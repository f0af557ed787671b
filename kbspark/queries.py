"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the landed tables of ``sf_dir`` (or tables Spark derives
from them in :mod:`kbspark.sources.fixtures`) in full.  Column names and
types match the oracle SQL in :mod:`kbspark.oracle`.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import params as P
from kbspark.params import KbParams
from kbspark.functions import urls as U
from kbspark.functions.html import extract_text
from kbspark.functions.prompts import prompt_for, prompt_plain, prompt_with_context, strip_echo
from kbspark.functions.requests import (in_chat_domain, normalized_columns, request_json, response_json,
                                        response_text, shown_seconds, status_lane, parse_body,
                                        field_or_default)
from kbspark.functions.vectors import has_dimension, l2_norm, l2_normalize
from kbspark.operators import crawl as C
from kbspark.operators import dedup as D
from kbspark.operators import store as K
from kbspark.operators.embed import mean_pool, truncate_for_embedding, truncation_stats
from kbspark.operators.metrics import daily_metrics
from kbspark.operators.topk import best_match, relevance_report, topk
from kbspark.plans.answer import answer_questions, contexts, request_log_rows, score_requests
from kbspark.plans.ingest import build_kb, planned_writes
from kbspark.plans.retrieve import fetch_context, lookup, retrieve_dot, retrieve_l2, where_contains, where_metadata
from kbspark.session import ensure_checkpoint_dir
from kbspark.sources import fixtures as X
from kbspark.sources.tables import load, scan_sitemaps, scan_url_list

Query = Callable[[SparkSession, str], DataFrame]
ARTICLE_TAG = "article"        # the test pages mark their content with <article>, none has <main>
CONTAINS_NEEDLE = "tion"       # P15 substring pre-filter
METADATA_SOURCE = "src1"       # P14 metadata pre-filter value
RELEVANCE_THRESHOLD = 0.3


# --- sources, links and crawl ------------------------------------------------------------------

def q_scan_sitemaps(spark, d):
    docs = X.sitemaps(spark, d)
    return C.document_state(scan_sitemaps(docs).withColumn("status", F.lit(200))).select("url", "state")


def q_extract_locs(spark, d):
    return C.extract_locs(X.sitemaps(spark, d)).select("parent", F.col("pos").cast("int").alias("pos"), "child")


def q_classify_links(spark, d):
    return C.classify_links(C.extract_locs(X.sitemaps(spark, d))).select("parent", "child", "kind")


def q_crawl_sitemaps(spark, d):
    return C.crawl(X.sitemaps(spark, d), X.ROOT_SITEMAP).select("url", "kind", "depth")


def q_crawl_errors(spark, d):
    docs = X.sitemaps(spark, d)
    return C.crawl_errors(docs, C.crawl(docs, X.ROOT_SITEMAP))


def q_scan_url_list(spark, d):
    return scan_url_list(X.url_list(spark, d), value="url")


def q_scan_pages(spark, d):
    return load(spark, d, "pages").select("page_id", "url", F.length("html").alias("html_chars"))


def q_url_origin(spark, d):
    return load(spark, d, "pages").select("page_id", "url", U.url_origin(F.col("url")).alias("origin"))


def q_in_scope_pages(spark, d):
    return load(spark, d, "pages").filter(U.in_scope(F.col("url"))).select("page_id", "url")


def q_html_to_text(spark, d):
    return extract_text(load(spark, d, "pages").select("page_id", "html")).select("page_id", "text")


def q_main_content_text(spark, d):
    pages = load(spark, d, "pages").select("page_id", "html")
    return extract_text(pages, tag=ARTICLE_TAG).select("page_id", "text")


def q_url_to_path(spark, d):
    return load(spark, d, "pages").select("page_id", "url", U.url_to_path(F.col("url")).alias("path"))


def q_path_to_citation(spark, d):
    pages = load(spark, d, "pages").select("page_id", U.url_to_path(F.col("url")).alias("path"))
    return pages.select("page_id", "path", U.path_to_citation(F.col("path")).alias("citation"))


def q_citation_roundtrip_loss(spark, d):
    pages = load(spark, d, "pages").select("url", U.path_to_citation(U.url_to_path(F.col("url"))).alias("c"))
    return pages.agg(F.count("*").alias("pages"),
                     F.sum(F.when(F.col("c") == F.col("url"), 1).otherwise(0)).alias("exact"),
                     F.sum(F.when(F.col("c") != F.col("url"), 1).otherwise(0)).alias("lost"))


def q_doc_id_hash(spark, d):
    kb = X.kb_docs(spark, d)
    return kb.select("path", U.doc_id(F.col("path")).alias("id"))


def q_doc_id_fallback(spark, d):
    docs = load(spark, d, "documents")
    kb_path = F.when(F.col("lang") == "en", F.concat(F.lit(X.KB_BASE + "/"), "source", F.lit("/"),
                                                      F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", U.doc_id_fallback(kb_path, F.col("text")).alias("id"))


def q_attach_metadata(spark, d):
    kb = X.kb_docs(spark, d)
    return kb.select("path", U.metadata_file_path(F.col("path"))["file_path"].alias("file_path"),
                     U.metadata_classification()["classification"].alias("classification"))


def q_resolve_fetch_attempts(spark, d):
    return D.resolve_attempts(X.fetch_log(spark, d), with_body=False).select("url", "attempt", "status", "outcome")


def q_split_by_status(spark, d):
    return X.fetch_log(spark, d).select("page_id", "attempt", status_lane(F.col("status")).alias("lane"))


def q_dedup_urls(spark, d):
    return D.first_occurrence(scan_url_list(X.url_list(spark, d), value="url"), "url", "ord")


def q_kb_last_write_wins(spark, d):
    writes = planned_writes(X.url_list(spark, d).withColumnRenamed("url", "value"))
    return D.last_write_wins(writes.select("path", "ord", "url"), "path", "ord")


def q_path_collisions(spark, d):
    writes = planned_writes(X.url_list(spark, d).withColumnRenamed("url", "value"))
    return D.collisions(writes, "path", "url")


def q_kb_unfetched(spark, d):
    from kbspark.plans.ingest import unfetched
    lines = X.url_list(spark, d).withColumnRenamed("url", "value")
    return unfetched(lines, load(spark, d, "pages"))


def q_build_kb(spark, d):
    lines = X.url_list(spark, d).withColumnRenamed("url", "value")
    return build_kb(lines, load(spark, d, "pages"))


# --- vectors -------------------------------------------------------------------------------------

def q_topk_cosine(spark, d):
    return topk(X.questions_v(spark, d), X.corpus_dot(spark, d), k=P.TOP_K_DOT, metric="dot", exclude="qid")


def q_nearest_l2(spark, d):
    return topk(X.questions_v(spark, d), X.corpus_dot(spark, d), k=P.TOP_K_L2, metric="l2", exclude="qid")


def q_best_match(spark, d):
    qs = X.questions_v(spark, d)
    return best_match(qs, topk(qs, X.corpus_dot(spark, d), k=P.TOP_K_DOT, exclude="qid"))


def q_fetch_context(spark, d):
    qs = X.questions_v(spark, d)
    corpus = X.corpus_dot(spark, d)
    best = best_match(qs, topk(qs, corpus, k=P.TOP_K_DOT, exclude="qid"))
    ensure_checkpoint_dir(spark)
    best = best.checkpoint()         # one row per question; read by both lookups
    paths = lookup(best, corpus.select("id", F.col("metadata")["file_path"].alias("path")), "id")
    with_path = best.join(paths, "id", "left")
    return fetch_context(with_path, X.kb_docs(spark, d)).select("qid", "id", "score", "path", "context", "error")


def q_relevance_report(spark, d):
    m = topk(X.questions_v(spark, d), X.corpus_dot(spark, d), k=P.TOP_K_DOT, exclude="qid")
    return relevance_report(m, RELEVANCE_THRESHOLD)


def q_topk_where_metadata(spark, d):
    corpus = where_metadata(X.corpus_dot(spark, d), "source", METADATA_SOURCE)
    return topk(X.questions_v(spark, d), corpus, k=P.TOP_K_DOT, exclude="qid")


def q_topk_where_contains(spark, d):
    emb = load(spark, d, "embeddings").select("vec_id", "embedding")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("document"))
    corpus = where_contains(emb.join(docs, "vec_id"), CONTAINS_NEEDLE).select(
        F.col("vec_id").alias("id"), "embedding")
    return topk(X.questions_v(spark, d), corpus, k=P.TOP_K_DOT, exclude="qid")


def q_l2_normalize(spark, d):
    emb = load(spark, d, "embeddings")
    scaled = emb.select("vec_id", F.transform("embedding", lambda x: x * (F.col("label") + 1)).alias("v"))
    out = scaled.select("vec_id", F.round(l2_norm("v"), 6).alias("norm_in"), l2_normalize(F.col("v")).alias("u"))
    return out.select("vec_id", "norm_in", F.round(l2_norm("u"), 6).alias("norm_out"),
                      F.round(F.col("u")[0], 6).alias("u0"))


def q_check_dimension(spark, d):
    emb = load(spark, d, "embeddings")
    return (emb.groupBy(F.size("embedding").alias("dim"))
            .agg(F.count("*").alias("vectors"),
                 F.sum(F.when(has_dimension("embedding", 64), 1).otherwise(0)).alias("accepted_64"),
                 F.sum(F.when(has_dimension("embedding", P.VECTOR_DIM), 1).otherwise(0)).alias("accepted_768")))


def q_mean_pool(spark, d):
    emb = load(spark, d, "embeddings").select("vec_id", "embedding", "label")
    lab = load(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    df = emb.join(lab, "vec_id", "left").withColumn("mask", F.coalesce(F.col("quality"), F.lit(0)))
    pooled = mean_pool(df, "label", "embedding", "mask")
    return pooled.select("label", F.col("mask_sum").cast("long").alias("mask_sum"),
                         F.round(F.col("pooled")[0], 6).alias("p0"),
                         F.round(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x), 6).alias("psum"))


def q_upsert_replace(spark, d):
    return K.upsert_replace(X.vectors_old(spark, d), X.vectors_new(spark, d)).select("id", "label", "version")


def q_upsert_ignore(spark, d):
    return K.upsert_ignore(X.vectors_old(spark, d), X.vectors_new(spark, d)).select("id", "label", "version")


def q_collection_count(spark, d):
    return K.count_records(K.upsert_replace(X.vectors_old(spark, d), X.vectors_new(spark, d)))


def q_describe_collection(spark, d):
    kb = X.kb_docs(spark, d).select(F.col("doc_id").alias("vec_id"), "path")
    emb = load(spark, d, "embeddings").select("vec_id", "embedding")
    coll = emb.join(kb, "vec_id").select(U.doc_id(F.col("path")).alias("id"), "embedding")
    return K.describe(coll)


def q_truncate_tokens(spark, d):
    docs = truncate_for_embedding(load(spark, d, "documents").select("doc_id", "text"), n=P.MAX_EMBED_TOKENS)
    return docs.select("doc_id", F.length("embed_text").alias("embed_chars"))


def q_truncation_loss(spark, d):
    return truncation_stats(load(spark, d, "documents"))


def q_token_windows(spark, d):
    """V1: every document as overlapping windows of the embedder's token count."""
    from kbspark.operators.windows import token_windows
    w = token_windows(load(spark, d, "documents").select("doc_id", "text"), "doc_id", size=P.MAX_EMBED_TOKENS)
    return w.select("doc_id", "window", "first", "last", F.char_length("text").alias("chars"))


# --- retrieval and answers -----------------------------------------------------------------------

def _generate_stub(df: DataFrame) -> DataFrame:
    return (df.withColumn("output", X.stub_generate(F.col("prompt"), F.col("conv_id")))
            .withColumn("elapsed_s", X.stub_seconds(F.col("prompt"))))


def q_retrieve_p(spark, d):
    qs = X.chat_questions(spark, d)
    r = retrieve_dot(qs.select("qid", "embedding", "self_vec"), X.corpus_dot(spark, d), X.kb_docs(spark, d),
                     exclude="self_vec")
    return r.select("qid", "id", "score", "path", "context", "error")


def q_retrieve_c(spark, d):
    qs = X.chat_questions(spark, d)
    return retrieve_l2(qs.select("qid", "embedding", "self_path"), X.corpus_l2(spark, d), exclude="self_path")


def q_prompt_plain(spark, d):
    conv = load(spark, d, "conversations").filter(F.col("role") == "user")
    return conv.select("conv_id", "turn", prompt_plain(F.col("text")).alias("prompt"))


def q_prompt_with_context(spark, d):
    conv = load(spark, d, "conversations").filter(F.col("role") == "user")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    return conv.join(docs, "conv_id").select(
        "conv_id", "turn", prompt_with_context(F.col("text"), F.col("context")).alias("prompt"))


def q_prompt_dispatch(spark, d):
    qs = X.chat_questions(spark, d)
    ctx = contexts(qs, X.corpus_dot(spark, d), X.kb_docs(spark, d), X.corpus_l2(spark, d),
                   exclude_dot="self_vec", exclude_l2="self_path")
    return (qs.select("qid", "mode", "text").join(ctx, "qid")
            .select("qid", "mode", "source", prompt_for(F.col("text"), F.col("context")).alias("prompt")))


def q_answer_questions(spark, d):
    qs = X.chat_questions(spark, d)
    out = answer_questions(qs, X.corpus_dot(spark, d), X.kb_docs(spark, d), X.corpus_l2(spark, d),
                           _generate_stub, KbParams(base_path=X.KB_BASE),
                           exclude_dot="self_vec", exclude_l2="self_path")
    return out.select("qid", "conv_id", "turn", "mode", "answer", "error")


def q_strip_prompt_echo(spark, d):
    r = X.responses(spark, d)
    return r.select("conv_id", "turn", strip_echo(F.col("response"), F.col("prompt")).alias("answer"))


def q_answer_with_citation(spark, d):
    r = X.responses(spark, d)
    kb = X.kb_docs(spark, d).select(F.col("doc_id").alias("conv_id"), "path")
    ans = strip_echo(F.col("response"), F.col("prompt"))
    link = U.citation_link(U.path_to_citation(F.col("path"), X.KB_BASE))
    return r.join(kb, "conv_id").select("conv_id", "turn", U.with_citation(ans, link).alias("answer"))


# --- sinks and user models -----------------------------------------------------------------------

def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_scan_kb_docs(spark, d):
    """S3 over a tree of text files written from the documents (some without bytes)."""
    from kbspark.sources.folder import write_folder
    from kbspark.sources.tables import scan_kb_docs
    root = _folder(spark, "kb-tree")
    docs = load(spark, d, "documents").select(
        F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
        .alias("path"), F.when(F.col("doc_id") % 10 != 0, F.col("text")).otherwise(F.lit("")).alias("text"))
    write_folder(docs, root).write.format("noop").mode("overwrite").save()
    got = scan_kb_docs(spark, root)
    return got.select(F.substring_index("path", "/", -2).alias("path"), F.char_length("text").alias("chars"),
                      F.sha2("text", 256).alias("text_sha256"))


def q_append_urls(spark, d):
    """K1: the crawled page urls appended by two runs, as the original's list file had them."""
    path = _folder(spark, "urls")
    pages = C.crawl(X.sitemaps(spark, d), X.ROOT_SITEMAP).filter("kind = 'page'").select("url").checkpoint()
    for _ in range(2):
        K.append_table(pages, path)
    return spark.read.parquet(path).groupBy("url").agg(F.count("*").alias("lines"))


def q_append_errors(spark, d):
    """K2: the error lane of the crawl appended by two runs."""
    path = _folder(spark, "errors")
    docs = X.sitemaps(spark, d)
    errors = C.crawl_errors(docs, C.crawl(docs, X.ROOT_SITEMAP)).checkpoint()
    for _ in range(2):
        K.append_table(errors, path)
    return spark.read.parquet(path).groupBy("stage", "key", "message").agg(F.count("*").alias("lines"))


def q_write_kb(spark, d):
    """K3: the knowledge base written by host, twice, and read again."""
    path = _folder(spark, "kb")
    lines = X.url_list(spark, d).withColumnRenamed("url", "value")
    kb = build_kb(lines, load(spark, d, "pages")).checkpoint()
    for _ in range(2):
        K.write_kb(kb, path)
    return spark.read.parquet(path).select("path", "url", F.col("host").cast("string").alias("host"), "text")


def q_collection_on_disk(spark, d):
    """K4 to K6 on disk: created, filled with the old vectors, then the new ones by both policies in turn."""
    out = None
    for policy in ("replace", "ignore"):
        root = _folder(spark, f"collection-{policy}")
        schema = X.vectors_old(spark, d).select("id", "embedding", "label", "version").schema
        K.get_or_create(spark, root, schema)
        K.upsert_into(spark, root, X.vectors_old(spark, d), "replace", schema=schema)
        coll = K.upsert_into(spark, root, X.vectors_new(spark, d), policy, schema=schema)
        one = coll.select(F.lit(policy).alias("policy"), "id", "label", "version")
        out = one if out is None else out.unionByName(one)
    return out


def _shape_model():
    """A model factory: what it gives is plain arithmetic on the text, so SQL can say it too."""
    import numpy as np

    def predict(texts):
        return np.array([[len(t), t.count(" "), t.count("e"), t.count("\n")] for t in texts], np.float32)

    return predict


def q_embed_with_model(spark, d):
    """Every document through a user model, loaded once per worker."""
    from kbspark.operators.embed import model_embedder
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vecs = docs.select("doc_id", model_embedder(_shape_model, dim=4)(F.col("text")).alias("v"))
    return vecs.select("doc_id", *[F.col("v")[i].cast("long").alias(n) for i, n in enumerate(("chars", "blanks", "es", "lines"))])


def _picky_model():
    """A model factory that refuses some prompts."""
    def predict(prompts):
        if any("ing" in p for p in prompts):
            raise ValueError("refused")
        return [p.replace("e", "3") for p in prompts]

    return predict


def q_generate_with_model(spark, d):
    """Every user turn through a user model; what it refuses is an error in its row alone."""
    from kbspark.plans.answer import model_generator, score_requests
    out = score_requests(X.requests(spark, d), model_generator(_picky_model))
    return out.select("conv_id", "turn", "response", "error")


def q_normalize_requests(spark, d):
    rq = X.requests(spark, d)
    return rq.select("conv_id", "turn", *normalized_columns(F.col("body")))


def q_validate_requests(spark, d):
    rq = X.requests(spark, d)
    parsed = parse_body(F.col("body"))
    t, _ = field_or_default(parsed, "temperature", "double", P.TEMPERATURE_UI_DEFAULT)
    n, _ = field_or_default(parsed, "max_new_tokens", "int", P.TOKEN_UI_DEFAULT)
    return rq.select("conv_id", "turn", t.alias("temperature"), n.alias("max_new_tokens"),
                     in_chat_domain(t, n).alias("valid"))


def q_build_request_json(spark, d):
    rq = X.requests(spark, d).select("conv_id", "turn", *normalized_columns(F.col("body")))
    js = rq.select("conv_id", "turn", "prompt",
                   request_json(F.col("prompt"), F.col("temperature"), F.col("max_new_tokens"),
                                1.5).alias("json"))
    g = lambda f: F.get_json_object("json", f"$.request.{f}")
    return js.select("conv_id", "turn", (g("prompt") == F.col("prompt")).alias("prompt_ok"),
                     g("temperature").cast("double").alias("temperature"),
                     g("max_new_tokens").cast("int").alias("max_new_tokens"),
                     g("repetition_penalty").cast("double").alias("repetition_penalty"),
                     F.json_object_keys("json")[0].alias("top_key"))


def q_parse_response_json(spark, d):
    r = X.responses(spark, d).select("conv_id", "turn", response_json(F.col("response")).alias("body"))
    return r.select("conv_id", "turn", response_text(F.col("body")).alias("response"))


def q_response_times(spark, d):
    ev = load(spark, d, "events")
    return ev.select("event_id", F.col("value").alias("response_time_s"),
                     shown_seconds(F.col("value")).alias("shown_s"))


def q_score_requests(spark, d):
    s = score_requests(X.requests(spark, d), _generate_stub)
    return s.select("conv_id", "turn", "temperature", "max_new_tokens", "top_p", "top_k",
                    "repetition_penalty", "num_beams", "response", "response_time_s", "error")


def q_log_requests(spark, d):
    return request_log_rows(score_requests(X.requests(spark, d), _generate_stub))


def q_request_metrics_daily(spark, d):
    return daily_metrics(X.request_log(spark, d))


# --- embedding, populate, streaming ---------------------------------------------------------------

def q_embed_documents(spark, d):
    from kbspark.operators.embed import apply_embedder, fit_hashing_embedder
    docs = truncate_for_embedding(load(spark, d, "documents").select("doc_id", "text"), n=None)
    model = fit_hashing_embedder(docs)
    emb = apply_embedder(model, docs)
    return emb.select("doc_id", F.size("embedding").alias("dim"), F.round(l2_norm("embedding"), 6).alias("norm"))


def q_embed_learned(spark, d):
    """V5: latent semantic vectors of all documents, fitted on all of them."""
    from kbspark.operators.lsa import LsaParams, embed_lsa, fit_lsa
    docs = truncate_for_embedding(load(spark, d, "documents").select("doc_id", "text"), n=None)
    emb = embed_lsa(docs, fit_lsa(docs, p=LsaParams()))
    return emb.select("doc_id", F.size("embedding").alias("dim"), F.round(l2_norm("embedding"), 4).alias("norm"))


def q_retrieve_by_text(spark, d):
    """V5 + V11 + R4: documents and user questions embedded by one fitted model, then top-5 and context."""
    from kbspark.operators.embed import apply_embedder, fit_hashing_embedder
    kb = truncate_for_embedding(X.kb_docs(spark, d).select("path", "text", "doc_id"), n=None)
    model = fit_hashing_embedder(kb)
    corpus = apply_embedder(model, kb).select(F.col("path").alias("id"), "embedding")
    conv = load(spark, d, "conversations").filter(F.col("role") == "user")
    qs = truncate_for_embedding(conv.select((F.col("conv_id") * 10 + F.col("turn")).alias("qid"), "text"), n=None)
    qv = apply_embedder(model, qs).select("qid", "embedding")
    best = best_match(qv, topk(qv, corpus, k=P.TOP_K_DOT, metric="dot"))
    ctx = fetch_context(best.withColumnRenamed("id", "path"), X.kb_docs(spark, d))
    return ctx.select("qid", "path", "score", F.length("context").alias("context_chars"), "error")


def q_topk_ivf(spark, d):
    """Approximate top-5 over a k-means inverted file (as many probed lists as recall asks for), leave-one-out."""
    from kbspark.operators.ann import ivf_topk
    return ivf_topk(X.questions_v(spark, d), X.corpus_dot(spark, d), k=P.TOP_K_DOT, exclude="qid")


def q_topk_ivf_recall(spark, d):
    """How many of the exact neighbours were asked for, and whether nine in ten were found."""
    from kbspark.operators.ann import recall_at_k
    r = recall_at_k(q_topk_ivf(spark, d), q_topk_cosine(spark, d))
    return r.select("total", (F.col("recall") >= 0.9).alias("found"))


def q_populate_index(spark, d):
    from kbspark.streaming.populate import vector_records
    recs = vector_records(X.kb_docs(spark, d).select("path", "text"))
    empty = spark.createDataFrame([], K.VECTOR_SCHEMA)
    coll = K.upsert_replace(empty, recs.select(empty.columns))
    return coll.select("id", F.col("metadata")["file_path"].alias("path"), F.size("embedding").alias("dim"))


def q_stream_request_metrics(spark, d):
    from kbspark.streaming.metrics import run_request_metrics
    return run_request_metrics(spark, f"{d.rstrip('/')}/events.parquet")


def q_stream_populate(spark, d):
    from kbspark.streaming.populate import docs_stream, run_populate
    from kbspark.streaming.runner import stream_dir
    coll = run_populate(spark, docs_stream(spark, f"{d.rstrip('/')}/documents.parquet", X.KB_BASE),
                        stream_dir(spark, "collection"))
    return coll.select("id", F.col("metadata")["file_path"].alias("path"), F.size("embedding").alias("dim"))


def q_stream_ingest_pages(spark, d):
    from kbspark.streaming.ingest import pages_stream, run_ingest
    from kbspark.streaming.runner import stream_dir
    kb = run_ingest(spark, pages_stream(spark, f"{d.rstrip('/')}/pages.parquet"), stream_dir(spark, "kb"))
    return kb.select("path", "url", "host", "text")


QUERIES: dict[str, Query] = {
    # sources, links, crawl, ingest
    "scan_sitemaps": q_scan_sitemaps,
    "extract_locs": q_extract_locs,
    "classify_links": q_classify_links,
    "crawl_sitemaps": q_crawl_sitemaps,
    "crawl_errors": q_crawl_errors,
    "scan_url_list": q_scan_url_list,
    "scan_pages": q_scan_pages,
    "url_origin": q_url_origin,
    "in_scope_pages": q_in_scope_pages,
    "html_to_text": q_html_to_text,
    "main_content_text": q_main_content_text,
    "url_to_path": q_url_to_path,
    "path_to_citation": q_path_to_citation,
    "citation_roundtrip_loss": q_citation_roundtrip_loss,
    "doc_id_hash": q_doc_id_hash,
    "doc_id_fallback": q_doc_id_fallback,
    "attach_metadata": q_attach_metadata,
    "resolve_fetch_attempts": q_resolve_fetch_attempts,
    "split_by_status": q_split_by_status,
    "dedup_urls": q_dedup_urls,
    "kb_last_write_wins": q_kb_last_write_wins,
    "path_collisions": q_path_collisions,
    "build_kb": q_build_kb,
    "kb_unfetched": q_kb_unfetched,
    "scan_kb_docs": q_scan_kb_docs,
    "append_urls": q_append_urls,
    "append_errors": q_append_errors,
    "write_kb": q_write_kb,
    # vectors and collections
    "topk_cosine": q_topk_cosine,
    "nearest_l2": q_nearest_l2,
    "best_match": q_best_match,
    "fetch_context": q_fetch_context,
    "relevance_report": q_relevance_report,
    "topk_where_metadata": q_topk_where_metadata,
    "topk_where_contains": q_topk_where_contains,
    "l2_normalize": q_l2_normalize,
    "check_dimension": q_check_dimension,
    "mean_pool": q_mean_pool,
    "upsert_replace": q_upsert_replace,
    "upsert_ignore": q_upsert_ignore,
    "collection_count": q_collection_count,
    "describe_collection": q_describe_collection,
    "collection_on_disk": q_collection_on_disk,
    "truncate_tokens": q_truncate_tokens,
    "truncation_loss": q_truncation_loss,
    "token_windows": q_token_windows,
    # retrieval, prompts, answers, requests
    "retrieve_p": q_retrieve_p,
    "retrieve_c": q_retrieve_c,
    "prompt_plain": q_prompt_plain,
    "prompt_with_context": q_prompt_with_context,
    "prompt_dispatch": q_prompt_dispatch,
    "answer_questions": q_answer_questions,
    "strip_prompt_echo": q_strip_prompt_echo,
    "answer_with_citation": q_answer_with_citation,
    "normalize_requests": q_normalize_requests,
    "validate_requests": q_validate_requests,
    "build_request_json": q_build_request_json,
    "parse_response_json": q_parse_response_json,
    "response_times": q_response_times,
    "score_requests": q_score_requests,
    "log_requests": q_log_requests,
    "request_metrics_daily": q_request_metrics_daily,
    # embedding, populate and streaming
    "embed_with_model": q_embed_with_model,
    "generate_with_model": q_generate_with_model,
    "embed_documents": q_embed_documents,
    "embed_learned": q_embed_learned,
    "retrieve_by_text": q_retrieve_by_text,
    "topk_ivf": q_topk_ivf,
    "topk_ivf_recall": q_topk_ivf_recall,
    "populate_index": q_populate_index,
    "stream_request_metrics": q_stream_request_metrics,
    "stream_populate": q_stream_populate,
    "stream_ingest_pages": q_stream_ingest_pages,
}
