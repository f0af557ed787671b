"""Tables derived from the landed test tables by fixed rules (no synthetic input).

Each function is a pure DataFrame expression over the landed tables, so its
size grows with them.  The oracle SQL computes the same rules in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.tables import load

ROOT_SITEMAP = "https://root.example/sitemap.xml"
KB_BASE = "/kb"
XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
XML_TAIL = "</urlset>\n"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(host, h, sm)``: one row per host of ``pages``; ``h`` is its smallest page id."""
    pages = load(spark, sf_dir, "pages")
    return (pages.select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), "page_id")
            .groupBy("host").agg(F.min("page_id").alias("h"))
            .withColumn("sm", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))))


def _page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(parent, child, pos, h)``: the link graph before pagination.

    root -> every host sitemap; host sitemap -> its pages; h%10=7 links back
    to root (a cycle); h%10=5 adds ``more.xml`` that lists each page url with
    query, fragment, trailing slash and ``.html`` cut off and ``.html`` added.
    """
    hs = hosts(spark, sf_dir)
    ph = _page_hosts(spark, sf_dir).join(hs, "host")
    root = hs.select(F.lit(ROOT_SITEMAP).alias("parent"), F.col("sm").alias("child"),
                     F.col("h").alias("pos"), F.lit(None).cast("long").alias("h"))
    to_pages = ph.select(F.col("sm").alias("parent"), F.col("url").alias("child"),
                         F.col("page_id").alias("pos"), "h")
    cycle = hs.filter(F.col("h") % 10 == 7).select(
        F.col("sm").alias("parent"), F.lit(ROOT_SITEMAP).alias("child"), F.lit(1 << 40).alias("pos"), "h")
    more_url = F.concat(F.lit("https://"), F.col("host"), F.lit("/more.xml"))
    to_more = hs.filter(F.col("h") % 10 == 5).select(
        F.col("sm").alias("parent"), more_url.alias("child"), F.lit(1 << 40).alias("pos"), "h")
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", ""),
                           r"\.html$", "")
    more_pages = ph.filter(F.col("h") % 10 == 5).select(
        more_url.alias("parent"), F.concat(cut, F.lit(".html")).alias("child"),
        F.col("page_id").alias("pos"), "h")
    return root.unionByName(to_pages).unionByName(cycle).unionByName(to_more).unionByName(more_pages)


PART_SPAN = 50000      # positions per sitemap document (the sitemap protocol's limit of links)
FAR = 1 << 40          # position of links that are not numbered by a page


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(parent, child, pos, h)``: the link graph the sitemaps encode, paginated as the protocol requires.

    Links at positions of ``PART_SPAN`` and more are in part documents
    ``<parent>-p<pos div PART_SPAN>.xml``, which the parent lists after its own
    links.  One rule for every size: a document holds at most ``PART_SPAN``
    numbered links, however many a host has.
    """
    part = F.when(F.col("pos") < FAR, F.expr(f"pos div {PART_SPAN}")).otherwise(F.lit(0))
    e = link_edges(spark, sf_dir).withColumn("part", part)
    part_url = F.concat(F.regexp_replace("parent", r"\.xml$", ""), F.lit("-p"), F.col("part").cast("string"),
                        F.lit(".xml"))
    links = e.select(F.when(F.col("part") > 0, part_url).otherwise(F.col("parent")).alias("parent"), "child", "pos", "h")
    index = (e.filter(F.col("part") > 0)
             .select("parent", part_url.alias("child"), (F.col("part") + FAR).alias("pos"), "h").distinct())
    return links.unionByName(index)


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, status, xml)``: one landed sitemap document per parent of ``edges``.

    h%10=3: status 404, no body; h%10=9: body cut inside a tag (malformed).
    A document holds at most ``PART_SPAN`` numbered links, so each is a bounded group.
    """
    e = edges(spark, sf_dir)
    body = (e.groupBy("parent").agg(
        F.max("h").alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "child"))),
                                 lambda s: F.concat(F.lit("<url><loc>"), _xml_escape(s["child"]),
                                                    F.lit("</loc></url>\n"))), "").alias("locs")))
    full = F.concat(F.lit(XML_HEAD), F.col("locs"), F.lit(XML_TAIL))
    hmod = F.col("h") % 10
    status = F.when(hmod == 3, F.lit(404)).otherwise(F.lit(200))
    truncated = F.substring(full, 1, F.instr(full, "</loc>") + 3)
    xml = F.when(hmod == 3, F.lit(None).cast("string")).when(hmod == 9, truncated).otherwise(full)
    return body.select(F.col("parent").alias("url"), status.alias("status"), xml.alias("xml"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, attempt, status, body)``: five fetch attempts per page.

    status null = the attempt raised; 200 carries the page, 503 an error body.
    """
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    p, a = F.col("page_id"), F.col("attempt")
    status = (F.when((p % 30 == 0) | ((p + a) % 4 == 0), F.lit(None).cast("int"))
              .when((p % 6 != 0) & ((p * 7 + a * 3) % 5 == 0), F.lit(200))
              .otherwise(F.lit(503)))
    return (pages.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(5))))
            .withColumn("status", status)
            .select("page_id", "url", "attempt", "status",
                    F.when(F.col("status") == 200, F.col("html"))
                    .when(F.col("status") == 503, F.lit("error")).alias("body")))


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, url)``: the hand-off file as lines, with padding, scheme swaps and blank lines."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    p = F.col("page_id")
    plain = pages.select((p * 4).alias("ord"), "url")
    padded = pages.filter(p % 4 == 0).select((p * 4 + 1).alias("ord"),
                                             F.concat(F.lit("  "), "url", F.lit("\t")).alias("url"))
    swapped_url = F.when(F.col("url").startswith("https://"),
                         F.concat(F.lit("http://"), F.substring("url", 9, 1 << 30))).otherwise(
        F.concat(F.lit("https://"), F.substring("url", 8, 1 << 30)))
    swapped = pages.filter(p % 5 == 0).select((p * 4 + 2).alias("ord"), swapped_url.alias("url"))
    blank = pages.filter(p % 20 == 0).select((p * 4 + 3).alias("ord"), F.lit("").alias("url"))
    return plain.unionByName(padded).unionByName(swapped).unionByName(blank)


def kb_docs(spark: SparkSession, sf_dir: str, base: str = KB_BASE) -> DataFrame:
    """``(path, text, source, doc_id)``: documents placed at ``<base>/<source>/<doc_id>.txt``."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = F.concat(F.lit(base), F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), "text", "source", "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, embedding, label)`` with a string id, the whole ``embeddings`` table."""
    emb = load(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def vectors_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored snapshot: every vector, version 1."""
    emb = load(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("string").alias("id"), "embedding", "label", F.lit(1).alias("version"))


def vectors_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming batch: every vector under twice its id, version 2, label+100 (half of the ids are new)."""
    emb = load(spark, sf_dir, "embeddings")
    return emb.select(
        (F.col("vec_id") * 2).cast("string").alias("id"), "embedding", (F.col("label") + 100).alias("label"),
        F.lit(2).alias("version"))


TOKEN_CYCLE = (50, 100, 250, 500, 1000, 75)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, body)``: one JSON request per user turn; optional keys left out."""
    conv = load(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    temperature = F.when(cid % 2 == 0, (cid % 13) / 10.0)
    tokens = F.when(turn % 3 == 0, F.element_at(F.array(*[F.lit(t) for t in TOKEN_CYCLE]),
                                                (cid % 6 + 1).cast("int")))
    body = F.to_json(F.struct(F.col("text").alias("prompt"), temperature.alias("temperature"),
                              tokens.alias("max_new_tokens")))
    return conv.filter(F.col("role") == "user").select("conv_id", "turn", body.alias("body"))


def stub_generate(prompt, conv_id):
    """Deterministic stand-in for the generator: echo minus two characters, then an answer."""
    return F.concat(F.substring(prompt, 3, 1 << 30), F.lit(" answer "), conv_id.cast("string"))


def stub_seconds(prompt):
    """The time that the stand-in reports for a call: one second per 128 characters."""
    return F.length(prompt) / F.lit(128.0)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, prompt, response)`` from the stub generator on the short prompt ``[x] <text>``."""
    conv = load(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    prompt = F.concat(F.lit("[x] "), F.col("text"))
    return conv.select("conv_id", "turn", prompt.alias("prompt"),
                       stub_generate(prompt, F.col("conv_id")).alias("response"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ts timestamp, kind, response_time_s)`` from ``events`` (ts cast from NTZ in a UTC session)."""
    ev = load(spark, sf_dir, "events")
    return ev.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
                     F.col("value").alias("response_time_s"))


CHAT_MODES = ("none", "dot", "l2", "other")


def corpus_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot-product collection: ``(id, embedding, metadata{file_path, source})``, id = vec_id.

    A vector's document is the one with ``doc_id = vec_id`` (null path when none).
    """
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    kb = kb_docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "path", "source")
    meta = F.create_map(F.lit("file_path"), F.col("path"), F.lit("source"), F.col("source"))
    return emb.join(kb, "vec_id", "left").select(F.col("vec_id").alias("id"), "embedding", meta.alias("metadata"))


def corpus_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 collection: ``(id = path, document, embedding, metadata{classification})`` for vectors with a document."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    kb = kb_docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "path", "text")
    return emb.join(kb, "vec_id").select(
        F.col("path").alias("id"), F.col("text").alias("document"), "embedding",
        F.create_map(F.lit("classification"), F.lit("public")).alias("metadata"))


def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions: ``(qid, conv_id, turn, text, mode, embedding, self_vec, self_path)``.

    A question's vector is the ``embeddings`` row with ``vec_id = conv_id``
    (the conversation's landed vector); it is excluded from its own results.
    ``mode`` cycles through the chat modes by ``conv_id + turn``.
    """
    conv = load(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    emb = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    kb = kb_docs(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), F.col("path").alias("self_path"))
    mode = F.element_at(F.array(*[F.lit(m) for m in CHAT_MODES]),
                        (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(CHAT_MODES))) + 1).cast("int"))
    return (conv.join(emb, "conv_id").join(kb, "conv_id", "left")
            .select((F.col("conv_id") * 10 + F.col("turn")).alias("qid"), "conv_id", "turn", "text",
                    mode.alias("mode"), "embedding", F.col("conv_id").alias("self_vec"), "self_path"))


def questions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every landed vector as a question ``(qid, embedding)`` (searched leave-one-out)."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
