"""Hand-written edge cases the landed tables do not contain (a few rows each)."""

import os
import tempfile

import numpy as np
import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F

from kbspark.functions import urls as U
from kbspark.functions.html import extract_text, html_to_text_parser, parse_text
from kbspark.functions.prompts import prompt_for, strip_echo
from kbspark.functions.requests import normalized_columns
from kbspark.functions.vectors import has_dimension, l2_normalize
from kbspark.operators import crawl as C
from kbspark.operators import dedup as D
from kbspark.operators import store as K
from kbspark.operators.embed import mean_pool
from kbspark.operators.topk import misfits, topk
from kbspark.sources.tables import load, read_url_list, scan_kb_docs


def one(spark, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}")


# --- links, urls, paths -------------------------------------------------------------------------

def test_classify_links(spark):
    df = spark.createDataFrame([(u,) for u in ["A.HTML", "a.html?x=1", " a.html", "a.xml", "a.pdf", None]],
                               "v string")
    got = [r[0] for r in df.select(U.classify_link(F.col("v"))).collect()]
    assert got == [None, None, "page", "sitemap", None, None]


def test_origin_and_scope(spark):
    rows = ["HTTPS://U:p@Host:80/a", "https://h.example/a", "no-scheme/a", "http://h:8080/x?q#f", "https://a b/c"]
    df = spark.createDataFrame([(u,) for u in rows], "v string")
    got = df.select(U.url_origin("v").alias("o"), U.in_scope(F.col("v")).alias("s")).collect()
    assert [r.o for r in got] == ["https://U:p@Host:80", "https://h.example", None, "http://h:8080", "https://a b"]
    assert [r.s for r in got] == [False, True, False, True, True]


def test_url_to_path_rules(spark):
    cases = {
        "https://a.example/x/y.html": "/base/a.example/x/y.txt",
        "http://a.example/x/y": "/base/a.example/x/y.txt",
        "https://a.example//b///c": "/base/a.example/b/c.txt",
        "https://a.example/": "/base/a.example.txt",
        "https://a.example/p?q=1#f": "/base/a.example/p?q=1#f.txt",
        "https://a.example/x.html.html": "/base/a.example/x.html.txt",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = dict(df.select("v", U.url_to_path(F.col("v"), "/base").alias("p")).collect())
    assert got == cases
    bad = spark.createDataFrame([("/base/a/../b.txt",), ("/base/a/b.txt",)], "p string")
    assert [r[0] for r in bad.select(U.path_has_parent_ref(F.col("p"))).collect()] == [True, False]


def test_paths_stay_under_base(spark):
    pages = load(spark, SF_CHECK, "pages")
    paths = pages.select(U.url_to_path(F.col("url"), "/base").alias("p"))
    assert paths.filter(~F.col("p").startswith("/base/") | U.path_has_parent_ref(F.col("p"))).count() == 0


def test_citation_and_ids(spark):
    df = one(spark, "/data/kb/a.example/x.txt")
    r = df.select(U.path_to_citation(F.col("v")).alias("c"), U.doc_id(F.col("v")).alias("i"),
                  U.doc_id_fallback(F.lit(None).cast("string"), F.lit("é" * 60)).alias("f")).first()
    assert r.c == "https://a.example/x.html"
    import hashlib
    assert r.i == hashlib.sha256(b"/data/kb/a.example/x.txt").hexdigest()[:10]
    assert r.f == "é" * 50


# --- sitemap XML ---------------------------------------------------------------------------------

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
XML_CASES = [
    ("good", f'<?xml version="1.0"?><urlset {NS}><url><loc>https://a/x.html</loc></url><url><loc/></url>'
             '<url><image:loc xmlns:image="http://i">https://a/i.xml</image:loc></url></urlset>'),
    ("cdata", f"<urlset {NS}><url><loc>https://a/<![CDATA[c?a&b]]>.html</loc></url></urlset>"),
    ("comment", f"<urlset {NS}><url><loc>https://a/<!-- x -->k.html</loc></url></urlset>"),
    ("index", f"<sitemapindex {NS}><sitemap><loc>https://a/more.xml</loc></sitemap>"
              "<deep><a><b><loc>https://a/d.html</loc></b></a></deep></sitemapindex>"),
    ("broken", f"<urlset {NS}><url><loc>https://a/x.html</loc></ur"),
    ("mark", f'\ufeff<?xml version="1.0" encoding="UTF-8"?><urlset {NS}><url><loc>https://a/m.html</loc></url></urlset>'),
    ("trailing", f"<urlset {NS}><url><loc>https://a/t.html</loc></url></urlset> and more"),
    ("two roots", f"<urlset {NS}><url><loc>https://a/1.html</loc></url></urlset><urlset {NS}/>"),
    ("other", '<urlset xmlns="http://other"><url><loc>https://a/o.html</loc></url></urlset>'),
    ("none", "<urlset><url><loc>https://a/n.html</loc></url></urlset>"),
    ("blank", ""),
    ("prefixed", '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>https://a/s.html'
                 '</s:loc></s:url><s:url><image:loc xmlns:image="http://i">https://a/i.xml</image:loc></s:url>'
                 '</s:urlset>'),
]


def test_extract_locs_edge_cases(spark):
    docs = spark.createDataFrame([(u, 200, x) for u, x in XML_CASES] + [("gone", 404, None), ("null", 200, None)],
                                 "url string, status int, xml string")
    states = dict(C.document_state(docs).select("url", "state").collect())
    bad = {"broken": "malformed", "trailing": "malformed", "two roots": "malformed", "blank": "malformed",
           "gone": "http_404", "null": "empty"}
    assert states == {**{u: "ok" for u, _ in XML_CASES}, **bad}
    locs = sorted((r.parent, r.pos, r.child) for r in C.extract_locs(docs).collect())
    assert locs == [("cdata", 0, "https://a/c?a&b.html"), ("comment", 0, "https://a/k.html"),
                    ("good", 0, "https://a/x.html"), ("index", 0, "https://a/more.xml"),
                    ("index", 1, "https://a/d.html"), ("mark", 0, "https://a/m.html"),
                    ("prefixed", 0, "https://a/s.html")]
    assert [r.child for r in C.extract_locs(docs, ns="").collect()] == ["https://a/n.html"]


def test_crawl_cycle_and_errors(spark):
    docs = spark.createDataFrame([
        ("r.xml", 200, f"<urlset {NS}><url><loc>a.xml</loc></url><url><loc>b.xml</loc></url></urlset>"),
        ("a.xml", 200, f"<urlset {NS}><url><loc>r.xml</loc></url><url><loc>p.html</loc></url><url><loc/></url></urlset>"),
        ("b.xml", 200, f"<urlset {NS}><url><loc>a.xml</loc></url><url><loc>p.html</loc></url><url><loc>gone.xml</loc></url></urlset>"),
    ], "url string, status int, xml string")
    reached = C.crawl(docs, "r.xml")
    got = sorted((r.url, r.kind, r.depth) for r in reached.collect())
    assert got == [("a.xml", "sitemap", 1), ("b.xml", "sitemap", 1), ("gone.xml", "sitemap", 2),
                   ("p.html", "page", 2), ("r.xml", "sitemap", 0)]
    errs = sorted(tuple(r) for r in C.crawl_errors(docs, reached).collect())
    assert errs == [("loc", "a.xml", "empty_loc x1"), ("sitemap", "gone.xml", "not_fetched")]


def test_crawl_follows_a_long_chain(spark):
    chain = [(f"s{i}.xml", 200, f"<urlset {NS}><url><loc>s{i + 1}.xml</loc></url></urlset>") for i in range(70)]
    docs = spark.createDataFrame(chain, "url string, status int, xml string")
    assert C.crawl(docs, "s0.xml").agg(F.max("depth")).first()[0] == 70


def test_topk_one_odd_question_leaves_the_others_their_answers(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 1.0])],
                              "qid long, embedding array<float>")
    corpus = spark.createDataFrame([(7, [1.0, 0.5]), (8, [0.0, 1.0])], "id long, embedding array<float>")
    got = sorted((r.qid, r.rank, r.id) for r in topk(q, corpus, k=2).collect())
    assert got == [(1, 1, 7), (1, 2, 8), (4, 1, 8), (4, 2, 7)]
    assert [tuple(r) for r in misfits(q, 2, "qid").orderBy("qid").collect()] == [(2, 3), (3, -1)]


def test_numeric_references_that_are_no_characters(spark):
    df = spark.createDataFrame([("<p>a&#9999999;b&#xD800;c&#0;d&#99999999999999999999;e&#65;&#x42;</p>",)], "html string")
    assert extract_text(df).first().text == "a\ufffdb\ufffdc\ufffdd\ufffdeAB"


def test_paths_that_leave_the_base_are_rejected(spark):
    df = spark.createDataFrame([("https://h/../../etc/x.html",), ("https://h/a..b/x.html",)], "u string")
    assert [r.p for r in df.select(U.url_to_path(F.col("u")).alias("p")).collect()] == [None, "/data/kb/h/a..b/x.txt"]


def _vectors(spark, *rows):
    return spark.createDataFrame([(i, v, {"a": "b"}, d, n) for i, v, d, n in rows], K.VECTOR_SCHEMA)


def _docs(df):
    return {r.id: r.document for r in df.collect()}


def test_collection_without_markers_keeps_its_rows(spark, tmp_path):
    root = str(tmp_path / "c")
    conf, setting = spark.sparkContext._jsc.hadoopConfiguration(), "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    conf.set(setting, "false")
    try:
        K.upsert_into(spark, root, _vectors(spark, *[(str(i), [1.0], "d", 0) for i in range(3)]))
        K.upsert_into(spark, root, _vectors(spark, ("1", [1.0], "e", 0)))
    finally:
        conf.set(setting, "true")
    assert _docs(K.get_or_create(spark, root)) == {"0": "d", "1": "e", "2": "d"}


def test_collection_batch_replayed_or_broken_off(spark, tmp_path):
    root = str(tmp_path / "c")
    K.upsert_into(spark, root, _vectors(spark, ("a", [1.0], "old", 1)))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    # What a write leaves that breaks off: files below _temporary, which no reader sees.
    left = tmp_path / "c" / "batch=2" / "_temporary" / "0"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"torn")
    assert _docs(K.get_or_create(spark, root)) == {"a": "old"}
    new = _vectors(spark, ("a", [1.0], "new", 2), ("b", [1.0], "b", 2))
    for _ in range(2):                                                  # the same batch again changes nothing
        K.upsert_into(spark, root, new, number=2)
        assert _docs(K.get_or_create(spark, root)) == {"a": "new", "b": "b"}
    assert {p: p.stat().st_mtime_ns for p in before} == before          # a batch leaves other files alone
    for _ in range(2):                                                  # a replayed "ignore" meets earlier batches only
        K.upsert_into(spark, root, _vectors(spark, ("b", [1.0], "late", 3), ("c", [1.0], "c", 3)), "ignore", number=3)
        assert _docs(K.get_or_create(spark, root)) == {"a": "new", "b": "b", "c": "c"}
    K.upsert_into(spark, root, _vectors(spark, ("b", [1.0], "b2", 4)))
    assert _docs(K.get_or_create(spark, root)) == {"a": "new", "b": "b2", "c": "c"}


def test_collection_of_one_dimension_and_first_rows(spark, tmp_path):
    root = str(tmp_path / "c")
    batch = _vectors(spark, ("a", [1.0, 0.0], "first", 1), ("a", [1.0, 0.0], "second", 1), ("b", [1.0], "short", 1),
                     ("c", None, "null", 1)).coalesce(1)
    got = K.upsert_into(spark, root, batch, "ignore", dim=2)
    assert _docs(got) == {"a": "first"}
    assert _docs(K.rejects(spark, root)) == {"b": "short", "c": "null"}
    assert _docs(K.upsert_into(spark, root, batch, "replace")) == {"a": "second"}
    with pytest.raises(ValueError):
        K.get_or_create(spark, root, dim=3)


# --- html -----------------------------------------------------------------------------------------

HTML_CASES = [
    '<script>var t="</p>";</script><p>a</p>',
    "<!-- <b>hidden</b> --><p>x</p>",
    "<p>&amp;lt; &#233; &#xE9; &nbsp;|</p>",
    "<br>line<br/>two",
    "<ul><li>one<li>two</ul>",
    "a < b",
    "<template><p>t</p></template>visible",
    "",
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>B</body></html>",
    '<a title="x>y">t</a>',
    "<img alt='a>b'>z<div onclick=\"if(a>b){go()}\">k</div>",
    # Pages that the pattern cannot read.
    "caf&eacute; &uuml; &notanentity; &amp &copy2 AT&T &",
    "&#38;amp; &#150; &#x80; &#0; &#xD800; &#99999999; &#xe9",
    "<p>a</p><script>var a=1; text",
    "a<style>p{", "a<template>b<p>c", "x<!-- never closed <b>y</b>", "b<!-->c<!---->d--!>e<!-- f --!>g",
    'a<a title="x', "a<b", "a<b class='", "a</b", "z</script>y", "<template>a<template>b</template>c</template>d",
    "<script>if (a<b) '</p>' </script >t<SCRIPT src=x></SCRIPT>u", "<![CDATA[x]]>y", "<?php echo 1 ?>z", "<textarea><b>k</b></textarea>",
    "<scripty>shown</scripty>", "&lt;script&gt;", "a\x00b<p",
]
REGION_CASES = [
    ("<main>a</main>b", "a"), ("<p>none</p>", "none"), ("<MAIN id='x>y'>a</MAIN>b", "a"),
    ("c<main>a<main>b</main>d</main>e", "abd"), ("c<main>a &eacute;", "a é"), ("<!-- <main>x</main> --><main>y</main>", "y"),
    ("<script>'<main>s</main>'</script><main>t<script>u</script></main>v", "t"), ("<main>a</main><main>b</main>", "a"),
    ("<main></main>rest", ""), (None, None),
]


def test_html_text_equals_parser(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HTML_CASES)], "i int, html string")
    got = dict(extract_text(df).select("i", "text").collect())
    for i, h in enumerate(HTML_CASES):
        assert got[i] == parse_text(h), (h, got[i])


def test_region_text(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(REGION_CASES)], "i int, html string")
    got = dict(extract_text(df, tag="main").select("i", "text").collect())
    assert [got[i] for i in range(len(REGION_CASES))] == [t for _, t in REGION_CASES]


def test_probe_pages(spark):
    """What a parser makes of the references and unclosed regions, stated."""
    probes = {"caf&eacute; &uuml;": "café ü", "&#38;amp;": "&amp;", "&#150;": "\u2013", "p<script>var a=1; text": "p",
              'q<a title="x': parse_text('q<a title="x'), "r<template>s": "r"}
    df = spark.createDataFrame(list(probes.items()), "html string, want string")
    assert {r.html: r.text for r in extract_text(df).collect()} == probes


def test_html_text_equals_parser_on_landed_pages(spark):
    pages = load(spark, SF_CHECK, "pages")
    fast = extract_text(pages.select("page_id", "html")).select("page_id", "text")
    slow = pages.select("page_id", html_to_text_parser(F.col("html")).alias("ptext"))
    diff = fast.join(slow, "page_id").filter(F.col("text") != F.col("ptext")).count()
    assert diff == 0


def test_parser_fallback_udf(spark):
    html = '<a title="x>y">t</a><script>x</script>'
    df = one(spark, html)
    assert df.select(html_to_text_parser(F.col("v"))).first()[0] == "t"


# --- files ------------------------------------------------------------------------------------------

def test_scan_kb_docs_files(spark):
    root = tempfile.mkdtemp(prefix="kbspark-test-")
    os.makedirs(os.path.join(root, "a", "b"))
    with open(os.path.join(root, "a", "b", "deep.txt"), "wb") as f:
        f.write("line1\r\nline2\r\n".encode("utf-8"))
    with open(os.path.join(root, "top.txt"), "w", encoding="utf-8") as f:
        f.write("plain")
    open(os.path.join(root, "empty.txt"), "w").close()
    with open(os.path.join(root, "skip.md"), "w") as f:
        f.write("not a kb file")
    with open(os.path.join(root, "café.txt"), "w", encoding="utf-8") as f:
        f.write("é")
    got = {os.path.basename(r.path): r.text for r in scan_kb_docs(spark, root).collect()}
    assert got["deep.txt"] == "line1\nline2\n"
    assert got["top.txt"] == "plain"
    assert got["empty.txt"] == ""
    assert "skip.md" not in got
    assert any(v == "é" for v in got.values())
    assert len(got) == 4


def test_read_url_list_file(spark):
    root = tempfile.mkdtemp(prefix="kbspark-test-")
    path = os.path.join(root, "urls.txt")
    with open(path, "w") as f:
        f.write("  https://a/x.html\t\n\nhttps://a/y.html\nhttps://a/x.html\n")
    urls = read_url_list(spark, path)
    assert [r.url for r in urls.orderBy("ord").collect()] == ["https://a/x.html", "https://a/y.html",
                                                              "https://a/x.html"]
    first = D.first_occurrence(urls, "url", "ord")
    assert first.count() == 2


# --- requests and prompts ---------------------------------------------------------------------------

def test_request_defaults_and_errors(spark):
    bodies = ['{"prompt": "p"}', '{}', '{"prompt": "p", "temperature": null}',
              '{"prompt": "p", "temperature": "0.7", "max_new_tokens": 100}',
              '{"prompt": "p", "top_k": "abc"}', '{not json']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    rows = {r.i: r for r in df.select("i", *normalized_columns(F.col("body"))).collect()}
    assert (rows[0].temperature, rows[0].max_new_tokens, rows[0].top_p, rows[0].error) == (0.0, 50, 1.0, None)
    assert rows[1].error == "missing prompt"
    assert rows[2].error == "bad temperature"
    assert (rows[3].temperature, rows[3].max_new_tokens, rows[3].error) == (0.7, 100, None)
    assert rows[4].error == "bad top_k"
    assert rows[5].error == "malformed body"


def test_prompt_and_echo(spark):
    df = spark.createDataFrame([("q", ""), ("q", "ctx"), ("q", None)], "q string, c string")
    p = [r[0] for r in df.select(prompt_for(F.col("q"), F.col("c"))).collect()]
    assert p[0].endswith(" \n [INST] q [/INST]") and "Please answer" in p[0]
    assert "information:\n ctx[/INST]</s> \n[INST] q [/INST]" in p[1]
    assert p[2] is None
    e = spark.createDataFrame([("abcdef", "abcd"), ("ab", "abcdefgh"), ("xyz", "a")], "o string, p string")
    got = [r[0] for r in e.select(strip_echo(F.col("o"), F.col("p"))).collect()]
    assert got == ["abcdef"[2:], "ab"[6:], "xyz"[-1:]]


# --- vectors ------------------------------------------------------------------------------------------

def test_normalize_zero_and_dimension(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), ([1.0],)], "v array<float>")
    r = df.select(l2_normalize(F.col("v")).alias("u"), has_dimension("v", 2).alias("ok")).collect()
    assert r[0].u == pytest.approx([0.6, 0.8]) and r[1].u == [0.0, 0.0]
    assert [x.ok for x in r] == [True, True, False, False]


def test_topk_ties_small_corpus_and_full_sort(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<float>")
    corpus = spark.createDataFrame([(10, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [0.0, 1.0]), (5, [1.0, 0.0, 0.0])],
                                   "id long, embedding array<float>").repartition(2)
    m = [tuple(r) for r in topk(q, corpus, k=5).orderBy("rank").collect()]
    assert m == [(1, 1, 7, 1.0), (1, 2, 10, 1.0), (1, 3, 3, 0.0)]   # tie by id, wrong dim dropped, k > n


def test_topk_equals_brute_force(spark):
    emb = load(spark, SF_CHECK, "embeddings").repartition(4)
    qs = emb.select(F.col("vec_id").alias("qid"), "embedding")
    corpus = emb.select(F.col("vec_id").alias("id"), "embedding")
    n = corpus.count()
    got = topk(qs, corpus, k=n, exclude="qid", block_bytes=4000).collect()
    pdf = emb.toPandas()
    M = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    ids = pdf.vec_id.to_numpy()
    S = M @ M.T
    by_q = {}
    for r in got:
        by_q.setdefault(r.qid, []).append((r.rank, r.id))
    for qi in range(0, len(ids), 37):
        order = [ids[j] for j in np.lexsort((ids, -S[qi])) if ids[j] != ids[qi]]
        assert [i for _, i in sorted(by_q[ids[qi]])] == order


def test_l2_and_dot_agree_on_unit_vectors(spark):
    emb = load(spark, SF_CHECK, "embeddings")
    qs = emb.select(F.col("vec_id").alias("qid"), "embedding")
    corpus = emb.select(F.col("vec_id").alias("id"), "embedding")
    a = topk(qs, corpus, k=1, metric="dot", exclude="qid").select("qid", F.col("id").alias("a"))
    b = topk(qs, corpus, k=1, metric="l2", exclude="qid").select("qid", F.col("id").alias("b"))
    assert a.join(b, "qid").filter(F.col("a") != F.col("b")).count() == 0


def test_mean_pool_zero_mask(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 0), (2, [5.0, 6.0], 0)],
                               "g int, embedding array<float>, mask int")
    got = {r.g: r.pooled for r in mean_pool(df, "g").collect()}
    assert got[1] == pytest.approx([1.0, 2.0]) and got[2] == [0.0, 0.0]


# --- upserts and snapshots ----------------------------------------------------------------------

def test_upsert_policies_in_batch_duplicates_and_replay(spark):
    old = spark.createDataFrame([("a", 1, 1)], "id string, label int, version int")
    new = spark.createDataFrame([("a", 2, 2), ("b", 3, 2), ("b", 4, 2)], "id string, label int, version int")
    rep = K.upsert_replace(old, new)
    assert dict((r.id, r.label) for r in rep.collect())["a"] == 2
    ign = K.upsert_ignore(old, new.withColumn("ord", F.col("label")).drop("version")
                          .withColumn("version", F.lit(2)).select("id", "label", "version", "ord").drop("ord"))
    assert dict((r.id, r.label) for r in ign.collect())["a"] == 1
    first = K.dedup_batch_first(new.withColumn("ord", F.col("label")), "id", "ord")
    assert dict((r.id, r.label) for r in first.collect())["b"] == 3
    # replaying a batch and applying an empty batch change nothing
    again = K.upsert_replace(rep, new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rep.collect()))
    empty = K.upsert_ignore(rep, new.limit(0))
    assert sorted(map(tuple, empty.collect())) == sorted(map(tuple, rep.collect()))


def test_collection_store_roundtrip(spark):
    parent = tempfile.mkdtemp(prefix="kbspark-store-")
    root = os.path.join(parent, "coll")
    rows = [(f"id{i}", [1.0, 0.0], {"file_path": f"/p{i}"}, "doc", 1) for i in range(20)]
    batch = spark.createDataFrame(rows, K.VECTOR_SCHEMA)
    K.upsert_into(spark, root, batch, "replace")
    K.upsert_into(spark, root, batch, "replace")          # replay: unchanged
    assert K.get_or_create(spark, root).count() == 20
    one = spark.createDataFrame([("id3", [0.0, 1.0], {"file_path": "/p3"}, "new", 2),
                                 ("idx", [0.0, 1.0], {"file_path": "/px"}, "new", 2)], K.VECTOR_SCHEMA)
    K.upsert_into(spark, root, one, "ignore")
    got = {r.id: r.document for r in K.get_or_create(spark, root).collect()}
    assert len(got) == 21 and got["id3"] == "doc" and got["idx"] == "new"
    K.upsert_into(spark, root, one, "replace")
    got = {r.id: r.document for r in K.get_or_create(spark, root).collect()}
    assert len(got) == 21 and got["id3"] == "new"
    assert K.list_collections(spark, parent) == ["coll"]


def test_topk_many_identical_vectors_stay_bounded(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<float>")
    corpus = spark.range(0, 5000, numPartitions=4).select(F.col("id"), F.array(F.lit(1.0), F.lit(0.0))
                                                          .cast("array<float>").alias("embedding"))
    m = topk(q, corpus, k=3).orderBy("rank").collect()
    assert [(r.rank, r.id, r.score) for r in m] == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]


def test_score_requests_keeps_bad_requests_as_error_rows(spark):
    from kbspark.plans.answer import request_log_rows, score_requests

    bodies = ['{"prompt": "hello"}', '{"prompt": "p", "temperature": "hot"}', "{broken"]
    rq = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "conv_id long, body string")

    def gen(df):
        return df.withColumn("output", F.concat(F.col("prompt"), F.lit("!")))

    out = {r.conv_id: r for r in score_requests(rq, gen).collect()}
    assert out[0].response == "hello!" and out[0].error is None and out[0].response_time_s is None
    assert out[1].response is None and out[1].error == "bad temperature"
    assert out[2].response is None and out[2].error == "malformed body"
    assert request_log_rows(score_requests(rq, gen)).count() == 1


def test_planned_writes_with_allowed_origins(spark):
    from kbspark.plans.ingest import planned_writes

    lines = spark.createDataFrame([(1, "https://a.example/x.html"), (2, " https://b.example/y \t"),
                                   (3, "https://a.example/x.html"), (4, "")], "ord long, value string")
    allow = spark.createDataFrame([("https://a.example",)], "origin string")
    got = [(r.ord, r.url) for r in planned_writes(lines, allowed_origins=allow).collect()]
    assert got == [(1, "https://a.example/x.html")]
    assert planned_writes(lines).count() == 2


def test_request_json_key_order(spark):
    import json

    from kbspark.functions.requests import request_json, response_json, response_text

    df = spark.createDataFrame([('say "hi"', 0.5, 100)], "p string, t double, n int")
    js = df.select(request_json(F.col("p"), F.col("t"), F.col("n"), 1.5).alias("j")).first().j
    parsed = json.loads(js)
    assert list(parsed) == ["request"]
    assert list(parsed["request"]) == ["prompt", "temperature", "max_new_tokens", "repetition_penalty"]
    assert parsed["request"] == {"prompt": 'say "hi"', "temperature": 0.5, "max_new_tokens": 100,
                                 "repetition_penalty": 1.5}
    back = df.select(response_text(response_json(F.col("p"))).alias("r")).first().r
    assert back == 'say "hi"'


def test_build_kb_keeps_latest_landing_of_a_url(spark):
    from kbspark.plans.ingest import build_kb

    lines = spark.createDataFrame([(1, "https://a.example/x.html"), (2, "https://a.example/y.html")],
                                  "ord long, value string")
    pages = spark.createDataFrame([(1, "https://a.example/x.html", "<p>old</p>"),
                                   (5, "https://a.example/x.html", "<p>new</p>"),
                                   (3, "https://a.example/y.html", "<p>y</p>")],
                                  "page_id long, url string, html string")
    got = {r.url: r.text for r in build_kb(lines, pages).collect()}
    assert got == {"https://a.example/x.html": "new", "https://a.example/y.html": "y"}


def test_fallbacks_beyond_broadcast_bounds_give_same_results(spark):
    from kbspark.plans.retrieve import lookup
    from kbspark.sources import fixtures as X

    docs = X.sitemaps(spark, SF_CHECK)
    a = C.crawl(docs, X.ROOT_SITEMAP)
    b = C.crawl(docs.repartition(3), X.ROOT_SITEMAP)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    small = X.kb_docs(spark, SF_CHECK).filter(F.col("doc_id") < 7).select("path")
    table = X.kb_docs(spark, SF_CHECK).select("path", "text")
    x = lookup(small, table, "path")
    y = lookup(F.broadcast(small), table, "path")
    assert x.count() == y.count() == 7 and x.exceptAll(y).count() == 0


def test_resolve_attempts_accept_last_response_option(spark):
    log = spark.createDataFrame([("u", 1, 503, "e1"), ("u", 2, None, None), ("u", 3, 500, "e3"),
                                 ("v", 1, None, None), ("w", 1, 503, "x"), ("w", 2, 200, "ok")],
                                "url string, attempt int, status int, body string")
    strict = {r.url: (r.attempt, r.outcome) for r in D.resolve_attempts(log).collect()}
    assert strict == {"u": (3, "error_response"), "v": (None, "no_response"), "w": (2, "ok")}
    loose = {r.url: r.outcome for r in D.resolve_attempts(log, accept_last_response=True).collect()}
    assert loose == {"u": "accepted_error", "v": "no_response", "w": "ok"}
