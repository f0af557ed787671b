"""Derived fixtures reproduce the counts stated for them (sf0.01)."""

from conftest import SF_CHECK
from pyspark.sql import functions as F

from kbspark.operators import crawl as C
from kbspark.operators import store as K
from kbspark.sources import fixtures as X


def test_edges_and_sitemaps(spark):
    assert X.edges(spark, SF_CHECK).count() == 351
    sm = X.sitemaps(spark, SF_CHECK)
    st = {r["state"]: r["count"] for r in C.document_state(sm).groupBy("state").count().collect()}
    assert st == {"ok": 56, "malformed": 2, "http_404": 6}
    assert C.extract_locs(sm).count() == 326


def test_crawl_depths(spark):
    reached = C.crawl(X.sitemaps(spark, SF_CHECK), X.ROOT_SITEMAP)
    got = {(r["depth"], r["kind"]): r["count"] for r in reached.groupBy("depth", "kind").count().collect()}
    assert got == {(0, "sitemap"): 1, (1, "sitemap"): 58, (2, "page"): 32, (2, "sitemap"): 5, (3, "page"): 27}


def test_url_list_and_requests(spark):
    assert X.url_list(spark, SF_CHECK).count() == 376
    assert X.requests(spark, SF_CHECK).count() == 279


def test_upsert_label_sums(spark):
    old, new = X.vectors_old(spark, SF_CHECK), X.vectors_new(spark, SF_CHECK)
    rep = K.upsert_replace(old, new)
    ign = K.upsert_ignore(old, new)
    stored = {r.id: r.label for r in old.collect()}
    batch = {r.id: r.label for r in new.collect()}
    assert len(stored) == len(batch) == 500 and len(stored.keys() & batch.keys()) == 250
    assert {r.id: r.label for r in rep.collect()} == {**stored, **batch}
    assert {r.id: r.label for r in ign.collect()} == {**batch, **stored}


def test_visit_order_has_no_ties(spark):
    urls = X.url_list(spark, SF_CHECK)
    assert urls.select("ord").distinct().count() == urls.count()


def test_sitemap_pagination_keeps_reachable_pages(spark, monkeypatch):
    from conftest import SF_SMALL

    plain = C.crawl(X.sitemaps(spark, SF_SMALL), X.ROOT_SITEMAP)
    monkeypatch.setattr(X, "PART_SPAN", 10)
    docs = X.sitemaps(spark, SF_SMALL)
    paged = C.crawl(docs, X.ROOT_SITEMAP)
    pages = lambda df: {r.url for r in df.filter(F.col("kind") == "page").collect()}
    assert pages(paged) == pages(plain)
    assert paged.filter(F.col("url").contains("-p")).count() > 0
    # Every document stays small: at most as many numbered links as the span.
    numbered = C.extract_locs(docs).filter(~F.col("child").rlike(r"-p\d+\.xml$|more\.xml$|root\.example"))
    assert numbered.groupBy("parent").count().agg(F.max("count")).first()[0] <= 10
