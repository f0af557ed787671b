"""Plan-shape checks: the scale properties the design relies on, read from the physical plans."""

import re

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from kbspark.queries import QUERIES

STREAMED = {"stream_request_metrics", "stream_populate", "stream_ingest_pages"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_cross_joins(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_topk_scores_in_tasks_and_limits_before_shuffle(spark):
    p = plan(QUERIES["topk_cosine"](spark, SF_SMALL))
    assert "FlatMapCoGroupsInPandas" in p
    assert p.count("WindowGroupLimit") >= 2          # partial (before the shuffle) and final


def test_retrieval_reads_big_tables_through_semi_joins(spark):
    p = plan(QUERIES["retrieve_p"](spark, SF_SMALL))
    assert len(re.findall(r"Join .*LeftSemi", p)) >= 2                # corpus paths and document text


def test_keyed_reductions_aggregate_before_the_shuffle(spark):
    for name, op in [("dedup_urls", "HashAggregate"), ("request_metrics_daily", "ObjectHashAggregate"),
                     ("resolve_fetch_attempts", "SortAggregate"), ("mean_pool", "ObjectHashAggregate")]:
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert p.count(op) >= 2, name               # partial + final around the exchange


def test_url_only_scans_prune_the_html_column(spark):
    df = QUERIES["path_collisions"](spark, SF_SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(mode))
    assert schemas and all("html" not in s for s in schemas), schemas


def test_attempts_are_resolved_without_page_bodies(spark):
    df = QUERIES["resolve_fetch_attempts"](spark, SF_SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(mode))
    assert schemas and all("html" not in s for s in schemas), schemas


def test_upsert_finds_winners_without_vectors(spark):
    df = QUERIES["upsert_replace"](spark, SF_SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(mode))
    assert schemas and all("embedding" not in s for s in schemas), schemas


def test_metrics_use_no_sketch(spark):
    assert "percentile_approx" not in plan(QUERIES["request_metrics_daily"](spark, SF_SMALL))


def test_crawl_levels_shuffle_no_links(spark):
    """Joined without broadcasts, a level has an exchange on the frontier's side only."""
    import uuid

    from kbspark.operators.crawl import next_level, write_links
    from kbspark.session import ensure_checkpoint_dir
    from kbspark.sources import fixtures as X

    name = f"links_{uuid.uuid4().hex}"
    links = write_links(X.sitemaps(spark, SF_SMALL), name, f"{ensure_checkpoint_dir(spark)}/{name}")
    salts = links.groupBy("parent").agg((F.max("salt") + 1).alias("salts")).checkpoint()
    start = spark.createDataFrame([(X.ROOT_SITEMAP,)], "url string").checkpoint()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = plan(next_level(links, salts, start, start, 1).filter("kind = 'sitemap'"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE {name}")
    scan = p[:p.index(f"FileScan parquet spark_catalog.default.{name}")]
    # From the join down to the scan of the links there is no exchange.
    side = scan[scan.rindex("SortMergeJoin"):]
    assert "Exchange" not in side, p
