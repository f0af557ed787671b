"""Streaming forms equal their batch forms; sinks append and overwrite as specified."""

import os
import tempfile

from conftest import SF_CHECK
from pyspark.sql import functions as F

from kbspark.operators import store as K
from kbspark.operators.metrics import daily_metrics
from kbspark.plans.ingest import build_kb
from kbspark.queries import QUERIES
from kbspark.sources import fixtures as X
from kbspark.streaming.metrics import run_request_metrics


def test_stream_metrics_equal_batch_for_closed_windows(spark):
    stream = run_request_metrics(spark, f"{SF_CHECK}/events.parquet")
    log = X.request_log(spark, SF_CHECK)
    last_day = log.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    batch = daily_metrics(log).filter(F.col("day") != last_day)
    cols = ["day", "kind", "requests", "avg_s", "max_s", "p50_s", "p95_s"]
    assert stream.count() == batch.count() == 145
    assert stream.select(cols).exceptAll(batch.select(cols)).count() == 0


def test_stream_populate_equals_batch_populate(spark):
    a = QUERIES["stream_populate"](spark, SF_CHECK)
    b = QUERIES["populate_index"](spark, SF_CHECK)
    assert a.count() == b.count() == 1000
    assert a.exceptAll(b).count() == 0


def test_append_sink_duplicates_on_rerun(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="kbspark-sink-"), "urls")
    urls = X.url_list(spark, SF_CHECK).select("url")
    K.append_table(urls, path)
    K.append_table(urls, path)
    assert spark.read.parquet(path).count() == 2 * urls.count()


def test_write_kb_replaces_only_written_hosts(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="kbspark-kb-"), "kb")
    kb = build_kb(X.url_list(spark, SF_CHECK).withColumnRenamed("url", "value"),
                  spark.read.parquet(f"{SF_CHECK}/pages.parquet"))
    K.write_kb(kb, path)
    n = spark.read.parquet(path).count()
    one_host = kb.select("host").first()[0]
    K.write_kb(kb.filter(F.col("host") == one_host).limit(1), path)
    after = spark.read.parquet(path)
    assert after.filter(F.col("host") == one_host).count() == 1
    assert after.filter(F.col("host") != one_host).count() == n - kb.filter(F.col("host") == one_host).count()


def test_stream_metrics_drop_rows_behind_the_watermark(spark):
    """Spark merges a late row while its window is still in state; once the watermark has
    evicted (emitted) the window, rows for it are dropped.  Three landings, one per batch."""
    from kbspark.streaming.metrics import windowed_metrics
    from kbspark.streaming.runner import landed_stream, run_available_now, stream_dir

    land = os.path.join(tempfile.mkdtemp(prefix="kbspark-land-"), "events")
    landings = [
        [(1, "2024-01-01 10:00:00", 1.0), (2, "2024-01-03 12:00:00", 2.0)],   # watermark -> Jan 3 11:00
        [(3, "2024-01-03 12:30:00", 5.0)],                                    # Jan 1 window evicted here
        [(4, "2024-01-01 11:00:00", 100.0),                                   # behind an evicted window: dropped
         (5, "2024-01-03 11:30:00", 3.0),                                     # late but within the delay
         (6, "2024-01-05 00:30:00", 4.0)],                                    # Jan 5 stays open
    ]
    for rows in landings:
        (spark.createDataFrame(rows, "event_id long, ts string, value double")
         .select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("q").alias("event_type"), "value")
         .coalesce(1).write.mode("append").parquet(land))
    src = landed_stream(spark, land, max_files=1).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
        F.col("value").alias("response_time_s"))
    base = stream_dir(spark, "late")
    out = windowed_metrics(src, window="1 day", watermark="1 hour")
    run_available_now(out, f"{base}/_checkpoint", f"{base}/out")
    got = {r.day: (r.requests, r.max_s) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {"2024-01-01": (1, 1.0), "2024-01-03": (3, 5.0)}


def test_stream_ingest_keeps_the_later_landing_of_a_url(spark):
    from kbspark.streaming.ingest import pages_stream, run_ingest
    from kbspark.streaming.runner import stream_dir

    land = os.path.join(tempfile.mkdtemp(prefix="kbspark-land-"), "pages")
    landings = [[(1, "https://a.example/x.html", "<p>first</p>"), (2, "https://a.example/y", "<p>y</p>")],
                [(3, "https://a.example/x.html", "<p>second copy</p>"), (4, "https://b.example/z", "<p>z</p>")]]
    for rows in landings:
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1) \
            .write.mode("append").parquet(land)
    root = stream_dir(spark, "kb")
    kb = run_ingest(spark, pages_stream(spark, land), root)
    got = {r.url: r.text for r in kb.collect()}
    assert got == {"https://a.example/x.html": "second copy", "https://a.example/y": "y", "https://b.example/z": "z"}
    spark.createDataFrame([(2, "https://a.example/x.html", "<p>third</p>")], "page_id long, url string, html string") \
        .coalesce(1).write.mode("append").parquet(land)
    again = run_ingest(spark, pages_stream(spark, land), root)        # resumes: only the new landing is read
    assert {r.url: r.text for r in again.collect()} == {**got, "https://a.example/x.html": "third"}


def test_second_populate_run_takes_the_updated_document(spark):
    from kbspark.streaming.populate import docs_stream, run_populate
    from kbspark.streaming.runner import stream_dir

    land = os.path.join(tempfile.mkdtemp(prefix="kbspark-land-"), "docs")
    root = stream_dir(spark, "collection")
    for rows in ([(1, "old text", "s"), (2, "other", "s")], [(1, "new text", "s")]):
        (spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
         .write.mode("append").parquet(land))
        coll = run_populate(spark, docs_stream(spark, land, "/kb"), root)
    assert sorted(r.document for r in coll.collect()) == ["new text", "other"]


def test_stream_metrics_of_a_shuffled_landing_of_four_files(spark):
    land = os.path.join(tempfile.mkdtemp(prefix="kbspark-land-"), "events")
    spark.read.parquet(f"{SF_CHECK}/events.parquet").repartition(4, "event_id").write.parquet(land)
    cols = ["day", "kind", "requests", "max_s"]
    a = run_request_metrics(spark, f"{SF_CHECK}/events.parquet").select(cols)
    b = run_request_metrics(spark, land).select(cols)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def _land(spark, land, rows):
    (spark.createDataFrame(rows, "event_id long, ts string, value double")
     .select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("q").alias("event_type"), "value")
     .coalesce(1).write.mode("append").parquet(land))


def test_stream_metrics_count_late_rows_over_several_runs(spark):
    from kbspark.streaming.metrics import apply_batch, closed_windows, events_stream, late_rows, open_rows
    from kbspark.streaming.runner import stream_dir

    land, root = os.path.join(tempfile.mkdtemp(prefix="kbspark-land-"), "events"), stream_dir(spark, "counted")
    landings = [[(1, "2024-01-01 10:00:00", 1.0), (2, "2024-01-03 12:00:00", 2.0)],
                [(3, "2024-01-01 11:00:00", 100.0), (4, "2024-01-03 11:30:00", 3.0), (5, None, 9.0),
                 (6, "2024-01-05 00:30:00", 4.0), (7, "2024-01-03 23:00:00", None)],
                [(8, "2024-01-04 23:30:00", 8.0), (9, "2024-01-03 00:00:00", 7.0)]]
    total = 0
    for rows in landings:
        _land(spark, land, rows)
        total += len(rows)
        closed = run_request_metrics(spark, land, root=root)
        counts = [closed, late_rows(spark, root), open_rows(spark, root)]
        assert sum(r.requests for c in counts for r in c.collect()) == total
    # Two batches closed a window each: Jan 1 at Jan 3 11:00; Jan 3 when Jan 5 came, half an hour early for Jan 4.
    assert {r.day: (r.requests, r.max_s, r.p50_s) for r in closed.collect()} == {
        "2024-01-01": (1, 1.0, 1.0), "2024-01-03": (3, 3.0, 2.0)}
    assert {(r.lane, r.day): r.requests for r in late_rows(spark, root).collect()} == {
        ("late", "2024-01-01"): 1, ("undated", None): 1, ("late", "2024-01-03"): 1}
    assert {r.day: r.requests for r in open_rows(spark, root).collect()} == {"2024-01-04": 1, "2024-01-05": 1}
    # A replayed batch changes nothing.
    before = sorted(map(tuple, closed.collect()))
    last = spark.read.parquet(land).filter("event_id >= 8").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("value").alias("response_time_s"))
    apply_batch(spark, last, 2, root, "1 day", "1 hour")
    assert sorted(map(tuple, closed_windows(spark, root).collect())) == before
    assert sum(r.requests for r in late_rows(spark, root).collect()) == 3
    assert events_stream(spark, land).isStreaming


def test_write_kb_sizes_files_by_bytes(spark):
    import pathlib

    path = os.path.join(tempfile.mkdtemp(prefix="kbspark-kb-"), "kb")
    rows = spark.range(0, 6000, numPartitions=3).select(
        F.concat(F.lit("/kb/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 400).cast("string"))).alias("host"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text"))
    target = 64 << 10
    K.write_kb(rows, path, target)
    assert spark.read.parquet(path).count() == 6000
    files = [len(spark.read.parquet(str(f)).select("text").collect()) * 256
             for f in pathlib.Path(path, "host=hot").glob("*.parquet")]
    whole = sorted(files)[2:]               # the first and last writer of a host share it with its neighbours
    assert len(files) >= 6 and all(target / 2 <= n <= 2 * target for n in whole), files
