"""Site -> knowledge base (R2): url list -> first visit -> scope -> landed page -> text -> path -> last write.

One DataFrame lineage, two shuffles: the first-visit reduction of the url
list (small columns only), and the join with the landed pages on url.
Text is extracted on the page side before that join so the shuffle carries
text, not markup; the last-write-wins reduction runs on (path, ord) before
the text is attached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.html import extract_text
from kbspark.functions.urls import host_of, in_scope, url_to_path
from kbspark.operators.dedup import first_occurrence, last_write_wins
from kbspark.params import DEFAULT, KbParams
from kbspark.sources.tables import scan_url_list


def planned_writes(url_lines: DataFrame, params: KbParams = DEFAULT, allowed_origins: DataFrame | None = None
                   ) -> DataFrame:
    """S2 + C4 + P4 + P8: ``(ord, url, path)`` for every url the job would visit, first occurrence wins.

    ``allowed_origins`` (column ``origin``) turns the scope test into a
    left-semi join against an allow-list; without it the original's test
    (url starts with its own origin) is applied.
    """
    urls = first_occurrence(scan_url_list(url_lines), "url", "ord")
    urls = urls.filter(in_scope(F.col("url")))
    if allowed_origins is not None:
        from kbspark.functions.urls import url_origin
        urls = (urls.withColumn("origin", url_origin(F.col("url")))
                .join(allowed_origins.select("origin"), "origin", "left_semi").drop("origin"))
    return urls.withColumn("path", url_to_path(F.col("url"), params.base_path))


def build_kb(url_lines: DataFrame, pages: DataFrame, params: KbParams = DEFAULT,
             allowed_origins: DataFrame | None = None, landing_order: str = "page_id") -> DataFrame:
    """R2: ``(path, url, host, text)`` -- one document per path, the last successful write wins.

    A url is written only if its page was landed (an inner join: unfetched
    urls go to :func:`unfetched`).  ``params.content_tag`` other than
    ``None`` extracts that region when the page has one (P6), else the page.
    A url landed several times (re-crawls) contributes its latest landing by
    ``landing_order``: the copies are reduced by url -- map-side first, on the
    partitioning the join needs anyway -- so a url with many copies is
    neither multiplied nor a hot join key.
    """
    writes = planned_writes(url_lines, params, allowed_origins)
    landed = writes.join(pages.select("url"), "url", "left_semi")
    winners = last_write_wins(landed.select("path", "ord", "url"), "path", "ord")
    tag = None if params.content_tag in (None, "", "page") else params.content_tag
    texts = extract_text(pages.select("url", "html", landing_order), "html", "text", tag=tag)
    latest = texts.groupBy("url").agg(F.max_by("text", landing_order).alias("text"))
    return (winners.join(latest, "url")
            .select("path", "url", host_of(F.col("url")).alias("host"), "text"))


def unfetched(url_lines: DataFrame, pages: DataFrame, params: KbParams = DEFAULT) -> DataFrame:
    """Error lane of R2: urls the job would visit that have no landed page."""
    writes = planned_writes(url_lines, params)
    return writes.join(pages.select("url"), "url", "left_anti").select("ord", "url", "path")
