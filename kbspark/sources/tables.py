"""Scans of landed tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.folder import read_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed HTML pages ``(page_id, url, html)``."""
    return load(spark, sf_dir, "pages").select("page_id", "url", "html")


def scan_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Sitemap bodies that were fetched with status 200 (others go to the error lane)."""
    return sitemaps.filter(F.col("status") == 200).select("url", "xml")


def strip_py(col: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind (Unicode aware)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def scan_url_list(lines: DataFrame, value: str = "value", order: str | None = "ord") -> DataFrame:
    """One URL per line, surrounding whitespace stripped, blank lines dropped.

    ``lines`` is ``spark.read.text(path)`` (column ``value``) or a table with
    an order column.  Without an order column the file order is kept with
    ``monotonically_increasing_id`` (partition index, then line position).
    """
    ordcol = F.col(order) if order else F.monotonically_increasing_id()
    return (lines.select(ordcol.alias("ord"), strip_py(F.col(value)).alias("url"))
            .filter(F.col("url") != ""))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """S2 over a text file (``spark.read.text`` keeps one row per line)."""
    return scan_url_list(spark.read.text(path), order=None)


def scan_kb_docs(spark: SparkSession, root: str, include_empty: bool = True) -> DataFrame:
    """S3: every ``*.txt`` below ``root`` as one row ``(path, text)``.

    Whole file per row, absolute path, CRLF normalised to LF as Python's text mode does; listed and read in tasks
    (:mod:`kbspark.sources.folder`).  Files without bytes are rows with an empty text unless ``include_empty`` is off.
    """
    texts = read_folder(spark, root)
    return texts if include_empty else texts.filter(F.octet_length("text") > 0)
