"""Sitemap crawl over landed sitemap documents.

The original walks sitemaps depth-first over the network.  Here the landed
documents are parsed once into a bucketed link table, and the walk is a
breadth-first loop of joins: one write per depth, with the set of visited
sitemaps as state.  Pages are leaves; they are kept per depth and reduced to
their smallest depth at the end, so only sitemaps (the small part of the graph)
take part in the visited-set anti join.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kbspark.functions.sitemap import PARSED_SCHEMA, SITEMAP_NS, parse_documents
from kbspark.functions.urls import classify_link
from kbspark.session import ensure_checkpoint_dir


def document_state(docs: DataFrame, ns: str = SITEMAP_NS) -> DataFrame:
    """``(url, state, locs, empty_locs)`` per landed sitemap body, each parsed once.

    ``state`` is ``ok``, ``http_<status>``, ``empty`` (no body) or ``malformed``;
    ``locs`` are the texts of the ``loc`` elements of namespace ``ns``.
    """
    return (docs.select("url", "status", "xml")
            .mapInArrow(functools.partial(parse_documents, ns=ns), PARSED_SCHEMA))


def extract_locs(docs: DataFrame, ns: str = SITEMAP_NS) -> DataFrame:
    """``(parent, pos, child)`` for every ``loc`` of every well-formed document (status 200)."""
    return document_state(docs, ns).select(F.col("url").alias("parent"), F.posexplode("locs").alias("pos", "child"))


def classify_links(links: DataFrame, col: str = "child") -> DataFrame:
    """Keep ``.html`` (page) and ``.xml`` (sitemap) links, tagged with ``kind``."""
    return links.withColumn("kind", classify_link(F.col(col))).filter(F.col("kind").isNotNull())


#: Links of one parent that share a bucket key; a sitemap with more is salted.
LINKS_A_SALT = 50_000


def write_links(docs: DataFrame, name: str, folder: str, ns: str = SITEMAP_NS) -> DataFrame:
    """The link table ``(parent, salt, child, kind)`` of landed sitemaps as the table ``name``, bucketed by parent and salt.

    Parsed and shuffled once; a crawl's levels join it where it lies.  Salts follow the position in the document, so a
    sitemap with a large share of all links is spread over ``ceil(links / LINKS_A_SALT)`` keys.
    """
    spark = docs.sparkSession
    links = (classify_links(extract_locs(docs, ns))
             .withColumn("salt", F.floor(F.col("pos") / LINKS_A_SALT).cast("int")).select("parent", "salt", "child", "kind"))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (links.repartition(buckets, "parent", "salt").write.option("path", folder).bucketBy(buckets, "parent", "salt")
     .sortBy("parent").saveAsTable(name))
    return spark.table(name)


def next_level(links: DataFrame, salts: DataFrame, frontier: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    """``(url, kind, depth)`` that the frontier's sitemaps (``url``) link to, without visited sitemaps."""
    parents = (frontier.join(salts, frontier["url"] == salts["parent"])
               .select("parent", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt")))
    found = links.join(parents, ["parent", "salt"]).select(F.col("child").alias("url"), "kind").distinct()
    # Pages are leaves: only sitemaps meet the visited ones.
    met = visited.select(F.col("url").alias("url"), F.lit("sitemap").alias("kind"))
    return found.join(met, ["url", "kind"], "left_anti").withColumn("depth", F.lit(depth))


def crawl(docs: DataFrame, root: str, ns: str = SITEMAP_NS) -> DataFrame:
    """Every page and sitemap reachable from ``root``, at its smallest depth.

    Set semantics: a sitemap is expanded once even when several sitemaps (or a
    cycle) lead to it.  The link table is bucketed by parent, so a level shuffles
    its frontier only; every level is one write into the shared checkpoint
    folder, which also counts its sitemaps, so a lost executor only repeats one
    level.  The visited set ends the walk, however long a chain of sitemaps is.
    """
    spark = docs.sparkSession
    run = uuid.uuid4().hex
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crawl-{run}"
    table = f"crawl_links_{run}"
    links = write_links(docs, table, f"{folder}/links", ns)
    salts = links.groupBy("parent").agg((F.max("salt") + 1).alias("salts"))
    salts.write.parquet(f"{folder}/salts")
    salts = spark.read.parquet(f"{folder}/salts")
    schema = "url string, kind string, depth int"
    spark.createDataFrame([(root, "sitemap", 0)], schema).write.parquet(f"{folder}/levels/level=0")
    depth, maps = 0, 1
    while maps:
        frontier = spark.read.schema(schema).parquet(f"{folder}/levels/level={depth}").filter("kind = 'sitemap'")
        visited = spark.read.schema(schema).parquet(
            *[f"{folder}/levels/level={i}" for i in range(depth + 1)]).filter("kind = 'sitemap'")
        depth += 1
        seen = Observation()
        level = next_level(links, salts, frontier.select("url"), visited, depth)
        (level.observe(seen, F.count(F.when(F.col("kind") == "sitemap", True)).alias("maps"))
         .write.parquet(f"{folder}/levels/level={depth}"))
        maps = seen.get["maps"]
    spark.sql(f"DROP TABLE {table}")
    levels = [f"{folder}/levels/level={i}" for i in range(depth + 1)]
    return spark.read.schema(schema).parquet(*levels).groupBy("url", "kind").agg(F.min("depth").alias("depth"))


def crawl_errors(docs: DataFrame, reached: DataFrame, ns: str = SITEMAP_NS) -> DataFrame:
    """The error lane of a crawl, ``(stage, key, message)``.

    A reached sitemap that has no landed body, a non-200 status or a malformed
    body; and each well-formed body with ``loc`` elements that carry no text.
    """
    maps = reached.filter(F.col("kind") == "sitemap").select("url")
    state = document_state(docs, ns)
    fetched = (maps.join(state.select("url", "state"), "url", "left")
               .filter(F.col("state").isNull() | (F.col("state") != "ok"))
               .select(F.lit("sitemap").alias("stage"), F.col("url").alias("key"),
                       F.coalesce(F.col("state"), F.lit("not_fetched")).alias("message")))
    empty = (maps.join(state.select("url", F.col("empty_locs").alias("n")).filter(F.col("n") > 0), "url")
             .select(F.lit("loc").alias("stage"), F.col("url").alias("key"),
                     F.concat(F.lit("empty_loc x"), F.col("n").cast("string")).alias("message")))
    return fetched.unionByName(empty)
