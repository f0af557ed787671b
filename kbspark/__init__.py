"""kbspark: a text knowledge base built and queried with Spark DataFrames.

Sub-packages:

* ``sources``   -- scans of landed tables, sitemaps, url lists, text folders
* ``functions`` -- column expressions (urls, html, xml, json requests, prompts, vectors)
* ``operators`` -- DataFrame -> DataFrame operators (crawl, dedup, top-k, pooling, stores)
* ``plans``     -- composites: build the knowledge base, populate the index, answer questions
* ``streaming`` -- Structured Streaming forms of ingest, populate and request metrics
"""

__version__ = "0.1.0"
