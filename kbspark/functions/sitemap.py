"""Sitemap XML (P1): a document's state and links, read by one tree parser.

One document is the unit of work; Arrow batches of documents go through the
standard library's parser, so the gate (is it well-formed?) and the reading of
links can never disagree.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa

SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
PARSED_SCHEMA = "url string, state string, locs array<string>, empty_locs int"


def read_locs(xml: str, ns: str = SITEMAP_NS) -> tuple[list[str], int] | None:
    """``(texts of the loc elements of namespace ns, loc elements without text)``; None when malformed.

    A leading byte-order mark is skipped; comments and CDATA marks inside an
    element do not split its text; an empty ``ns`` asks for elements of no namespace.
    """
    try:
        root = ElementTree.fromstring(xml.removeprefix("\ufeff"))
    except (ElementTree.ParseError, ValueError):
        return None
    texts = [e.text for e in root.iter(f"{{{ns}}}loc" if ns else "loc")]
    locs = [t for t in texts if t]
    return locs, len(texts) - len(locs)


def parse_documents(batches: Iterator[pa.RecordBatch], ns: str = SITEMAP_NS) -> Iterator[pa.RecordBatch]:
    """Batches of ``(url, status, xml)`` -> :data:`PARSED_SCHEMA`; one bad document is a state, never a failure."""
    for batch in batches:
        states, locs, empty = [], [], []
        for status, xml in zip(batch.column("status").to_pylist(), batch.column("xml").to_pylist()):
            found = None
            if status is not None and status != 200:
                state = f"http_{status}"
            elif xml is None:
                state = "empty"
            else:
                found = read_locs(xml, ns)
                state = "malformed" if found is None else "ok"
            states.append(state)
            locs.append(found[0] if found else [])
            empty.append(found[1] if found else 0)
        yield pa.RecordBatch.from_pydict({
            "url": batch.column("url"), "state": pa.array(states, pa.string()),
            "locs": pa.array(locs, pa.list_(pa.string())), "empty_locs": pa.array(empty, pa.int32())})
