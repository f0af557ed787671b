"""HTML to visible text (P5, P6): JVM-side regular expressions, and a parser for the pages they cannot read.

The pattern removes what an HTML parser does not report as text: script,
style and template elements with their content, comments, doctype and
processing instructions, then every tag.  Character references are decoded
last, ``&amp;`` after all others so ``&amp;lt;`` becomes ``&lt;``.

A page goes to the parser (Arrow batches, a stream of tokens with the elements
that are open) if the pattern leaves something that opens markup (an unclosed
region, quote or tag, a stray end of a region), or if it has a character
reference that is numeric, unknown to the table or without a semicolon.  Both
read the same text from all other pages.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark import params as P
from kbspark.session import spread

# Non-text regions, then any start/end tag.  ``(?is)``: case-insensitive, dot matches newline.
# A tag runs to the first ``>`` outside a quoted attribute value, so ``title="a > b"`` or
# ``onclick="if(a>b)"`` stay inside the tag.  The JVM pattern uses possessive quantifiers (no
# backtracking on an unclosed quote) and leaves what opens an unclosed region in place; the RE2 form for the SQL oracle
# matches the same text on pages without one.
_REGIONS = (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
            r"|<!--.*?-->|<![^>]*>|<\?[^>]*>")
STRIP_PATTERN = _REGIONS.replace("<![^>]*>", "<!(?!--)[^>]*>") + r"""|</?(?!(?:script|style|template)\b)[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
STRIP_PATTERN_RE2 = _REGIONS + r"""|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_entities(text) -> Column:
    """Decode the named references of :data:`kbspark.params.HTML_ENTITIES` and decimal/hex numeric ones.

    Pass a plain column (not a compound expression): the value is read more
    than once.  :func:`extract_text` arranges that.
    """
    s = _c(text)
    for ent, ch in P.HTML_ENTITIES:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s


# What is left of markup when the pattern has gone over a page, and references that it does not decode.
_NAMES = "|".join([e[1:-1] for e, _ in P.HTML_ENTITIES if e[1] != "#"] + ["amp"])
_LEFT = r"(?s)<[a-zA-Z/!?]"
_UNREAD = (rf"(?is)&(?!(?:{_NAMES});|#39;)(?:#|[a-z])|<!--?-?>|--!>|</(?:script|style|template)\s*[^\s>]"
           r"|<(?:textarea|iframe|noembed|noframes|xmp|plaintext|noscript|title)\b[^>]*>[^<]*<(?!/)|<!\[CDATA\[")


def needs_parser(html, stripped) -> Column:
    """Is this a page that the pattern cannot read?  ``stripped`` is what :func:`strip_tags` leaves of it."""
    return F.coalesce(_c(stripped).rlike(_LEFT) | _c(html).rlike(_UNREAD), F.lit(False))


def strip_tags(html) -> Column:
    """P5 step 1: drop non-text regions and tags."""
    return F.regexp_replace(_c(html), STRIP_PATTERN, "")


def html_to_text(html) -> Column:
    """P5 as one column expression for pages that the pattern reads (tables: :func:`extract_text`)."""
    return F.replace(decode_entities(strip_tags(html)), F.lit("&amp;"), F.lit("&"))


def extract_text(df: DataFrame, html: str = "html", out: str = "text", tag: str | None = None) -> DataFrame:
    """P5/P6 on a table: visible text of ``html`` (or of its first ``tag`` element, if it has one) into ``out``.

    Done in projections so the tag-stripping pattern is evaluated once per row; the optimizer does not merge projections
    that would repeat it.  The parser is handed the pages that need it, and nulls for the others.
    """
    src = _c(html) if tag is None else F.coalesce(region_html(html, tag), _c(html))
    bare, hard = f"__{out}_stripped", f"__{out}_hard"
    unclear = needs_parser(html, bare) if tag is None else needs_parser(html, bare) | unclear_region(html, tag)
    return (spread(df).withColumn(bare, strip_tags(src))
            .withColumn(hard, F.when(unclear, _c(html)))
            .withColumn(hard, html_to_text_parser(hard, tag))
            .withColumn(out, F.coalesce(hard, F.replace(decode_entities(F.col(bare)), F.lit("&amp;"), F.lit("&"))))
            .drop(bare, hard))


def region_html(html, tag: str = "main") -> Column:
    """Inner html of the first ``<tag>`` element, null if absent."""
    m = F.regexp_extract(_c(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.when(_c(html).rlike(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), m)


def unclear_region(html, tag: str) -> Column:
    """Is there a ``<tag>`` whose element the pattern may misread: nested, unclosed, in a region without text, or with a
    quoted ``>``?"""
    name = rf"(?is)<{tag}\b"
    return (F.regexp_count(_c(html), F.lit(name)) != F.regexp_count(_c(html), F.lit(rf"(?is)</{tag}\s*>"))) \
        | _c(html).rlike(rf"{name}(?:(?!</{tag}\b).)*?<{tag}\b") | _c(html).rlike(rf"{name}[^>]*[\"'][^\"'>]*>[^\"'<]*[\"']") \
        | _c(html).rlike(rf"(?is)<(script|style|template)\b(?:(?!</\1).)*?</?{tag}\b|<!--(?:(?!-->).)*?</?{tag}\b")


class _TextCollector(HTMLParser):
    """Text of a document as an HTML parser reports it, of the whole page or of its first ``tag`` element."""

    SKIP = {"script", "style", "template"}

    def __init__(self, tag: str | None = None):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.region: list[str] = []
        self.skipped: list[str] = []     # open elements without text, innermost last
        self.tag = tag
        self.inside = 0                  # open elements of the wanted kind
        self.found = False               # its first one has begun

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped.append(tag)
        elif tag == self.tag and not self.skipped and (self.inside or not self.found):
            self.inside += 1
            self.found = True

    def handle_endtag(self, tag):
        if tag in self.skipped:          # ends what is open inside it, too
            while self.skipped.pop() != tag:
                pass
        elif tag == self.tag and self.inside and not self.skipped:
            self.inside -= 1

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)
            if self.inside:
                self.region.append(data)

    def text(self) -> str:
        return "".join(self.region if self.found else self.parts)


def parse_text(doc: str | None, tag: str | None = None) -> str | None:
    """Text of one document with the stdlib parser."""
    if doc is None:
        return None
    p = _TextCollector(tag)
    p.feed(doc)
    p.close()
    return p.text()


def html_to_text_parser(html, tag: str | None = None) -> Column:
    """P5/P6 by the parser, in Arrow batches (one call per batch; nulls stay null)."""
    import pandas as pd

    def _extract(s):
        return s.map(lambda doc: parse_text(doc, tag), na_action="ignore")

    from pyspark.sql import SparkSession

    from kbspark.session import ship_package

    ship_package(SparkSession.active())     # the UDF calls parse_text in the Python workers
    # Real (not postponed) annotations: the UDF kind is read from them.
    _extract.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(_extract, "string")(_c(html))
