"""URL, path and id column expressions.

All are built-in Spark expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify_link(url) -> Column:
    """``page`` if the link ends with ``.html``, ``sitemap`` if ``.xml``, else null (dropped).

    Case-sensitive and untrimmed, like ``str.endswith``.
    """
    u = _c(url)
    return (F.when(u.endswith(P.PAGE_SUFFIX), F.lit("page"))
            .when(u.endswith(P.SITEMAP_SUFFIX), F.lit("sitemap")))


def url_origin(url) -> Column:
    """``scheme://authority`` -- scheme lower-cased, authority (user, port) as written.

    The authority is everything between ``//`` and the next ``/``, ``?`` or
    ``#``, as a URL splitter reports it (a malformed host is kept, not
    rejected).  Null when the string has no scheme.
    """
    u = _c(url)
    m = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)", 0)
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    auth = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(m != "", F.concat(F.lower(scheme), F.lit("://"), auth))


def in_scope(url, origin=None) -> Column:
    """The url starts with its own origin (false when the scheme is missing or upper-case)."""
    u = _c(url)
    o = url_origin(u) if origin is None else _c(origin)
    return F.coalesce(u.startswith(o), F.lit(False))


def drop_html_suffix(url) -> Column:
    """Remove one trailing ``.html``."""
    return F.regexp_replace(_c(url), r"\.html$", "")


def url_to_path(url, base: str = P.BASE_PATH, drop_html: bool = True) -> Column:
    """Storage path of a page.

    Every ``http:/`` and ``https:/`` is removed, ``/`` stripped at both ends,
    runs of ``/`` collapse, last segment + ``.txt`` under ``base``.  Query
    strings and fragments stay in the name.  A path with a ``..`` segment
    would leave the base folder; it is rejected (null).
    """
    u = drop_html_suffix(url) if drop_html else _c(url)
    s = F.replace(F.replace(u, F.lit("http:/"), F.lit("")), F.lit("https:/"), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(s, "^/+|/+$", ""), "/+", "/")
    path = F.concat(F.lit(base.rstrip("/")), F.lit("/"), s, F.lit(".txt"))
    return F.when(~path_has_parent_ref(s), path)


def path_has_parent_ref(path) -> Column:
    """Paths with a ``..`` segment would leave the base folder; reject them."""
    return _c(path).rlike(r"(^|/)\.\.(/|$|\.txt$)")


def path_to_citation(path, base: str = P.BASE_PATH) -> Column:
    """Citation url of a stored path: base removed, ``https://`` prefixed, ``.txt`` -> ``.html`` anywhere."""
    b = base.rstrip("/")
    s = F.replace(_c(path), F.lit(b + "/https:/"), F.lit("https://"))
    s = F.replace(s, F.lit(b + "/"), F.lit("https://"))
    return F.replace(s, F.lit(".txt"), F.lit(".html"))


def citation_link(url) -> Column:
    """P10: markdown link ``[Reference 1](url)``."""
    return F.concat(F.lit(P.CITATION_LINK_LABEL + "("), _c(url), F.lit(")"))


def with_citation(answer, link) -> Column:
    """P10: answer, blank line, pointer to the source."""
    return F.concat(_c(answer), F.lit(P.CITATION_HEAD), _c(link))


def doc_id(path, n: int = P.ID_HEX_CHARS) -> Column:
    """First ``n`` hex chars of SHA-256 of the path (UTF-8)."""
    return F.substring(F.sha2(_c(path), 256), 1, n)


def doc_id_fallback(path, text, n: int = P.FALLBACK_ID_CHARS) -> Column:
    """The path, or the first ``n`` characters (code points) of the text when there is none."""
    return F.coalesce(_c(path), F.substring(_c(text), 1, n))


def metadata_file_path(path) -> Column:
    """P13, dot-product backend: ``{file_path: path}``."""
    return F.create_map(F.lit("file_path"), _c(path))


def metadata_classification(value: str = P.CLASSIFICATION) -> Column:
    """P13, L2 backend: ``{classification: public}``."""
    return F.create_map(F.lit("classification"), F.lit(value))


def host_of(url) -> Column:
    """Host part of an absolute url (used for partitioning the knowledge base)."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)
