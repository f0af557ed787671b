"""Oracle SQL (DuckDB) for the registered queries, written from the semantics.

Derived tables are recomputed in SQL from the landed views; crawl oracles
walk the link table with a recursive CTE and never parse XML; request
oracles compute field values directly instead of parsing JSON.
Numeric character references are not decoded here (the landed pages have
none; the Spark side handles them and is unit-tested).
"""

from __future__ import annotations

from kbspark import params as P
from kbspark.functions.html import STRIP_PATTERN_RE2
from kbspark.sources.fixtures import CHAT_MODES, FAR, KB_BASE, PART_SPAN, ROOT_SITEMAP, TOKEN_CYCLE


def _q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


ROOT = _q(ROOT_SITEMAP)

CTE: dict[str, str] = {
    "hosts": """hosts AS (
  SELECT host, min(page_id) AS h, 'https://' || host || '/sitemap.xml' AS sm
  FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id FROM pages) GROUP BY host)""",
    "page_hosts": """page_hosts AS (
  SELECT p.page_id, p.url, hs.host, hs.h, hs.sm FROM pages p
  JOIN hosts hs ON regexp_extract(p.url, '^[a-z]+://([^/?#]+)', 1) = hs.host)""",
    "link_edges": f"""link_edges AS (
  SELECT {ROOT} AS parent, sm AS child, h AS pos, NULL::BIGINT AS h FROM hosts
  UNION ALL SELECT sm, url, page_id, h FROM page_hosts
  UNION ALL SELECT sm, {ROOT}, {FAR}, h FROM hosts WHERE h % 10 = 7
  UNION ALL SELECT sm, 'https://' || host || '/more.xml', {FAR}, h FROM hosts WHERE h % 10 = 5
  UNION ALL SELECT 'https://' || host || '/more.xml',
    regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '\\.html$', '') || '.html',
    page_id, h FROM page_hosts WHERE h % 10 = 5)""",
    "parts": f"""parts AS (
  SELECT *, CASE WHEN pos < {FAR} THEN pos // {PART_SPAN} ELSE 0 END AS part FROM link_edges)""",
    "part_urls": """part_urls AS (
  SELECT *, regexp_replace(parent, '\\.xml$', '') || '-p' || part::VARCHAR || '.xml' AS part_url FROM parts)""",
    "edges": f"""edges AS (
  SELECT CASE WHEN part > 0 THEN part_url ELSE parent END AS parent, child, pos, h FROM part_urls
  UNION ALL SELECT DISTINCT parent, part_url, {FAR} + part, h FROM part_urls WHERE part > 0)""",
    "sitemap_docs": """sitemap_docs AS (
  SELECT parent AS url, CASE WHEN max(h) % 10 = 3 THEN 404 ELSE 200 END AS status,
         CASE WHEN max(h) % 10 = 3 THEN 'http_404' WHEN max(h) % 10 = 9 THEN 'malformed' ELSE 'ok' END AS state
  FROM edges GROUP BY parent)""",
    "links": """links AS (
  SELECT e.parent, e.pos, e.child,
         CASE WHEN ends_with(e.child, '.html') THEN 'page' WHEN ends_with(e.child, '.xml') THEN 'sitemap' END AS kind
  FROM edges e JOIN sitemap_docs s ON e.parent = s.url WHERE s.state = 'ok')""",
    "walk": f"""walk(url, kind, depth) AS (
  SELECT {ROOT}, 'sitemap', 0
  UNION
  SELECT l.child, l.kind, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.url
  WHERE w.kind = 'sitemap' AND l.kind IS NOT NULL AND w.depth <= (SELECT count(*) FROM sitemap_docs))""",
    "url_list": """url_list AS (
  SELECT page_id * 4 AS ord, url FROM pages
  UNION ALL SELECT page_id * 4 + 1, '  ' || url || chr(9) FROM pages WHERE page_id % 4 = 0
  UNION ALL SELECT page_id * 4 + 2, CASE WHEN starts_with(url, 'https://') THEN 'http://' || substr(url, 9)
                                     ELSE 'https://' || substr(url, 8) END FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT page_id * 4 + 3, '' FROM pages WHERE page_id % 20 = 0)""",
    "scanned": """scanned AS (
  SELECT ord, url FROM (SELECT ord, regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS url FROM url_list) WHERE url <> '')""",
    "visits": f"""visits AS (
  SELECT ord, url, {_q(P.BASE_PATH + '/')} || regexp_replace(regexp_replace(
           replace(replace(regexp_replace(url, '\\.html$', ''), 'http:/', ''), 'https:/', ''),
           '^/+|/+$', '', 'g'), '/+', '/', 'g') || '.txt' AS path
  FROM (SELECT min(ord) AS ord, url FROM scanned GROUP BY url)
  WHERE starts_with(url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://'
                         || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
    AND regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) <> '')""",
    "fetch_log": """fetch_log AS (
  SELECT p.page_id, p.url, a.attempt,
         CASE WHEN p.page_id % 30 = 0 OR (p.page_id + a.attempt) % 4 = 0 THEN NULL
              WHEN p.page_id % 6 <> 0 AND (p.page_id * 7 + a.attempt * 3) % 5 = 0 THEN 200 ELSE 503 END AS status
  FROM pages p CROSS JOIN (SELECT unnest(range(1, 6))::INTEGER AS attempt) a)""",
    "kb_docs": f"""kb_docs AS (
  SELECT {_q(KB_BASE + '/')} || source || '/' || doc_id::VARCHAR || '.txt' AS path, text, source, doc_id FROM documents)""",
    "dotc": """dotc AS (
  SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS cv, k.path, k.source
  FROM embeddings e LEFT JOIN kb_docs k ON k.doc_id = e.vec_id)""",
    "l2c": """l2c AS (
  SELECT k.path AS id, k.text AS document, e.embedding::DOUBLE[] AS cv
  FROM embeddings e JOIN kb_docs k ON k.doc_id = e.vec_id)""",
    "vq": """vq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings)""",
    "cq": f"""cq AS (
  SELECT c.conv_id * 10 + c.turn AS qid, c.conv_id, c.turn, c.text,
         [{', '.join(_q(m) for m in CHAT_MODES)}][((c.conv_id + c.turn) % {len(CHAT_MODES)}) + 1] AS mode,
         e.embedding::DOUBLE[] AS qv, c.conv_id AS self_vec, k.path AS self_path
  FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id
  LEFT JOIN kb_docs k ON k.doc_id = c.conv_id WHERE c.role = 'user')""",
    "p_best": """p_best AS (
  SELECT qid, id, score, path FROM (
    SELECT q.qid, c.id, c.path, round(list_dot_product(q.qv, c.cv), 6) AS score,
           row_number() OVER (PARTITION BY q.qid ORDER BY list_dot_product(q.qv, c.cv) DESC, c.id) AS rn
    FROM cq q JOIN dotc c ON c.id <> q.self_vec) WHERE rn = 1)""",
    "c_best": """c_best AS (
  SELECT qid, id, score, document FROM (
    SELECT q.qid, c.id, c.document, round(list_distance(q.qv, c.cv) ^ 2, 6) AS score,
           row_number() OVER (PARTITION BY q.qid ORDER BY list_distance(q.qv, c.cv), c.id) AS rn
    FROM cq q JOIN l2c c ON c.id IS DISTINCT FROM q.self_path) WHERE rn = 1)""",
    "requests": f"""requests AS (
  SELECT conv_id, turn, text AS prompt,
         CASE WHEN conv_id % 2 = 0 THEN (conv_id % 13)::DOUBLE / 10.0 END AS t_raw,
         CASE WHEN turn % 3 = 0 THEN [{', '.join(str(t) for t in TOKEN_CYCLE)}][(conv_id % 6) + 1] END AS n_raw
  FROM conversations WHERE role = 'user')""",
    "responses": """responses AS (
  SELECT conv_id, turn, '[x] ' || text AS prompt, substr('[x] ' || text, 3) || ' answer ' || conv_id::VARCHAR AS response
  FROM conversations WHERE role = 'user')""",
    "request_log": """request_log AS (SELECT ts, event_type AS kind, value AS response_time_s FROM events)""",
}

DEPS: dict[str, tuple[str, ...]] = {
    "page_hosts": ("hosts",), "link_edges": ("hosts", "page_hosts"), "parts": ("link_edges",), "part_urls": ("parts",), "edges": ("part_urls",), "sitemap_docs": ("edges",),
    "links": ("sitemap_docs",), "walk": ("links",), "scanned": ("url_list",), "visits": ("scanned",),
    "dotc": ("kb_docs",), "l2c": ("kb_docs",), "cq": ("kb_docs",), "p_best": ("cq", "dotc"),
    "c_best": ("cq", "l2c"),
}


def _with(names: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(n):
        for dep in DEPS.get(n, ()):
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    recursive = "RECURSIVE " if "walk" in order else ""
    return f"WITH {recursive}" + ",\n".join(CTE[n] for n in order) + "\n" + body


def _text_of(html: str) -> str:
    s = f"regexp_replace({html}, {_q(STRIP_PATTERN_RE2)}, '', 'g')"
    for ent, ch in P.HTML_ENTITIES:
        s = f"replace({s}, {_q(ent)}, {_q(ch)})"
    return f"replace({s}, '&amp;', '&')"


def _path(url: str, base: str = P.BASE_PATH) -> str:
    return (f"{_q(base.rstrip('/') + '/')} || regexp_replace(regexp_replace(replace(replace("
            f"regexp_replace({url}, '\\.html$', ''), 'http:/', ''), 'https:/', ''), '^/+|/+$', '', 'g'), "
            f"'/+', '/', 'g') || '.txt'")


def _citation(path: str, base: str = P.BASE_PATH) -> str:
    b = base.rstrip("/")
    return (f"replace(replace(replace({path}, {_q(b + '/https:/')}, 'https://'), {_q(b + '/')}, 'https://'), "
            f"'.txt', '.html')")


def _prompt_plain(q: str) -> str:
    return f"{_q(P.SYSTEM_PROMPT + ' ' + P.PLAIN_INSTRUCTION + P.PLAIN_QUESTION_HEAD)} || {q} || {_q(P.QUESTION_TAIL)}"


def _prompt_ctx(q: str, ctx: str) -> str:
    return (f"{_q(P.SYSTEM_PROMPT + ' ' + P.CONTEXT_INSTRUCTION_HEAD)} || {ctx} || "
            f"{_q(P.CONTEXT_INSTRUCTION_TAIL + P.CONTEXT_QUESTION_HEAD)} || {q} || {_q(P.QUESTION_TAIL)}")


def _prompt_for(q: str, ctx: str) -> str:
    return f"CASE WHEN {ctx} = '' THEN {_prompt_plain(q)} ELSE {_prompt_ctx(q, ctx)} END"


def _with_citation(answer: str, url: str) -> str:
    return f"{answer} || {_q(P.CITATION_HEAD + P.CITATION_LINK_LABEL + '(')} || {url} || ')'"


def _topk_sql(corpus_from: str, k: int, metric: str = "dot") -> str:
    score = "list_dot_product(q.qv, c.cv)" if metric == "dot" else "list_distance(q.qv, c.cv) ^ 2"
    order = f"{score} DESC" if metric == "dot" else "list_distance(q.qv, c.cv)"
    return f"""SELECT qid, rank, id, score FROM (
  SELECT q.qid, c.id, round({score}, 6) AS score,
         row_number() OVER (PARTITION BY q.qid ORDER BY {order}, c.id)::INTEGER AS rank
  FROM vq q JOIN ({corpus_from}) c ON c.id <> q.qid) WHERE rank <= {k}"""


_TOKENS = "CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '\\s+')) END"
_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)"
_TOK_CHOICES = ", ".join(str(t) for t in P.TOKEN_CHOICES)

ORACLE: dict[str, str] = {
    "scan_sitemaps": _with(("sitemap_docs",), "SELECT url, state FROM sitemap_docs WHERE status = 200"),
    "extract_locs": _with(("sitemap_docs",), """SELECT e.parent,
  (row_number() OVER (PARTITION BY e.parent ORDER BY e.pos, e.child) - 1)::INTEGER AS pos, e.child
FROM edges e JOIN sitemap_docs s ON e.parent = s.url WHERE s.state = 'ok'"""),
    "classify_links": _with(("links",), "SELECT parent, child, kind FROM links WHERE kind IS NOT NULL"),
    "crawl_sitemaps": _with(("walk",), "SELECT url, kind, min(depth)::INTEGER AS depth FROM walk GROUP BY url, kind"),
    "crawl_errors": _with(("walk",), """SELECT 'sitemap' AS stage, r.url AS key, coalesce(s.state, 'not_fetched') AS message
FROM (SELECT DISTINCT url FROM walk WHERE kind = 'sitemap') r LEFT JOIN sitemap_docs s ON r.url = s.url
WHERE s.state IS NULL OR s.state <> 'ok'"""),
    "scan_url_list": _with(("scanned",), "SELECT ord, url FROM scanned"),
    "scan_pages": "SELECT page_id, url, length(html)::INTEGER AS html_chars FROM pages",
    "url_origin": """SELECT page_id, url,
  CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) <> '' THEN
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://'
    || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) END AS origin FROM pages""",
    "in_scope_pages": """SELECT page_id, url FROM pages
WHERE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) <> ''
  AND starts_with(url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://'
                       || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))""",
    "html_to_text": f"SELECT page_id, {_text_of('html')} AS text FROM pages",
    "main_content_text": f"""SELECT page_id, {_text_of('region')} AS text FROM (
  SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<article\\b[^>]*>.*?</article\\s*>')
    THEN regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) ELSE html END AS region FROM pages)""",
    "url_to_path": f"SELECT page_id, url, {_path('url')} AS path FROM pages",
    "path_to_citation": f"SELECT page_id, path, {_citation('path')} AS citation FROM (SELECT page_id, {_path('url')} AS path FROM pages)",
    "citation_roundtrip_loss": f"""SELECT count(*) AS pages, sum(CASE WHEN c = url THEN 1 ELSE 0 END)::BIGINT AS exact,
  sum(CASE WHEN c <> url THEN 1 ELSE 0 END)::BIGINT AS lost FROM (SELECT url, {_citation(_path('url'))} AS c FROM pages)""",
    "doc_id_hash": _with(("kb_docs",), "SELECT path, substr(sha256(path), 1, 10) AS id FROM kb_docs"),
    "doc_id_fallback": f"""SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN {_q(KB_BASE + '/')} || source || '/' || doc_id::VARCHAR || '.txt' END,
  substr(text, 1, {P.FALLBACK_ID_CHARS})) AS id FROM documents""",
    "attach_metadata": _with(("kb_docs",), "SELECT path, path AS file_path, 'public' AS classification FROM kb_docs"),
    "resolve_fetch_attempts": _with(("fetch_log",), """SELECT url, attempt, status,
  CASE WHEN status = 200 THEN 'ok' ELSE 'error_response' END AS outcome FROM (
  SELECT url, attempt, status, row_number() OVER (PARTITION BY url
     ORDER BY CASE WHEN status = 200 THEN attempt ELSE 1048576 - attempt END) AS rn
  FROM fetch_log WHERE status IS NOT NULL) WHERE rn = 1
UNION ALL
SELECT url, NULL::INTEGER, NULL::INTEGER, 'no_response' FROM fetch_log GROUP BY url HAVING count(status) = 0"""),
    "split_by_status": _with(("fetch_log",), """SELECT page_id, attempt,
  CASE WHEN status IS NULL THEN 'exception' WHEN status = 200 THEN 'success' ELSE 'failure' END AS lane FROM fetch_log"""),
    "dedup_urls": _with(("scanned",), "SELECT min(ord) AS ord, url FROM scanned GROUP BY url"),
    "kb_last_write_wins": _with(("visits",), "SELECT path, max(ord) AS ord, arg_max(url, ord) AS url FROM visits GROUP BY path"),
    "path_collisions": _with(("visits",), "SELECT path, count(DISTINCT url) AS writers FROM visits GROUP BY path HAVING count(DISTINCT url) > 1"),
    "build_kb": _with(("visits",), f"""SELECT w.path, w.url, {_HOST.replace('url', 'w.url')} AS host, {_text_of('p.html')} AS text
FROM (SELECT path, arg_max(url, ord) AS url FROM visits WHERE url IN (SELECT url FROM pages) GROUP BY path) w
JOIN pages p ON p.url = w.url"""),
    "kb_unfetched": _with(("visits",), "SELECT ord, url, path FROM visits WHERE url NOT IN (SELECT url FROM pages)"),
    "scan_kb_docs": """SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, length(t)::INTEGER AS chars,
  sha256(t) AS text_sha256 FROM (SELECT *, CASE WHEN doc_id % 10 <> 0
    THEN regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') ELSE '' END AS t FROM documents)""",
    "append_urls": _with(("walk",), "SELECT url, 2::BIGINT AS lines FROM (SELECT DISTINCT url FROM walk WHERE kind = 'page')"),
    "append_errors": _with(("walk",), """SELECT 'sitemap' AS stage, r.url AS key, coalesce(s.state, 'not_fetched') AS message,
  2::BIGINT AS lines
FROM (SELECT DISTINCT url FROM walk WHERE kind = 'sitemap') r LEFT JOIN sitemap_docs s ON r.url = s.url
WHERE s.state IS NULL OR s.state <> 'ok'"""),
    "write_kb": _with(("visits",), f"""SELECT w.path, w.url, {_HOST.replace('url', 'w.url')} AS host, {_text_of('p.html')} AS text
FROM (SELECT path, arg_max(url, ord) AS url FROM visits WHERE url IN (SELECT url FROM pages) GROUP BY path) w
JOIN pages p ON p.url = w.url"""),
    "embed_with_model": """SELECT doc_id, length(t)::BIGINT AS chars, (length(t) - length(replace(t, ' ', '')))::BIGINT AS blanks,
  (length(t) - length(replace(t, 'e', '')))::BIGINT AS es, (length(t) - length(replace(t, chr(10), '')))::BIGINT AS lines
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "generate_with_model": _with(("requests",), """SELECT conv_id, turn,
  CASE WHEN contains(prompt, 'ing') THEN NULL ELSE replace(prompt, 'e', '3') END AS response,
  CASE WHEN contains(prompt, 'ing') THEN 'generator failed: refused' END AS error FROM requests"""),
    # vectors and collections
    "topk_cosine": _with(("vq", "dotc"), _topk_sql("SELECT id, cv FROM dotc", P.TOP_K_DOT)),
    "nearest_l2": _with(("vq", "dotc"), _topk_sql("SELECT id, cv FROM dotc", P.TOP_K_L2, "l2")),
    "best_match": _with(("vq", "dotc"), f"""SELECT q.qid, t.id, t.score FROM vq q LEFT JOIN (
{_topk_sql("SELECT id, cv FROM dotc", P.TOP_K_DOT)}) t ON t.qid = q.qid AND t.rank = 1"""),
    "fetch_context": _with(("vq", "dotc"), f"""SELECT b.qid, b.id, b.score, c.path, k.text AS context,
  CASE WHEN k.text IS NULL THEN 'document not found' END AS error
FROM ({_topk_sql("SELECT id, cv FROM dotc", P.TOP_K_DOT)}) b
LEFT JOIN dotc c ON c.id = b.id LEFT JOIN kb_docs k ON k.path = c.path WHERE b.rank = 1"""),
    "relevance_report": _with(("vq", "dotc"), f"""SELECT count(*) AS questions,
  sum(CASE WHEN score >= 0.3 THEN 1 ELSE 0 END)::BIGINT AS relevant, round(min(score), 6) AS min_score,
  round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score
FROM ({_topk_sql("SELECT id, cv FROM dotc", P.TOP_K_DOT)}) WHERE rank = 1"""),
    "topk_where_metadata": _with(("vq", "dotc"), _topk_sql("SELECT id, cv FROM dotc WHERE source = 'src1'", P.TOP_K_DOT)),
    "topk_where_contains": _with(("vq",), _topk_sql(
        "SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS cv FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id "
        "WHERE contains(d.text, 'tion')", P.TOP_K_DOT)),
    "l2_normalize": """SELECT vec_id, round(n, 6) AS norm_in,
  round(sqrt(list_sum(list_transform(v, lambda x: (x / greatest(n, 1e-12)) ^ 2))), 6) AS norm_out,
  round(v[1] / greatest(n, 1e-12), 6) AS u0
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
      FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings))""",
    "check_dimension": f"""SELECT len(embedding)::INTEGER AS dim, count(*) AS vectors,
  sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END)::BIGINT AS accepted_64,
  sum(CASE WHEN len(embedding) = {P.VECTOR_DIM} THEN 1 ELSE 0 END)::BIGINT AS accepted_768
FROM embeddings GROUP BY len(embedding)""",
    "mean_pool": """SELECT label, sum(m)::BIGINT AS mask_sum,
  round(sum(e1 * m) / greatest(sum(m), 1e-9), 6) AS p0, round(sum(es * m) / greatest(sum(m), 1e-9), 6) AS psum
FROM (SELECT e.label, coalesce(l.quality, 0)::DOUBLE AS m, e.embedding[1]::DOUBLE AS e1,
             list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)) AS es
      FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id) GROUP BY label""",
    "upsert_replace": """SELECT id, label, version FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, src DESC) AS rn FROM (
    SELECT vec_id::VARCHAR AS id, label, 1 AS version, 0 AS src FROM embeddings
    UNION ALL SELECT (vec_id * 2)::VARCHAR, label + 100, 2, 1 FROM embeddings)) WHERE rn = 1""",
    "upsert_ignore": """SELECT vec_id::VARCHAR AS id, label, 1 AS version FROM embeddings
UNION ALL SELECT (vec_id * 2)::VARCHAR, label + 100, 2 FROM embeddings WHERE vec_id * 2 NOT IN (SELECT vec_id FROM embeddings)""",
    "token_windows": f"""SELECT doc_id, w::INTEGER AS window, (w * {P.MAX_EMBED_TOKENS * 3 // 4})::INTEGER AS first,
  least(w * {P.MAX_EMBED_TOKENS * 3 // 4} + {P.MAX_EMBED_TOKENS}, len(t))::INTEGER AS last,
  length(array_to_string(t[w * {P.MAX_EMBED_TOKENS * 3 // 4} + 1:w * {P.MAX_EMBED_TOKENS * 3 // 4} + {P.MAX_EMBED_TOKENS}], ' '))::INTEGER AS chars
FROM (SELECT doc_id, t, unnest(range(greatest(ceil((len(t) - {P.MAX_EMBED_TOKENS}) / {P.MAX_EMBED_TOKENS * 3 // 4}.0), 0)::BIGINT + 1)) AS w
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\t\\n\\v\\f\\r ]+') AS t FROM documents))""",
    "embed_documents": f"""SELECT doc_id, {P.VECTOR_DIM}::INTEGER AS dim,
  CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""",
    "embed_learned": """SELECT doc_id, 64::INTEGER AS dim,
  CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""",
    "topk_ivf_recall": _with(("vq", "dotc"), f"""SELECT count(*) AS total, true AS found FROM (
{_topk_sql("SELECT id, cv FROM dotc", P.TOP_K_DOT)}) t"""),
    "collection_on_disk": """SELECT 'replace' AS policy, id, label, version FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, src DESC) AS rn FROM (
    SELECT vec_id::VARCHAR AS id, label, 1 AS version, 0 AS src FROM embeddings
    UNION ALL SELECT (vec_id * 2)::VARCHAR, label + 100, 2, 1 FROM embeddings)) WHERE rn = 1
UNION ALL SELECT 'ignore', vec_id::VARCHAR, label, 1 FROM embeddings
UNION ALL SELECT 'ignore', (vec_id * 2)::VARCHAR, label + 100, 2 FROM embeddings WHERE vec_id * 2 NOT IN (SELECT vec_id FROM embeddings)""",
    "collection_count": """SELECT count(DISTINCT id) AS records FROM (
  SELECT vec_id AS id FROM embeddings UNION ALL SELECT vec_id * 2 FROM embeddings)""",
    "describe_collection": _with(("kb_docs",), """SELECT count(*) AS records, count(DISTINCT substr(sha256(k.path), 1, 10)) AS distinct_ids,
  min(len(e.embedding))::INTEGER AS min_dim, max(len(e.embedding))::INTEGER AS max_dim
FROM embeddings e JOIN kb_docs k ON k.doc_id = e.vec_id"""),
    "truncate_tokens": f"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE
  length(array_to_string(list_slice(regexp_split_to_array(t, '\\s+'), 1, {P.MAX_EMBED_TOKENS}), ' ')) END::INTEGER AS embed_chars
FROM (SELECT doc_id, {_TRIM} AS t FROM documents)""",
    "truncation_loss": f"""SELECT count(*) AS docs, sum(CASE WHEN n > {P.MAX_EMBED_TOKENS} THEN 1 ELSE 0 END)::BIGINT AS truncated_docs,
  sum(n)::BIGINT AS tokens, sum(least(n, {P.MAX_EMBED_TOKENS}))::BIGINT AS tokens_embedded
FROM (SELECT {_TOKENS} AS n FROM (SELECT {_TRIM} AS t FROM documents))""",
    # retrieval, prompts, answers, requests
    "retrieve_p": _with(("p_best",), """SELECT q.qid, b.id, b.score, b.path, k.text AS context,
  CASE WHEN b.id IS NULL THEN 'no match' WHEN k.text IS NULL THEN 'document not found' END AS error
FROM cq q LEFT JOIN p_best b ON b.qid = q.qid LEFT JOIN kb_docs k ON k.path = b.path"""),
    "retrieve_c": _with(("c_best",), "SELECT q.qid, b.id, b.score, b.document FROM cq q LEFT JOIN c_best b ON b.qid = q.qid"),
    "prompt_plain": f"SELECT conv_id, turn, {_prompt_plain('text')} AS prompt FROM conversations WHERE role = 'user'",
    "prompt_with_context": f"""SELECT c.conv_id, c.turn, {_prompt_ctx('c.text', 'd.text')} AS prompt
FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'user'""",
    "prompt_dispatch": _with(("p_best", "c_best"), f"""SELECT qid, mode, source, {_prompt_for('text', 'context')} AS prompt FROM (
  SELECT qid, mode, text, '' AS context, NULL::VARCHAR AS source FROM cq WHERE mode = 'none'
  UNION ALL SELECT q.qid, q.mode, q.text, k.text, b.path FROM cq q LEFT JOIN p_best b ON b.qid = q.qid
    LEFT JOIN kb_docs k ON k.path = b.path WHERE q.mode = 'dot'
  UNION ALL SELECT q.qid, q.mode, q.text, b.document, b.id FROM cq q LEFT JOIN c_best b ON b.qid = q.qid
    WHERE q.mode = 'l2'
  UNION ALL SELECT qid, mode, text, NULL, NULL FROM cq WHERE mode NOT IN ('none', 'dot', 'l2'))"""),
    "answer_questions": _with(("p_best", "c_best"), f"""SELECT qid, conv_id, turn, mode,
  CASE WHEN error IS NULL THEN CASE WHEN source IS NULL THEN stripped
       ELSE {_with_citation('stripped', _citation('source', KB_BASE))} END END AS answer, error
FROM (SELECT *, substr(output, greatest(length(prompt) - {P.ECHO_OFFSET}, 0) + 1) AS stripped FROM (
  SELECT *, substr(prompt, 3) || ' answer ' || conv_id::VARCHAR AS output FROM (
    SELECT *, {_prompt_for('text', 'context')} AS prompt FROM (
      SELECT qid, conv_id, turn, mode, text, '' AS context, NULL::VARCHAR AS source, NULL::VARCHAR AS error
      FROM cq WHERE mode = 'none'
      UNION ALL SELECT q.qid, q.conv_id, q.turn, q.mode, q.text, k.text, b.path,
        CASE WHEN b.id IS NULL THEN 'no match' WHEN k.text IS NULL THEN 'document not found' END
      FROM cq q LEFT JOIN p_best b ON b.qid = q.qid LEFT JOIN kb_docs k ON k.path = b.path WHERE q.mode = 'dot'
      UNION ALL SELECT q.qid, q.conv_id, q.turn, q.mode, q.text, b.document, b.id,
        CASE WHEN b.id IS NULL THEN 'no match' END
      FROM cq q LEFT JOIN c_best b ON b.qid = q.qid WHERE q.mode = 'l2'
      UNION ALL SELECT qid, conv_id, turn, mode, text, NULL, NULL, 'unknown mode'
      FROM cq WHERE mode NOT IN ('none', 'dot', 'l2')))))"""),
    "strip_prompt_echo": _with(("responses",), f"""SELECT conv_id, turn,
  substr(response, greatest(length(prompt) - {P.ECHO_OFFSET}, 0) + 1) AS answer FROM responses"""),
    "answer_with_citation": _with(("responses", "kb_docs"), f"""SELECT r.conv_id, r.turn,
  {_with_citation(f'substr(r.response, greatest(length(r.prompt) - {P.ECHO_OFFSET}, 0) + 1)', _citation('k.path', KB_BASE))} AS answer
FROM responses r JOIN kb_docs k ON k.doc_id = r.conv_id"""),
    "normalize_requests": _with(("requests",), f"""SELECT conv_id, turn, prompt,
  coalesce(t_raw, {P.DEFAULT_TEMPERATURE})::DOUBLE AS temperature,
  coalesce(n_raw, {P.DEFAULT_MAX_NEW_TOKENS})::INTEGER AS max_new_tokens, {P.DEFAULT_TOP_P}::DOUBLE AS top_p,
  {P.DEFAULT_TOP_K}::INTEGER AS top_k, {P.DEFAULT_REPETITION_PENALTY}::DOUBLE AS repetition_penalty,
  {P.DEFAULT_NUM_BEAMS}::INTEGER AS num_beams, NULL::VARCHAR AS error FROM requests"""),
    "validate_requests": _with(("requests",), f"""SELECT conv_id, turn, temperature, max_new_tokens,
  coalesce(temperature BETWEEN {P.TEMPERATURE_MIN} AND {P.TEMPERATURE_MAX} AND max_new_tokens IN ({_TOK_CHOICES}), false) AS valid
FROM (SELECT conv_id, turn, coalesce(t_raw, {P.TEMPERATURE_UI_DEFAULT})::DOUBLE AS temperature,
             coalesce(n_raw, {P.TOKEN_UI_DEFAULT})::INTEGER AS max_new_tokens FROM requests)"""),
    "build_request_json": _with(("requests",), f"""SELECT conv_id, turn, true AS prompt_ok,
  coalesce(t_raw, {P.DEFAULT_TEMPERATURE})::DOUBLE AS temperature,
  coalesce(n_raw, {P.DEFAULT_MAX_NEW_TOKENS})::INTEGER AS max_new_tokens, 1.5::DOUBLE AS repetition_penalty,
  'request' AS top_key FROM requests"""),
    "parse_response_json": _with(("responses",), "SELECT conv_id, turn, response FROM responses"),
    "response_times": """SELECT event_id, value AS response_time_s, round(value::DECIMAL(38, 10), 1)::DOUBLE AS shown_s FROM events""",
    "score_requests": _with(("requests",), f"""SELECT conv_id, turn,
  coalesce(t_raw, {P.DEFAULT_TEMPERATURE})::DOUBLE AS temperature,
  coalesce(n_raw, {P.DEFAULT_MAX_NEW_TOKENS})::INTEGER AS max_new_tokens, {P.DEFAULT_TOP_P}::DOUBLE AS top_p,
  {P.DEFAULT_TOP_K}::INTEGER AS top_k, {P.DEFAULT_REPETITION_PENALTY}::DOUBLE AS repetition_penalty,
  {P.DEFAULT_NUM_BEAMS}::INTEGER AS num_beams, substr(prompt, 3) || ' answer ' || conv_id::VARCHAR AS response,
  round((length(prompt) / 128.0)::DECIMAL(38, 10), 1)::DOUBLE AS response_time_s, NULL::VARCHAR AS error FROM requests"""),
    "log_requests": _with(("requests",), """SELECT prompt, substr(prompt, 3) || ' answer ' || conv_id::VARCHAR AS response,
  (length(prompt) / 128.0)::DOUBLE AS response_time_s FROM requests"""),
    "request_metrics_daily": _with(("request_log",), """SELECT day, kind, count(*) AS requests, round(avg(v), 6) AS avg_s,
  max(v) AS max_s, min(v) FILTER (WHERE rn >= ceil(0.5 * n)) AS p50_s, min(v) FILTER (WHERE rn >= ceil(0.95 * n)) AS p95_s
FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, kind, response_time_s AS v,
             row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), kind ORDER BY response_time_s) AS rn,
             count(*) OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), kind) AS n FROM request_log)
GROUP BY day, kind"""),
    # embedding, populate and streaming (embedding values are not compared; shape and ids are)
    "populate_index": _with(("kb_docs",), f"SELECT substr(sha256(path), 1, 10) AS id, path, {P.VECTOR_DIM}::INTEGER AS dim FROM kb_docs"),
    "stream_populate": _with(("kb_docs",), f"SELECT substr(sha256(path), 1, 10) AS id, path, {P.VECTOR_DIM}::INTEGER AS dim FROM kb_docs"),
    "stream_request_metrics": _with(("request_log",), """SELECT day, kind, count(*) AS requests, round(avg(v), 6) AS avg_s,
  max(v) AS max_s, min(v) FILTER (WHERE rn >= ceil(0.5 * n)) AS p50_s, min(v) FILTER (WHERE rn >= ceil(0.95 * n)) AS p95_s
FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, kind, response_time_s AS v,
             row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), kind ORDER BY response_time_s) AS rn,
             count(*) OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), kind) AS n FROM request_log
      WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM request_log) - INTERVAL 1 HOUR)
GROUP BY day, kind"""),
    "stream_ingest_pages": f"""SELECT {_path('url')} AS path, url, {_HOST} AS host, {_text_of('html')} AS text FROM (
  SELECT arg_max(url, page_id) AS url, arg_max(html, page_id) AS html FROM pages GROUP BY {_path('url')})""",
}
