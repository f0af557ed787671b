"""DuckDB SQL of the subpackage's queries, where SQL can express them."""

from __future__ import annotations

from kbspark.llm.line_quality import BOILERPLATE, LineRules
from kbspark.llm.partenum import JoinParams
from kbspark.llm.queries import URL_RULES
from kbspark.llm.url_filter import LINK, URL, LinkParams

_WORD = r"[^\x20\x09-\x0D]+"


def _line_quality(r: LineRules = LineRules()) -> str:
    phrases = "|".join(BOILERPLATE)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_WORD}')) AS word,
             generate_subscripts(regexp_extract_all(t, '{_WORD}'), 1) AS i FROM d),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM g WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line,
             generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
m AS (SELECT doc_id, line, k, regexp_extract_all(line, '{_WORD}') AS ws FROM l WHERE regexp_matches(line, '{_WORD}')),
j AS (SELECT doc_id, len(ws) AS n,
             len(list_filter(ws, lambda x: regexp_matches(x, '[!?#*$%&@~^+=_][!?#*$%&@~^+=_]$')
                 OR regexp_matches(x, '[!?#*$%&@~^+=_][!?#*$%&@~^+=_][^!?#*$%&@~^+=_]$')
                    AND ord(right(x, 1)) < 128)) AS marks,
             len(list_filter(ws, lambda x: x IN ('|', '>', '<', '/', '-', ':', '»', '«', '·', '•'))) AS seps,
             regexp_matches(line, '(?i)({phrases})') AS boiler,
             row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM m),
f AS (SELECT *, (n >= 2 AND 100 * marks >= {r.mark_percent} * n)
             OR (seps >= {r.min_separators} AND 100 * seps >= {r.separator_percent} * n)
             OR (boiler AND n <= {r.boilerplate_words}) AS failed FROM j),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines,
             coalesce(sum(n) FILTER (failed), 0) AS removed_words,
             count(*) FILTER (nth > 1) AS n_dup_lines, sum(n) AS n_words FROM f GROUP BY doc_id),
c AS (SELECT doc_id, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(c.word_chars, 0)::BIGINT AS word_chars,
             len(regexp_extract_all(d.t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(s.n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(covered.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_failed_lines, 0)::BIGINT AS n_failed_lines,
             coalesce(s.removed_words, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat} * n_words AS base_failed,
       NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat} * n_words)
       AND 100 * removed_words <= {r.max_removed} * n_words AS kept
FROM a"""


def _partenum(p: JoinParams = JoinParams()) -> str:
    n = p.shingle
    run = " || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER o" for k in range(1, n)])
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, {run} AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
         UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {n - 1})
       WHERE s IS NOT NULL),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
           GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y
         WHERE {p.den} * c >= {p.num} * (p.n + q.n - c)),
near AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x),
low AS (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(sized.n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce(low.least, d.doc_id)) AS component_id
FROM d LEFT JOIN sized USING (doc_id) LEFT JOIN low USING (doc_id)"""


_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS t,
             regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       sum(length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def _url_filter(rules: list[tuple[str, str, str]], p: LinkParams = LinkParams()) -> str:
    cases = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1:]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{x}')" for _, h, x in cases]
    rule = " ".join(f"WHEN {f} THEN '{h}{x}'" for f, (_, h, x) in zip(fits, cases))
    action = " ".join(f"WHEN {f} THEN '{a}'" for f, (a, _, _) in zip(fits, cases))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    host = low(f"coalesce(regexp_extract(url, '{URL}', 1), '')")
    link = low("unnest(regexp_extract_all(html, '{}', 1))".format(LINK.replace("'", "''")))
    rounds = "".join(f"""
r{i + 1} AS (SELECT kind, host, sum(rank) AS rank FROM (
      SELECT kind, host, rank * {1 - p.damping} AS rank FROM r0
      UNION ALL SELECT w.kind, w.dst, r.rank * w.share * {p.damping} FROM r{i} r JOIN w ON w.kind = r.kind AND w.host = r.host)
    GROUP BY kind, host),""" for i in range(p.rounds))
    return rf"""
WITH a AS (SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
b AS (SELECT *, CASE {rule} END AS rule, CASE {action} END AS action FROM a),
s AS (SELECT host, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'block') AS blocked
      FROM b WHERE host <> '' GROUP BY host),
r0 AS (SELECT * FROM (
         SELECT 0 AS kind, host, allowed / nullif((SELECT sum(allowed) FROM s), 0) AS rank FROM s
         UNION ALL SELECT 1, host, blocked / nullif((SELECT sum(blocked) FROM s), 0) FROM s) WHERE rank > 0),
l AS (SELECT host AS src, {link} AS dst FROM a),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND src <> dst GROUP BY src, dst),
k AS (SELECT 0 AS kind, src AS host, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
w AS (SELECT kind, host, dst, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM k),{rounds}
v AS (SELECT host, coalesce(sum(rank) FILTER (kind = 0), 0) AS trust, coalesce(sum(rank) FILTER (kind = 1), 0) AS distrust
      FROM r{p.rounds} GROUP BY host)
SELECT page_id, b.host, path, rule, coalesce(action,
         CASE WHEN round(distrust / nullif(trust + distrust, 0), 9) >= {p.threshold} THEN 'block' END, 'allow') AS verdict
FROM b LEFT JOIN v ON v.host = b.host"""


ORACLE = {
    "op2_line_quality": _line_quality(),
    "op3_chat_format": _CHAT,
    "op4_partenum_join": _partenum(),
    "op6_url_filter": _url_filter(URL_RULES),
}
