"""DuckDB's SQL of the queries that SQL can express."""

from __future__ import annotations

from tideloom.llm.repeats import WIDTH
from tideloom.llm.urls import RULES, TRACKING

#: Windows as joined words; every word covered by one that starts in a smaller doc_id goes.
OP5 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT r, doc_id, w, unnest(range(0, len(w) - {WIDTH - 1})) AS i FROM d WHERE len(w) >= {WIDTH} AND doc_id IS NOT NULL),
 k AS (SELECT r, doc_id, i, array_to_string(w[i + 1 : i + {WIDTH}], ' ') AS k FROM s),
 f AS (SELECT k, min(doc_id) AS f FROM k GROUP BY k HAVING min(doc_id) < max(doc_id)),
 h AS (SELECT r, i FROM k JOIN f USING (k) WHERE f < doc_id),
 g AS (SELECT DISTINCT r, i + o AS i FROM h, range({WIDTH}) AS o(o)),
 v AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
 t AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM v ANTI JOIN g USING (r, i) GROUP BY r),
 n AS (SELECT r, count(*) AS n FROM g GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"


def _rule(host: str, path: str) -> str:
    cases = " ".join(f"WHEN ({host} = '{x.host}' OR ends_with({host}, '.{x.host}')) AND starts_with({path}, '{x.path}') THEN '{x.name}'" for x in sorted(RULES, key=lambda x: (-len(x.name), x.name)))
    return f"CASE {cases} END"


def _node(url: str) -> str:
    query = rf"list_filter(string_split(coalesce(regexp_extract({url}, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^{TRACKING}(?:=|$)'))"
    return f"(regexp_replace({_host(url)}, ':(?:80|443)$', '') || regexp_replace({_path(url)}, '/+$', '') || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END)"


def _value(tag: str, name: str) -> str:
    found = rf"""regexp_extract({tag}, '(?is)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 0)"""
    return rf"""trim(regexp_replace(regexp_replace({found}, '(?is)^\w+\s*=\s*', ''), '^["'']|["'']$', '', 'g'), ' ')"""


def _tag(name: str, condition: str) -> str:
    return rf"""coalesce(list_filter(regexp_extract_all(html, '(?is)<{name}\b[^>]*>'), lambda t: regexp_matches(t, '(?is){condition}'))[1], '')"""


_REFRESH = rf"""regexp_extract({_value('meta', 'content')}, '(?is)\burl\s*=\s*["'']?([^"'']+)', 1)"""
_ABSOLUTE = rf"""CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN 'http://' || {_host('url')} || target WHEN starts_with(target, '#') THEN url
 ELSE 'http://' || {_host('url')} || coalesce(nullif(regexp_extract({_path('url')}, '^(?s:.*)/', 0), ''), '/') || target END"""
_VERDICT = "CASE " + " ".join(f"WHEN rule = '{x.name}' THEN '{x.verdict}'" for x in RULES) + " END"

#: Components of the alias graph by reachability, then rules carried to every alias.
OP4 = rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, url, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS node, {_rule(_host('url'), _path('url'))} AS rule, html FROM pages),
 tg AS (SELECT url, node, {_tag('link', r'''\brel\s*=\s*["'']?\s*canonical\b''')} AS link, {_tag('meta', r'''\bhttp-equiv\s*=\s*["'']?\s*refresh\b''')} AS meta FROM p WHERE host <> ''),
 ta AS (SELECT url, node, trim(replace(unnest([{_value('link', 'href')}, {_REFRESH}]), '&amp;', '&'), ' ') AS target FROM tg),
 ab AS (SELECT node, {_ABSOLUTE} AS goal FROM ta WHERE target <> ''),
 ln AS MATERIALIZED (SELECT node, goal, {_node('goal')} AS goal_node FROM ab WHERE node <> '' AND {_node('goal')} <> ''),
 ed AS MATERIALIZED (SELECT DISTINCT node AS u, goal_node AS v FROM ln WHERE node <> goal_node UNION SELECT DISTINCT goal_node, node FROM ln WHERE node <> goal_node),
 re(node, met) AS (SELECT DISTINCT u, u FROM ed UNION SELECT re.node, ed.v FROM re JOIN ed ON ed.u = re.met),
 ro AS MATERIALIZED (SELECT node, min(met) AS root FROM re GROUP BY node),
 na AS (SELECT node, rule FROM p UNION ALL SELECT goal_node, {_rule(_host('goal'), _path('goal'))} FROM ln),
 ru AS (SELECT coalesce(root, na.node) AS alias, max({_VERDICT} = 'allow') AS allowed, max({_VERDICT} = 'block') AS blocked FROM na LEFT JOIN ro ON ro.node = na.node WHERE rule IS NOT NULL AND na.node <> '' GROUP BY 1)
 SELECT page_id, host, path, rule, coalesce({_VERDICT}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN host <> '' THEN coalesce(root, p.node) END AS alias
 FROM p LEFT JOIN ro ON ro.node = p.node LEFT JOIN ru ON ru.alias = coalesce(root, p.node)"""

#: The base columns of op1.
BASE_COUNTS = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 v AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d), k AS (SELECT r, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM v WINDOW o AS (PARTITION BY r ORDER BY i)),
 g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM k WHERE z IS NOT NULL), c AS (SELECT r, count(DISTINCT i + o) AS n FROM g, range(3) AS o(o) WHERE n > 1 GROUP BY r),
 e AS (SELECT r, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM d JOIN e USING (r) LEFT JOIN c USING (r)"""

#: The base columns of op9.
PHRASE_PLACES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 h AS (SELECT r, unnest(range(0, len(w))) AS i, w FROM d WHERE len(w) > 0),
 p AS (SELECT r, i, 'cc-by' AS label FROM h WHERE w[i + 1] = 'cc' AND w[i + 2] = 'by' UNION ALL SELECT r, i, 'gpl' FROM h WHERE w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' UNION ALL SELECT r, i, 'reserved' FROM h WHERE w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved'),
 g AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM p GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN g USING (r)"""
