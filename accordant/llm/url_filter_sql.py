"""The SQL that op12_url_filter must agree with."""

from __future__ import annotations

from collections.abc import Sequence

URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def host(url: str) -> str:
    return LOWER.format(f"coalesce(regexp_extract({url}, '{URL}', 2), '')")


def path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '{URL}', 3), '')"


def address(url: str) -> str:
    query = rf"regexp_replace(regexp_replace(regexp_extract({url}, '{URL}', 4), '[?&](?:utm_[a-z]+|gclid|fbclid)=[^&]*', '', 'g'), '^&', '?')"
    return f"""CASE WHEN {host(url)} <> '' THEN regexp_replace({host(url)}, ':(?:80|443)$', '') || regexp_replace({path(url)}, '/+$', '') || {query} END"""


def attribute(tag: str, name: str) -> str:
    found = rf"""regexp_extract({tag}, '(?i)\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    return rf"""replace(replace(trim(regexp_replace({found}, '^["'']|["'']$', '', 'g')), '&amp;', '&'), '&#38;', '&')"""


def text(rules: Sequence[str]) -> str:
    values = ", ".join(
        f"('{verdict}', '{where.partition('/')[0]}', '/{where.partition('/')[2]}')" for verdict, where in (r.split(" ") for r in rules)
    )
    canonical = f"regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(lower({attribute('tag', 'rel')}), '\\s+'), 'canonical')"
    refresh = f"regexp_matches(tag, '(?i)^<meta') AND lower({attribute('tag', 'http-equiv')}) = 'refresh'"
    target = rf"""trim(regexp_extract({attribute('tag', 'content')}, '(?i)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1))"""
    root = f"regexp_extract(base, '{URL}', 1) || '://' || regexp_extract(base, '{URL}', 2)"
    return rf"""WITH RECURSIVE rules(verdict, host, path) AS (VALUES {values}),
      p AS (SELECT row_number() OVER () AS k, page_id, url, {host('url')} AS host, {path('url')} AS path, {address('url')} AS node FROM pages),
      own AS (SELECT p.k, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
        FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.k),
      tags AS (SELECT url AS base, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', ' ', 'g'), '(?i)<(?:link|meta)\s[^>]*>')) AS tag
        FROM pages WHERE regexp_matches(html, '(?i)\bcanonical\b|http-equiv')),
      links AS (SELECT base, CASE WHEN {canonical} THEN {attribute('tag', 'href')} WHEN {refresh} THEN {target} END AS link FROM tags),
      stated AS (SELECT base, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(base, '{URL}', 1) || ':' || link
          WHEN starts_with(link, '/') THEN {root} || link WHEN starts_with(link, '#') THEN base WHEN starts_with(link, '?') THEN {root} || {path('base')} || link
          ELSE {root} || regexp_replace({path('base')}, '[^/]*$', '') || CASE WHEN {path('base')} = '' THEN '/' ELSE '' END || link END AS target
        FROM links WHERE link <> ''),
      ends AS (SELECT DISTINCT a, b FROM (SELECT {address('base')} AS a, {address('target')} AS b FROM stated) WHERE a <> b),
      both_ways AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
      reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
      classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
      rooted AS (SELECT p.k, coalesce(c.root, p.node) AS root FROM p LEFT JOIN classes c ON c.node = p.node),
      blocked AS (SELECT root FROM rooted JOIN own ON own.k = rooted.k WHERE root IS NOT NULL GROUP BY root HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow'))
      SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.verdict, CASE WHEN b.root IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, rooted.root
      FROM p JOIN rooted ON rooted.k = p.k LEFT JOIN own ON own.k = p.k LEFT JOIN blocked b ON b.root = rooted.root"""
