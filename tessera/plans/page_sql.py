"""SQL of pages and markdown (F15-F19, F21, F24, F26, W16), written apart from the operators: pages as tokens of one pattern, no tree.

It holds for pages whose dropped elements aren't nested and whose entities are
those below: any other entity, or a class that is dropped, is an error.
"""

from __future__ import annotations

from tessera.plans.chunk_sql import STRIPPED, strip

_ENTITIES = {"&quot;?": '"', "&middot;?": "·", "&copy;?": "©", "&lt;?": "<", "&gt;?": ">", "&amp;?": "&"}  # the ampersand last
_WHOLE = ("script", "style")
_DROPPED = ("script", "style", "nav", "footer", "header", "menu", "sidebar", "svg")


def _plain(text: str) -> str:
    for entity, is_ in _ENTITIES.items():
        text = f"regexp_replace({text}, '{entity}', '{is_}', 'g')"
    return text


def _tokens(html: str, whole: tuple[str, ...]) -> str:
    elements = "|".join(rf"<{e}\b[^>]*>.*?(?:</{e}>|$)" for e in whole)
    return rf"regexp_extract_all({html}, '(?is){elements}|<!--.*?-->|<[^>]*>|[^<]+')"


def _texts(html: str, whole: tuple[str, ...], kept: str) -> str:
    return f"list_filter(list_transform({_tokens(html, whole)}, lambda t: CASE WHEN t[1] <> '<' THEN {strip(_plain('t'), STRIPPED)} ELSE {kept} END), lambda t: t <> '')"


_STRANGE = r"""CASE WHEN regexp_matches(html, '(?i)class="[^"]*\b(nav|menu|sidebar|footer)\b') OR len(regexp_extract_all(html, '&[a-zA-Z#0-9]+;')) > len(regexp_extract_all(html, '&(quot|middot|copy|lt|gt|amp);')) THEN error('a page that this SQL is not for') ELSE html END"""

SCRAPED = rf"""WITH p AS (SELECT page_id, {_STRANGE} AS html FROM pages),
t AS (SELECT page_id, html, regexp_replace(array_to_string({_texts("html", _DROPPED, "''")}, chr(10)), '{STRIPPED}{{2,}}', ' ', 'g') AS text FROM p)
SELECT page_id, {_plain(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, md5(text) AS text_md5, len(regexp_extract_all(html, '(?i)<a\s[^>]*href='))::INTEGER AS n_links, 0::INTEGER AS n_images FROM t WHERE length(text) >= 100 AND NOT contains(html, '<img')"""

_INNER = r"CASE WHEN regexp_matches(t, '(?i)^<(script|style)\b') THEN regexp_extract(t, '(?is)^<[^>]*>(.*?)(?:</(?:script|style)>|$)', 1) ELSE '' END"


def stripped(most: int) -> str:
    """F21."""
    return f"WITH p AS (SELECT page_id, {_STRANGE} AS html FROM pages) SELECT page_id, left(array_to_string({_texts(f'left(html, {2 * most})', _WHOLE, _INNER)}, ' '), {most}) AS text FROM p"


#: F18, F19, W16 of pages whose links, bold parts, headings and breaks are images.
IMAGES = r"""WITH p AS (SELECT page_id, length(html) AS n, regexp_extract(url, '^https?://[^/]+') AS host, regexp_extract_all(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<(?:a href="[^"]*"|b|h1|br)>') AS tags FROM pages),
i AS (SELECT page_id, n, host, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM p),
s AS (SELECT *, CASE WHEN tag = '<b>' THEN 4 WHEN tag = '<br>' THEN 0 WHEN tag = '<h1>' THEN NULL
  WHEN n // 4 >= 2000 AND n // 8 >= 1000 THEN 3 WHEN n // 4 >= 1600 OR n // 8 >= 800 THEN 2 WHEN n // 4 >= 800 OR n // 8 >= 500 THEN 1 WHEN n // 4 >= 500 OR n // 8 >= 300 THEN 0 END AS score FROM i)
SELECT page_id, (row_number() OVER w - 1)::INTEGER AS pos, score, host || CASE WHEN tag = '<b>' THEN '/bold.png' WHEN tag = '<br>' THEN '/break.png' ELSE regexp_extract(tag, '"([^"]*)"', 1) END AS url
FROM s WHERE score IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, s.pos) QUALIFY row_number() OVER w <= 10"""

_HEADERS = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
marked AS (SELECT doc_id, pos, CASE WHEN length(line) % 7 > 0 THEN repeat('#', length(line) % 7) || ' ' || line ELSE line END AS line FROM l),
h AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*$', 1)) AS level, regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*$', 2) AS text FROM marked WHERE regexp_matches(line, '^(#{1,6})\s+(.+?)\s*#*$')),
up AS (SELECT h.doc_id, h.pos, any_value(h.level) AS level, any_value(h.text) AS text, max(b.pos) AS parent_pos FROM h LEFT JOIN h b ON b.doc_id = h.doc_id AND b.pos < h.pos AND b.level < h.level GROUP BY ALL),
tree AS (SELECT *, 0 AS depth FROM up WHERE parent_pos IS NULL UNION ALL SELECT up.*, depth + 1 FROM up JOIN tree ON up.doc_id = tree.doc_id AND up.parent_pos = tree.pos)"""
HEADERS = f"{_HEADERS} SELECT doc_id, pos::INTEGER AS pos, level::INTEGER AS level, text, parent_pos::INTEGER AS parent_pos, depth::INTEGER AS depth FROM tree"
CONTENTS = f"{_HEADERS}, toc AS (SELECT doc_id, string_agg(repeat(' ', 4 * depth) || '- ' || text || chr(10), '' ORDER BY pos) AS t FROM tree GROUP BY 1) SELECT doc_id, '## Table of Contents' || chr(10) || chr(10) || coalesce(t, '') AS toc FROM documents LEFT JOIN toc USING (doc_id)"
