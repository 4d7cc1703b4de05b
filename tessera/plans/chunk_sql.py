"""SQL of the chunkers (F1, F2, F5-F7, F9-F14), composed from named steps, for the checks beside the registered queries.

Written apart from the operators: atoms become running sums of lengths, and a
recursive query goes from each piece's first atom to the next one's.
"""

from __future__ import annotations

from tessera.functions.text import ABBREVIATIONS

#: White space as the operators know it (of any kind, as Python strips it, and of ASCII), and a private character that marks cuts.
ANY, STRIPPED, ASCII, MARK = r"[\x09-\x0D\x{85}\p{Z}]", r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]", r"[\x09-\x0D\x20]", "chr(57344)"


def strip(text: str, white: str = ANY) -> str:
    return f"regexp_replace({text}, '^{white}+|{white}+$', '', 'g')"


def nonempty(parts: str) -> str:
    return f"list_filter({parts}, lambda x: x <> '')"


def sentences(text: str) -> str:
    """cuts are marked after each end of a sentence, and taken away again after initials, abbreviations and ellipses."""
    marked = rf"regexp_replace({text}, '([.!?])({ANY}+)([A-Z\x22\x27\x{{80}}-\x{{ff}}])', '\1' || {MARK} || '\2\3', 'g')"
    word = r"(?:^|[^\p{L}\p{N}_])"
    for end in (rf"{word}[A-Z]\.", rf"{word}(?i:{ABBREVIATIONS})\.", rf"{word}e\.g\.", rf"{word}i\.e\.", r"\.\."):
        marked = rf"regexp_replace({marked}, '({end})' || {MARK}, '\1', 'g')"
    return nonempty(f"list_transform(string_split({marked}, {MARK}), lambda x: {strip('x')})")


def _after(text: str, separator: str) -> str:
    """The parts between the places that follow a separator; in a longer row of line feeds each further one is a part."""
    marked = f"replace({text}, '{separator}', '{separator}' || {MARK})"
    if len(separator) > 1:
        marked = f"replace({marked}, {MARK} || '{separator[-1]}', {MARK} || '{separator[-1]}' || {MARK})"
    return nonempty(f"string_split({marked}, {MARK})")


def _atoms(text: str, size: str) -> str:
    """Cut at blank lines, what is too long at line feeds, then at blanks, then by length."""
    by_length = f"list_transform(range(0, ((length(t) - 1) // {size}) + 1), lambda i: substr(t, i * {size} + 1, {size}))"
    out = f"[{text}]"
    for cut in [_after("t", s) for s in ("\n\n", "\n", " ")] + [by_length]:
        out = f"flatten(list_transform({out}, lambda t: CASE WHEN length(t) <= {size} THEN [t] ELSE {cut} END))"
    return out


def pieces(source: str) -> str:
    """CTEs that end in pieces(doc_id, part, n, content) of ``source`` (doc_id, part, text, longest, size, overlap); texts up to ``longest`` stay as they are."""
    return f"""long AS (SELECT * FROM {source} WHERE length(text) > longest),
atoms AS (SELECT doc_id, part, unnest(a) AS atom, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, part, {_atoms("text", "size")} AS a FROM long)),
sums AS (SELECT doc_id, part, i, sum(length(atom)) OVER (PARTITION BY doc_id, part ORDER BY i)::BIGINT AS e FROM atoms),
ends AS (SELECT doc_id, part, list(e ORDER BY i) AS ends FROM sums GROUP BY ALL),
walk AS (
  SELECT doc_id, part, 0 AS n, 0::BIGINT AS a, len(list_filter(ends, lambda e: e <= size)) AS j, ends[len(list_filter(ends, lambda e: e <= size))] AS b FROM ends JOIN long USING (doc_id, part)
  UNION ALL
  SELECT doc_id, part, n + 1, a, len(list_filter(ends, lambda e: e <= a + size)), ends[len(list_filter(ends, lambda e: e <= a + size))] FROM (
    SELECT doc_id, part, n, size, ends, list_min(list_filter(list_prepend(0::BIGINT, ends), lambda e: e >= w.b - overlap AND e >= ends[w.j + 1] - size)) AS a
    FROM walk w JOIN ends USING (doc_id, part) JOIN long USING (doc_id, part) WHERE w.j < len(ends))),
pieces AS (SELECT * FROM (SELECT doc_id, part, n, {strip("substr(text, a + 1, b - a)", STRIPPED)} AS content FROM walk JOIN long USING (doc_id, part)) WHERE content <> ''
  UNION ALL SELECT doc_id, part, 0, text FROM {source} WHERE length(text) <= longest)"""


#: One row a piece, numbered within its document, by digest and length.
NUMBERED = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, n) - 1)::INTEGER AS chunk_index, md5(content) AS content_md5, length(content)::INTEGER AS n FROM pieces"


def fixed(size: int, overlap: int, result: str = NUMBERED) -> str:
    source = f"source AS (SELECT doc_id, 0 AS part, text, 0 AS longest, {size} AS size, {overlap} AS overlap FROM documents WHERE text <> '')"
    return f"WITH RECURSIVE {source}, {pieces('source')} {result}"


def adaptive(text: str, result: str = NUMBERED) -> str:
    """F12 of documents' ``text``, with ``result`` over the pieces; sections of HTML need a tree, so such a text is an error here and not left out."""
    headings = rf"list_transform(string_split(text, '{chr(10)}'), lambda l, i: CASE WHEN i > 1 AND (regexp_matches(l, '^#{{1,6}}{ASCII}') OR regexp_matches(l, '^#{{1,6}}$') AND i < len(string_split(text, '{chr(10)}'))) THEN {MARK} || l ELSE l END)"
    markdown = nonempty(f"list_transform(string_split(array_to_string({headings}, '{chr(10)}'), {MARK}), lambda x: {strip('x')})")
    paragraphs = nonempty(rf"list_transform(string_split_regex(text, '\n{ANY}*\n'), lambda x: {strip('x')})")
    return rf"""WITH RECURSIVE docs AS (SELECT doc_id, {text} AS text FROM documents WHERE {text} <> ''),
kinds AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '(?i)<h[1-6][^>]*>')) >= 2 THEN error('HTML') WHEN len(regexp_extract_all(text, '(?m)^#{{1,6}}{ASCII}+[^\x09-\x0D\x20]')) >= 2 THEN 'markdown' WHEN len(regexp_extract_all(text, '\n{ASCII}*\n')) >= 3 THEN 'paragraphs' ELSE 'plain' END AS kind FROM docs),
split AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {paragraphs} AS p FROM kinds WHERE kind = 'paragraphs')),
grouped AS (SELECT *, sum(CASE WHEN i = 1 OR length(text) >= 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS part FROM split),
source AS (SELECT doc_id, part, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, 2000 AS longest, 2000 AS size, 100 AS overlap FROM grouped GROUP BY ALL
  UNION ALL SELECT doc_id, generate_subscripts(p, 1), unnest(p), 2000, 2000, 100 FROM (SELECT doc_id, {markdown} AS p FROM kinds WHERE kind = 'markdown')
  UNION ALL SELECT doc_id, 0, text, 0, CASE WHEN length(text) < 2000 THEN 500 WHEN length(text) > 5000 THEN 1500 ELSE 1000 END, CASE WHEN length(text) < 2000 THEN 50 WHEN length(text) > 5000 THEN 200 ELSE 100 END FROM kinds WHERE kind = 'plain'),
{pieces("source")} {result}"""


def digest_vector(text: str, dims: int = 8) -> str:
    return "[" + ", ".join(f"(('0x' || substr(md5({text}), {1 + 4 * i}, 4))::BIGINT / 32767.5 - 1)::FLOAT::DOUBLE" for i in range(dims)) + "]"


def semantic(most: int = 1500, least: int = 100) -> str:
    """F11 with vectors from digests."""
    return f"""WITH RECURSIVE split AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {sentences("text")} AS s FROM documents WHERE text <> '')),
v AS (SELECT *, {digest_vector("sentence")} AS v FROM split),
likeness AS (SELECT doc_id, i, sentence, list_cosine_similarity(v, lead(v) OVER (PARTITION BY doc_id ORDER BY i)) AS s FROM v),
low AS (SELECT *, s < avg(s) OVER w - 0.3 * stddev_pop(s) OVER w AS ends FROM likeness WINDOW w AS (PARTITION BY doc_id)),
part AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM low),
size AS (SELECT doc_id, g, sum(length(sentence)) + count(*) - 1 AS n FROM part GROUP BY ALL),
joined AS (SELECT doc_id, g, sum(CASE WHEN n >= {least} OR g = first_g THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g)::BIGINT AS part FROM (SELECT *, min(g) OVER (PARTITION BY doc_id) AS first_g FROM size)),
texts AS (SELECT doc_id, joined.part AS part, string_agg(sentence, ' ' ORDER BY i) AS text, arg_max(sentence, i) AS last FROM part JOIN joined USING (doc_id, g) GROUP BY ALL),
source AS (SELECT doc_id, part, concat_ws(' ', lag(last) OVER (PARTITION BY doc_id ORDER BY part), text) AS text, {most} AS longest, {most} AS size, 100 AS overlap FROM texts),
{pieces("source")} {NUMBERED}"""


SENTENCES = f"SELECT doc_id, source AS url, '' AS title, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, coalesce(source, '') AS source, {sentences('text')} AS s FROM documents WHERE text <> '')"

def _words(text: str) -> str:
    return nonempty(f"string_split_regex(lower({text}), '{ANY}+')")


#: Chunks of pieces, stated questions, and for each pair both scores.
_SCORES = rf""", c AS (SELECT doc_id, content, coalesce(d.source, '') AS source, row_number() OVER (ORDER BY doc_id, part, n) AS o FROM pieces JOIN documents d USING (doc_id)),
q AS (SELECT item_id AS query_id, text AS query, {digest_vector("text")} AS v FROM benchmark WHERE item_id % 50 = 0),
w AS (SELECT o, unnest(w) AS term, len(w) AS size FROM (SELECT o, {_words("content")} AS w FROM c)),
st AS (SELECT (SELECT count(*) FROM c) AS n_chunks, (SELECT count(*) FROM w) / (SELECT count(*) FROM c) AS avgdl),
qt AS (SELECT DISTINCT query_id, unnest({_words("query")}) AS term FROM q),
tf AS (SELECT o, term, count(*) AS tf, any_value(size) AS size FROM w WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
b AS (SELECT query_id, o, round(sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avgdl))), 9) AS b FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
e AS (SELECT o, {digest_vector("content")} AS v FROM c),
s AS (SELECT query_id, o, list_cosine_similarity(q.v, e.v) AS s, coalesce(b, 0) AS b FROM q CROSS JOIN e LEFT JOIN b USING (query_id, o)),"""

#: The twenty best by fused ranks: of both lists ranked whole (C1), and of the sixty nearest and the twenty best by words.
_WHOLE_LISTS = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, o) AS br, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, o) AS vr FROM s),
f AS (SELECT query_id, o, s, round(1.0 / (60 + br) + 1.0 / (60 + vr), 12) AS h, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (60 + br) + 1.0 / (60 + vr), 12) DESC, o) AS place FROM r QUALIFY place <= 20),"""
_CANDIDATES = """near AS (SELECT query_id, o, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, o) AS vr FROM s QUALIFY vr <= 60),
ranked AS (SELECT query_id, o, s, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, o) AS br FROM b JOIN s USING (query_id, o, b)),
said AS (SELECT * FROM ranked WHERE br <= 20 OR (query_id, o) IN (SELECT (query_id, o) FROM near)),
merged AS (SELECT query_id, o, coalesce(near.s, said.s) AS s, coalesce(1.0::DOUBLE / (60 + br), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0) AS h FROM near FULL JOIN said USING (query_id, o)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, o) AS place FROM merged QUALIFY place <= 20),"""

#: C4: reranked to ten; near duplicates are folded row by row over lists of at most ten.
_CONTEXTS = """one AS (SELECT f.*, content, source, v FROM f JOIN c USING (o) JOIN e USING (o) QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY place) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, place) AS i, CASE WHEN s > 0 THEN s WHEN h > 0 THEN h ELSE s END AS score FROM one QUALIFY i <= 10),
many AS (SELECT query_id, sum(length(content)) < 2000 AND count(*) <= 10 AS fast, list(score ORDER BY i) AS scores, list(v ORDER BY i) AS vs FROM top GROUP BY ALL),
fold AS (SELECT query_id, 1 AS i, list_transform(scores, lambda x: true) AS kept FROM many
  UNION ALL
  SELECT query_id, i + 1, CASE WHEN kept[i] THEN list_transform(kept, lambda k, j: CASE WHEN j = i THEN bar IS NULL WHEN j > i AND (bar IS NULL OR j < bar) THEN k AND list_cosine_similarity(vs[i], vs[j]) <= 0.85 ELSE k END) ELSE kept END
  FROM (SELECT *, list_min(list_filter(range(i + 1, len(kept) + 1), lambda j: kept[j] AND list_cosine_similarity(vs[i], vs[j]) > 0.85 AND scores[j] > scores[i])) AS bar FROM fold JOIN many USING (query_id)) WHERE i <= len(kept)),
last AS (SELECT query_id, kept FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1),
shown AS (SELECT query_id, 'Source: ' || source || chr(10) || 'Content: ' || content AS entry, CASE WHEN fast THEN i ELSE row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) END AS place FROM top JOIN many USING (query_id) JOIN last USING (query_id) WHERE fast OR kept[i]),
made AS (SELECT query_id, string_agg(entry, chr(10) ORDER BY place) AS context FROM shown GROUP BY ALL)"""

#: C10 over adaptive chunks, and C11 over a store of fixed ones.
RETRIEVAL = adaptive("text", f"""{_SCORES}
{_WHOLE_LISTS}
{_CONTEXTS}
SELECT query_id, length(coalesce(context, ''))::INTEGER AS n, md5(coalesce(context, '')) AS context_md5 FROM q LEFT JOIN made USING (query_id)""")
STORE_QUESTIONS = fixed(1000, 200, f"""{_SCORES}
{_CANDIDATES}
{_CONTEXTS}
SELECT query_id, n_chunks, n_sources, length(context)::INTEGER AS n FROM q LEFT JOIN made USING (query_id)
LEFT JOIN (SELECT query_id, count(*)::INTEGER AS n_chunks, count(DISTINCT nullif(source, ''))::INTEGER AS n_sources FROM top GROUP BY ALL) USING (query_id)""")


#: C5's slow path: pieces of documents by their likeness to stated questions, five at most.
SIMILAR_PIECES = fixed(
    1000,
    100,
    f""", q AS (SELECT item_id AS query_id, {digest_vector("text")} AS v FROM benchmark WHERE item_id % 50 = 0),
s AS (SELECT query_id, doc_id, part, n, content, list_cosine_similarity(q.v, {digest_vector("content")}) AS s FROM q CROSS JOIN pieces),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id, n) AS i FROM s WHERE s >= 0.35 QUALIFY i <= 5)
SELECT query_id, string_agg('Source: ' || coalesce(d.source, 'None') || chr(10) || 'Title: Doc ' || doc_id || chr(10) || 'Content: ' || content || chr(10), chr(10) ORDER BY i) AS context FROM top JOIN documents d USING (doc_id) GROUP BY ALL""",
)

#: The best ten sections of each title, each entry once in the order of titles and ranks, ten in all.
DRAFTS = f"""WITH s AS (SELECT r_regionkey AS query_id, p_partkey, p_name, list_cosine_similarity({digest_vector("r_name")}, {digest_vector("p_name")}) AS s FROM region, part),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, p_partkey) AS i FROM s WHERE s >= 0.5 QUALIFY i <= 10),
one AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY query_id, i) = 1)
SELECT 'Title: Part' || chr(10) || 'Content: ' || p_name || chr(10) AS content FROM one ORDER BY query_id, i LIMIT 10"""
