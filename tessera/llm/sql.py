"""DuckDB SQL for the queries that SQL can express: operators 1, 4, 7, 8, 9 and 11 to 13."""

from __future__ import annotations

import re

from tessera.llm import conversations, jaccard, licenses, mixing, quality, repeats, resampling, sharding

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quality() -> str:
    measures = {"symbols": "10000 * n_symbols // greatest(word_chars, 1)", "repeats": "10000 * n_repeat_words // greatest(n_words, 1)", "lines": "10000 * n_dup_lines // greatest(n_lines, 1)", "capitals": "10000 * capitals // greatest(word_chars, 1)", "length": "100 * word_chars // greatest(n_words, 1)"}
    rows = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS m, ({e})::BIGINT AS v, {quality.UPPER[m]} AS pct FROM b" for m, e in measures.items())
    quantiles = "max(total) AS n, min(CASE WHEN 2 * c >= total THEN b END) AS middle, min(CASE WHEN 100 * c >= pct * total THEN b END) AS u"
    fence, prior = f"(u + {quality.REACH} * (u - middle) + {quality.FLOOR})::BIGINT AS f", quality.PRIOR
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1),
gap AS (SELECT doc_id, least(3, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 3)) AS g FROM dup),
rep AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM gap GROUP BY 1),
m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
  (length(t) - length(translate(t, '{UPPER}', '')))::BIGINT AS capitals, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM m),
v AS ({rows}),
k AS (SELECT lang, source, m, pct, (v >> greatest(0, length(bin(v)) - 9)) << greatest(0, length(bin(v)) - 9) AS b, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
o1 AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, m ORDER BY b) AS c, sum(n) OVER (PARTITION BY lang, source, m) AS total FROM k),
o2 AS (SELECT lang, source, m, {quantiles} FROM o1 GROUP BY ALL),
l0 AS (SELECT lang, m, pct, b, sum(n) AS n FROM k GROUP BY ALL),
l1 AS (SELECT *, sum(n) OVER (PARTITION BY lang, m ORDER BY b) AS c, sum(n) OVER (PARTITION BY lang, m) AS total FROM l0),
l2 AS (SELECT lang, m, {quantiles} FROM l1 GROUP BY ALL),
a0 AS (SELECT m, pct, b, sum(n) AS n FROM k GROUP BY ALL),
a1 AS (SELECT *, sum(n) OVER (PARTITION BY m ORDER BY b) AS c, sum(n) OVER (PARTITION BY m) AS total FROM a0),
a2 AS (SELECT m, {quantiles} FROM a1 GROUP BY ALL),
l3 AS (SELECT lang, m, n, {fence} FROM l2), a3 AS (SELECT m, n, {fence} FROM a2), o3 AS (SELECT lang, source, m, n, {fence} FROM o2),
l4 AS (SELECT lang, m, (l3.n * l3.f + {prior} * a3.f)::BIGINT // (l3.n + {prior})::BIGINT AS f FROM l3 JOIN a3 USING (m)),
f AS (SELECT o3.lang, o3.source, o3.m, (o3.n * o3.f + {prior} * l4.f)::BIGINT // (o3.n + {prior})::BIGINT AS fence FROM o3 JOIN l4 ON o3.lang IS NOT DISTINCT FROM l4.lang AND o3.m = l4.m),
bad AS (SELECT DISTINCT doc_id FROM v JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.m = f.m WHERE v > fence)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""


def _pattern(markup: str) -> str:
    """A template as a pattern over "word word "."""
    markup = re.sub(r"\{\{[^}]*:(\d+)-(\d+)\}\} ?", r"([^ ]+ ){\1,\2}", f"{markup} ".replace("]] ", "]]"))
    return markup.replace("]]", " )?").replace("[[", "(").replace(" )", " )").replace("}  )", "} )").replace("} )?", "})?")


def _licenses() -> str:
    places = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: array_to_string(w[i + 1:i + {len(p.split())}], ' ') = '{p}')) AS i, '{label}' AS label FROM d WHERE contains(line, ' {p} ')" for p, label in licenses.PHRASES.items())
    own = " || ".join(f"CASE WHEN regexp_matches(line, ' {x}') THEN ['{label}'] ELSE []::VARCHAR[] END" for label, x in ((n, _pattern(m)) for n, m in licenses.TEMPLATES.items()))
    return rf"""
WITH x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM x),
p AS ({places}),
a AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS base FROM p GROUP BY 1),
j AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base, []::VARCHAR[]) AS base, {own} AS own FROM d LEFT JOIN a USING (doc_id)),
c AS (SELECT *, len(list_filter(base, lambda b: len(list_filter(own, lambda o: starts_with(o, b))) > 0)) AS confirmed FROM j)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || own)), ',') AS labels,
  CASE WHEN len(own) > 0 AND confirmed = len(base) THEN 1.0::DOUBLE WHEN len(base) > 0 THEN 0.5 + 0.5 * confirmed / len(base)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM c"""


def _jaccard() -> str:
    k, t = jaccard.SHINGLE, jaccard.PERCENT
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * met >= {t} * (nx.n + ny.n - met)),
r AS (SELECT x AS a, y AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)"""


def _repeats() -> str:
    k = repeats.K
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(w) - {k - 2})) AS i, w FROM d WHERE len(w) >= {k}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {k - 1}], ' ')) AS h FROM e),
f AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
g AS (SELECT x.doc_id, j, word, coalesce(max(CASE WHEN f.i IS NOT NULL THEN 1 END) OVER (PARTITION BY x.doc_id ORDER BY j ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.i = j),
a AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY j) AS kept FROM g GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""


def _mixing() -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(concat_ws(':', 9, doc_id, md5(text))) AS k FROM documents),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([{weights}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w, source_size * {mixing.MOST}::DOUBLE AS cap FROM z),
f AS (SELECT *, cap / w AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, full_at) FROM l WHERE level <= full_at) * w, cap)) AS target FROM l),
q AS (SELECT p.*, source_size, target, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken FROM q"""


#: CRC-32's table by its rule, and its sum over the bytes of a text.
CRC_TABLE = "tab AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS tab FROM range(256) t(b))"


def _crc(text: str) -> str:
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i::BIGINT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _resampling() -> str:
    r, word = resampling, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word FROM d),
y AS (SELECT unnest(regexp_extract_all({low}, '{word}')) AS word FROM benchmark),
v AS (SELECT word, {_crc("word")} % {r.BUCKETS} AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y), tab),
s AS (SELECT bucket, count(*) AS s FROM x JOIN v USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM y JOIN v USING (word) GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM x) AS s_all, (SELECT count(*) FROM y) AS t_all),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {r.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {r.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT doc_id, sum(gain)::BIGINT AS total FROM x JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
b AS (SELECT doc_id, len(w)::BIGINT AS n, total, ('0x' || substr(sha256('{r.SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
w AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight, h FROM b),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY n >= {r.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n >= {r.LEAST_WORDS}) AS able FROM z)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= {r.LEAST_WORDS} AND place <= {r.PERCENT} * able // 100 THEN place END AS rank FROM k"""


def _repair() -> str:
    """Forward over the turns: of all ways to the same last role the cheapest, then the ASCII-least, stays so whatever follows."""
    c, steps = conversations, []
    for state in range(4):
        here = state
        for inserts in range(4):
            to = {0: 2, 1: 2, 2: 3, 3: 2}[here]  # 0: nothing yet, 1: after s, 2: after u, 3: after a
            for role in "sua?":
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((here, role))
                base = c.INSERT * inserts
                steps.append((state, role, "I" * inserts + "D", base + c.DELETE, here, 1))
                steps.append((state, role, "I" * inserts + "R", base + c.REROLE, to, 0))
                if kept is not None:
                    steps.append((state, role, "I" * inserts + "K", base + c.KEEP, kept, 0))
            here = to
    table = ", ".join(map(str, steps))
    gap = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat_ws(':', coalesce(conv_id::VARCHAR, ' '), coalesce(turn::VARCHAR, ' ')) AS name FROM conversations),
h AS (SELECT o.*, {_crc("name")} % 20 AS c FROM o, tab),
q AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN c = 3 THEN [0, 1] ELSE [0] END) FROM h WHERE c <> 0),
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM q),
x AS (SELECT conv_id, i, turn, role, text, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS s, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?]{gap}*\z') THEN 'truncated' ELSE '' END AS fault FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM r)),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM x GROUP BY 1),
l AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, s || lead(s) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM x) WHERE pair IS NOT NULL GROUP BY 1),
e(state, s, edits, price, next, gone) AS (VALUES {table}),
f AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'c': 0, 'a': ''}} AS best FROM g
  UNION ALL
  SELECT f.conv_id, f.i + 1, e.next, min({{'c': best.c + price + CASE WHEN fault = 'truncated' AND gone = 0 THEN {c.TRUNCATED} ELSE 0 END, 'a': best.a || edits}})
  FROM f JOIN x ON x.conv_id = f.conv_id AND x.i = f.i + 1 JOIN e ON e.state = f.state AND e.s = x.s WHERE gone = 1 OR fault IN ('', 'truncated') GROUP BY ALL),
p AS (SELECT conv_id, min({{'c': best.c + CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END * {c.INSERT}, 'a': best.a || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS b FROM f JOIN g USING (conv_id) WHERE i = n GROUP BY 1),
j AS (SELECT conv_id, unnest(string_split(b.a, '')) AS edit, unnest(range(1, length(b.a) + 1)) AS j FROM p WHERE b.a <> ''),
k AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS m FROM j),
y AS (SELECT k.conv_id, j, edit, m, role, text, max(CASE WHEN m = 1 AND edit = 'K' AND s = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k.conv_id) AS lead FROM k LEFT JOIN x ON x.conv_id = k.conv_id AND x.i = k.i AND edit <> 'I' WHERE edit <> 'D'),
z AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS digest FROM y GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id) LEFT JOIN l USING (conv_id) LEFT JOIN p USING (conv_id) LEFT JOIN z USING (conv_id)"""


def _sharding() -> str:
    """What stays is the smaller of a shard's bytes and its new capacity; what is left meets the room that is left in the order of the numbers."""
    return rf"""
WITH {CRC_TABLE},
c AS (SELECT t, {_crc("t")} AS text_crc32 FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents), tab),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, text_crc32, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {sharding.OLD})::INT AS old_shard FROM documents JOIN c ON coalesce(text, '') = c.t),
p AS (SELECT *, sum(size) OVER w - size AS place, row_number() OVER w AS line FROM d WINDOW w AS (PARTITION BY old_shard ORDER BY size DESC, doc_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT i::INT AS shard, coalesce((SELECT sum(size) FROM d WHERE old_shard = i), 0)::BIGINT AS have, (t // {sharding.NEW} + CASE WHEN i < t % {sharding.NEW} THEN 1 ELSE 0 END)::BIGINT AS room FROM range({sharding.NEW}) r(i), (SELECT sum(size)::BIGINT AS t FROM d)),
s AS (SELECT *, greatest(have - room, 0) AS over, greatest(room - have, 0) AS under FROM n),
u AS (SELECT *, sum(over) OVER (ORDER BY shard) - over AS o0, sum(under) OVER (ORDER BY shard) - under AS u0 FROM s),
m AS (SELECT a.shard AS old_shard, b.shard, least(a.have, a.room) + greatest(a.o0, b.u0) - a.o0 AS low, least(a.have, a.room) + least(a.o0 + a.over, b.u0 + b.under) - a.o0 AS high FROM u a JOIN u b ON greatest(a.o0, b.u0) < least(a.o0 + a.over, b.u0 + b.under)
  UNION ALL SELECT shard, shard, 0, least(have, room) FROM u)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY p.old_shard, line) - 1)::BIGINT AS slot, NULL::INT AS grown_shard, p.old_shard FROM p JOIN m ON m.old_shard = p.old_shard AND place + size // 2 >= low AND place + size // 2 < high"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _quality(), "op4_license_scans": _licenses(), "op7_ngram_jaccard_join": _jaccard(), "op8_substring_dedup": _repeats(), "op9_mixing": _mixing(), "op11_importance_resampling": _resampling(), "op12_conversation_repair": _repair(), "op13_sharding": _sharding()}
