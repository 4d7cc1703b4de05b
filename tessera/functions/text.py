"""Text functions as columns: words, sentences, paragraphs, structure, parsers and recalls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations whose period ends no sentence, in any case.
ABBREVIATIONS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|Prof|Dr|Mr|Mrs|Ms|Rev|Gen|Col|Sgt|Capt|Lt|Inc|Ltd|Corp|Co|St|Jr|Sr|Dept|Univ|Assn|Mt|Ft|vs|etc|cf|al|approx|no|vol|pp|ch|sec|fig|eq"
#: No letter, digit or underscore of any script stands before: what \b means to Java differs by its version.
_WORD = r"(?<![\p{L}\p{N}_])"
_NO_END = rf"(?<!{_WORD}[A-Z]\.)(?<!{_WORD}(?i:{ABBREVIATIONS})\.)(?<!{_WORD}e\.g\.)(?<!{_WORD}i\.e\.)(?<!\.\.)"
SENTENCE_END = rf"(?<=[.!?]){_NO_END}(?U)\s+(?-U)(?=[A-Z\"'\x80-\xff])"
WHITE = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def words(c: Column | str) -> Column:
    """lower-case words between white space."""
    return F.array_remove(F.split(F.lower(col(c)), WHITE), "")


def word_count(c: Column | str) -> Column:
    """F37."""
    return F.coalesce(F.regexp_count(col(c), F.lit(r"(?U)\S+")), F.lit(0))


def sentences(c: Column | str) -> Column:
    """sentences, aware of abbreviations, initials and ellipses; empty for blank text."""
    return nonempty(F.transform(F.split(col(c), SENTENCE_END), strip))


def paragraphs(c: Column | str) -> Column:
    """between blank lines, trimmed, without empty ones."""
    return nonempty(F.transform(F.split(col(c), r"\n(?U)\s*\n"), strip))


def structure(c: Column | str) -> Column:
    """html, markdown, paragraphs or plain, in this order of preference."""
    c = col(c)
    html = F.regexp_count(c, F.lit(r"(?i)<h[1-6][^>]*>")) >= 2
    markdown = F.regexp_count(c, F.lit(r"(?m)^#{1,6}\s+\S")) >= 2
    gaps = F.regexp_count(c, F.lit(r"\n\s*\n")) >= 3
    return F.when(html, "html").when(markdown, "markdown").when(gaps, "paragraphs").otherwise("plain")


def chunk_params(length: Column) -> Column:
    """(size, overlap) by the text's length; the bounds are exclusive."""
    pair = lambda size, overlap: F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"))
    return F.when(length < 2000, pair(500, 50)).when(length > 5000, pair(1500, 200)).otherwise(pair(1000, 100))


def markdown_parts(c: Column | str) -> Column:
    """split before each heading line."""
    return nonempty(F.transform(F.split(col(c), r"(?=\n#{1,6}\s+)"), strip))


def bullets(c: Column | str) -> Column:
    """items of a list, without a leading bullet or number that white space follows, and without quotes."""
    bare = F.transform(F.split(col(c), "\n"), lambda x: F.regexp_replace(strip(x), r"^(?:[-*•]|\d+[.)])\s+", ""))
    return nonempty(F.transform(bare, lambda x: F.regexp_replace(x, "^[\"']+|[\"']+$", "")))


def query_goals(c: Column | str, most: int) -> Column:
    """array of (query, goal) from "Query:" lines and the "Goal:" line that follows, if any."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), col(c)), r"\n\s*Query:"), lambda x: F.lit(True))
    blocks = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    out = F.transform(blocks, lambda b: F.struct(strip(F.element_at(F.split(b, "\n"), 1)).alias("query"), F.nullif(strip(F.regexp_extract(b, r"\n\s*Goal:([^\n]*)", 1)), F.lit("")).alias("goal")))
    return F.slice(out, 1, most)


def learnings(c: Column | str) -> Column:
    """F32: array of (learning, url) from "Learning" lines: a url in brackets, else a bare one, else null."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x.startswith("Learning"))

    def parse(line: Column) -> Column:
        bracket, bare = F.regexp_extract(line, r"\[(.*?)\]:", 1), F.regexp_extract(line, r"https?://[^\s\]\)]+", 0)
        after = strip(F.regexp_replace(line, r"^Learning[^\[:]*(?:\[.*?\])?:", ""))
        plain = strip(F.regexp_replace(line, "Learning:", ""))
        text = F.when(bracket != "", after).when(bare != "", strip(F.replace(plain, bare, F.lit("")))).otherwise(plain)
        return F.struct(text.alias("learning"), F.when(bracket != "", bracket).when(bare != "", bare).alias("url"))

    return F.transform(lines, parse)


def questions(c: Column | str, most: int) -> Column:
    """F32: follow-up questions."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x.startswith("Question:"))
    return F.slice(F.transform(lines, lambda x: strip(F.regexp_replace(x, "Question:", ""))), 1, most)


def json_object(c: Column | str, greedy: bool = True) -> Column:
    """the JSON object inside prose, null if there is none or it doesn't parse."""
    found = F.regexp_extract(col(c), r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def keyword_recall(context: Column, keywords: Column) -> Column:
    """share of the keywords that occur in the context, in any case; 1 without keywords."""
    found = F.size(F.filter(keywords, lambda k: F.contains(F.lower(context), F.lower(k))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(found / F.size(keywords))


def keyword_precision(context: Column, keywords: Column) -> Column:
    """share of the context's distinct words that belong to a keyword; 0 without keywords or words."""
    own = F.array_distinct(words(context))
    wanted = F.array_distinct(F.flatten(F.transform(keywords, words)))
    return F.when((F.size(keywords) == 0) | (F.size(own) == 0), 0.0).otherwise(F.size(F.array_intersect(own, wanted)) / F.size(own))


def hit(context: Column, keywords: Column) -> Column:
    """does any keyword occur?"""
    return F.exists(keywords, lambda k: F.contains(F.lower(context), F.lower(k)))


def token_recall(context: Column, answer: Column) -> Column:
    """share of the answer's words that occur in the context as substrings; 1 for no words."""
    own = words(answer)
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(own, lambda t: F.contains(F.lower(context), t))) / F.size(own))


def phrase_recall(context: Column, answer: Column) -> Column:
    """share of the answer's phrases, longer than five characters between punctuation, that occur in the context."""
    own = F.filter(F.transform(F.split(F.lower(answer), r"[,.:;!?()]"), strip), lambda p: F.length(p) > 5)
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(own, lambda p: F.contains(F.lower(context), p))) / F.size(own))


def file_name(c: Column | str) -> Column:
    """ten characters of the text's digest and its letters, digits, spaces and dashes."""
    return F.concat(F.substring(F.md5(col(c)), 1, 10), F.lit("_"), strip(F.regexp_replace(col(c), r"(?U)[^\w\s-]", "")))


def grade(c: Column | str) -> Column:
    """A, B or C alone, else the longest grade that the text names."""
    c = F.upper(strip(col(c)))
    return F.when(c == "A", "CORRECT").when(c == "B", "INCORRECT").when(c == "C", "NOT_ATTEMPTED").when(c.contains("NOT_ATTEMPTED"), "NOT_ATTEMPTED").when(c.contains("INCORRECT"), "INCORRECT").when(c.contains("CORRECT"), "CORRECT").otherwise("NOT_ATTEMPTED")


def summary(c: Column | str, most: int = 200) -> Column:
    """The first characters, with dots only where some are missing."""
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def placeholders(c: Column | str) -> Column:
    """the descriptions of [IMAGE: ...] marks."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[IMAGE:\s*([^\]]+)\]"), 1), strip)


def without_placeholders(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\[IMAGE:\s*[^\]]+\]\n?", "")


def site_query(query: Column, domains: Column, join_first: bool) -> Column:
    """a query limited to domains: "(site:a OR site:b) q" or "q site:a OR site:b"."""
    sites = F.array_join(F.transform(domains, lambda d: F.concat(F.lit("site:"), d)), " OR ")
    limited = F.concat(F.lit("("), sites, F.lit(") "), query) if join_first else F.concat(query, F.lit(" "), sites)
    return F.when(F.coalesce(F.size(domains), F.lit(0)) <= 0, query).otherwise(limited)
