"""Small awkward tables and brute-force versions of what the operators share."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, repeated ids, odd white space."""
    base = "the cat of sun is bright and moon on the hill with stars by the lake for night was long as river "
    rows = [
        (0, base * 3, "en", "a", None),
        (1, base * 3, "en", "a", None),
        (1, base * 3, "en", "a", None),
        (2, None, "en", "b", None),
        (3, "", None, None, None),
        (4, " \n\t ", "en", None, None),
        (None, "lone words here", "fr", "a", None),
        (5, "a b c a b c a b c\nsame line\nsame line\n\n\nsame line x", "de", "b", None),
        (6, "x " * 5000 + "end", "en", "c", None),
        (7, " ".join(f"w{i}" for i in range(30_000)), "en", "c", None),
        (8, "café naïve  　 薬 \x1cfoo\x85bar <|endoftext|> it's 'll 42", "fr", "d", None),
        (9, base * 3 + "tail", "en", "a", None),
        (10, "İstanbul ΟΔΟΣ MIT License, released under the MIT license. Apache-License cc by cc by 4.0", "en", "d", None),
        (11, "#*$ %&| <> ## plain", "en", "d", None),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows]
