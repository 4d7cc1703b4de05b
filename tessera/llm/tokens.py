"""Word-wise encoding for tokenizers that drop white space, shared by packing and token counts."""

from __future__ import annotations

import hashlib

#: A worker's table of encoded words starts anew beyond so many entries.
MOST_WORDS = 600_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def version_digest(path: str) -> str:
    """Of the vocabulary file and the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordEncoder:
    """Encodes whole texts by a tokenizer whose pieces never span ASCII white space.

    That holds when white space is neither kept nor context to a piece, as for
    BPE with word ends (any other kind is refused). Each distinct word is
    encoded once and kept in a table of bounded size; ``text_ids`` joins the
    words' ids, two bytes each (four for a vocabulary beyond 65,536).

    Words of plain Latin letters, digits and signs go to a faster merge loop:
    byte 255, which no UTF-8 text has, ends a piece, so that "letter, end" are
    the first merges and all others follow by rank. Every other word, and any
    that may hold a special token, goes to the library itself.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.words: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        if not suffix:
            raise ValueError("a vocabulary with word ends is needed")
        letters, special = byte_letters(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in t.removesuffix(suffix)) + self.END * t.endswith(suffix): i for t, i in model["vocab"].items() if t not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks | {self.END: 1_000_000}, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+").fullmatch

    def _encode(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not self.plain(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            text = text.lower()
            if text.isalpha():
                ids = self.merge(text.encode() + self.END)
            else:
                ids = [i for piece in self.pieces(text) for i in self.merge(piece.encode() + self.END)]
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def text_ids(self, text: bytes) -> bytes:
        words, known = text.split(), self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            out = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    ids = known[w] = self._encode(w)
                out.append(ids)
            return b"".join(out)
