"""Operator 4: licence scans by template markup.

A template is text with two kinds of regions: ``[[optional]]`` may be missing,
``{{name:m-n}}`` stands for m to n words of any kind. It compiles to an
automaton over words; a licence is accepted where all its mandatory words
match, in order and without other words between. A template is only tried on
texts that hold its longest run of mandatory words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The standard wording of common licences and notices, with the places where they may differ as markup.
TEMPLATES = {
    "gpl-notice": "[[this work is]] licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version {{version:1-2}}",
    "gpl-program": "this {{kind:1-2}} is free software you can redistribute it and or modify it under the terms of the gnu {{kind:0-1}} general public license as published by the free software foundation either version {{version:1-2}} of the license or [[at your option]] any later version [[this {{kind:1-2}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose]]",
    "apache-notice": "licensed under the apache license [[version {{version:1-2}}]]",
    "apache-file": "licensed under the apache license version 2 0 the license you may not use this {{what:1-2}} except in compliance with the license you may obtain a copy of the license at {{address:1-8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "cc-by-notice": "[[this work is]] licensed under [[a]] [[creative commons]] cc by [[nc]] [[nd]] [[sa]] {{version:1-2}}",
    "mit-notice": "[[released]] [[distributed]] [[licensed]] under the [[terms of the]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{holders:1-12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [[provided that the above copyright notice and this permission notice appear in all copies]] the software is provided as is and {{author:1-8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{author:1-8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{number:0-1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {{number:0-1}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[{{number:0-1}} neither the name of {{holder:1-12}} may be used to endorse or promote products derived from this software without specific prior written permission]] this software is provided by {{holders:1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "spdx-tag": "spdx license identifier {{license:1-4}}",
    "copyright-line": "copyright [[c]] {{year:1-2}} {{holder:1-6}} all rights reserved",
}

#: Bytes to words: A-Z in lower case, what parts words as a space, all other bytes as they are.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Automaton:
    """A template's states: ``moves[state]`` has (word or None for any, next state); ``jumps[state]`` costs no word."""

    def __init__(self, markup: str):
        self.moves: list[list[tuple[bytes | None, int]]] = [[]]
        self.jumps: list[list[int]] = [[]]
        self.runs: list[list[str]] = [[]]
        end = self._compile(re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", markup), 0)
        self.final = end
        #: Words an acceptance can begin with, None for any, and the longest run of words that every acceptance holds.
        self.first = {w for s in self._closure({0}) for w, _ in self.moves[s]}
        self.anchor = b" %s " % max((" ".join(r) for r in self.runs), key=len).encode() if any(self.runs) else b""

    def _new(self) -> int:
        self.moves.append([])
        self.jumps.append([])
        return len(self.moves) - 1

    def _compile(self, parts: list[str], state: int) -> int:
        opened: list[int] = []
        for part in parts:
            if part in ("[[", "]]") or part.startswith("{{"):
                self.runs.append([])
            elif not opened:
                self.runs[-1].append(part)
            if part == "[[":
                opened.append(state)
            elif part == "]]":
                after = self._new()
                self.jumps[state].append(after)
                self.jumps[opened.pop()].append(after)
                state = after
            elif part.startswith("{{"):
                least, most = map(int, part[2:-2].rpartition(":")[2].split("-"))
                skips = []
                for k in range(most):
                    if k >= least:
                        skips.append(state)
                    after = self._new()
                    self.moves[state].append((None, after))
                    state = after
                for s in skips:
                    self.jumps[s].append(state)
            else:
                after = self._new()
                self.moves[state].append((part.encode(), after))
                state = after
        return state

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.jumps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def match(self, words: list[bytes], start: int) -> int:
        """Words of the longest acceptance that begins at ``start``; 0 if none."""
        states, best, at = self._closure({0}), 0, start
        while states:
            if self.final in states:
                best = at - start
            if at >= len(words):
                break
            states = self._closure({t for s in states for w, t in self.moves[s] if w is None or w == words[at]})
            at += 1
        return best


class Scanner:
    """Finds phrases and templates in one text after another."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(b" %s " % p.encode(), label) for p, label in phrases.items()]
        self.templates = [(label, Automaton(markup)) for label, markup in templates.items()]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Words, places (start, label) of phrases and spans (start, length, label) of templates."""
        words = text.translate(_TABLE).split()
        line = b" " + b" ".join(words) + b" "
        places = []
        for phrase, label in self.phrases:
            at, counted, before = line.find(phrase), 0, 0
            while at >= 0:
                before, counted = before + line.count(b" ", counted, at), at
                places.append((before, label))
                at = line.find(phrase, at + 1)
        spans = []
        tried = [(label, a) for label, a in self.templates if a.anchor in line]
        if tried:
            wanted = {w for _, a in tried for w in a.first}
            starts: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in wanted:
                    starts.setdefault(w, []).append(i)
            for label, automaton in tried:
                at = range(len(words)) if None in automaton.first else sorted({i for w in automaton.first for i in starts.get(w, ())})
                free = 0
                for i in at:
                    if i >= free and (n := automaton.match(words, i)):
                        spans.append((i, n, label))
                        free = i + n
        return len(words), sorted(places), sorted(spans)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    ``spans`` are the accepted templates (start, length, label). ``score`` is
    the share of found labels that a template confirms: 1 where every base
    label has an accepted notice, 0.5 where phrases stand alone, 0 without any.
    A null or empty text has no words and empty labels; repeated rows count
    each; other columns are ignored; an empty table gives no rows. Texts are
    scanned whole, however long.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,length:long,label:string>>"

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(phrases, templates)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string())]))
        for b in batches:
            rows = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                n, places, spans = scanner.scan(text)
                base, own = {label for _, label in places}, {label for _, _, label in spans}
                confirmed = {label for label in base if any(o.startswith(label) for o in own)}
                score = 1.0 if own and confirmed == base else 0.5 + 0.5 * len(confirmed) / len(base) if base else 0.0
                rows.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | own)), score, [{"start": s, "length": k, "label": x} for s, k, x in spans]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans_type]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, schema)
