"""License scans by template markup.

A template is a text of words with two kinds of marked regions, in the manner of license-list templates:

    <<o>>optional words<</o>>     may be absent
    <<v:3>>                       replaceable: any 0 to 3 words

Everything else is mandatory wording. Each template is compiled to an automaton over words (optional regions become
empty moves, replaceable regions counted any-word moves), the automata are joined into one, and that one is determinised
lazily while texts are read. A text is accepted at a place only if all mandatory words stand there exactly.

There are templates of whole texts (short licenses; the notices that long ones ask for) and of mentions. Words are
symbols of a character each, so templates may have up to a million distinct words. Reading is linear: words outside the
templates' vocabulary share one symbol, and the automaton is started only where a template's first word stands.

Defined results: null and empty texts have no words, score 0 and empty labels; overlapping matches all count; equal
rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are always counted, with their labels. (fixed values)
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of mentions of well-known public licenses, with the label of each. (fixed values)
MENTIONS = {
    "apache-2.0": "licensed under the apache license <<o>>version<</o>> 2 <<o>>0<</o>>",
    "mit-mention": "<<o>>released<</o>> under the mit license",
    "bsd-mention": "licensed under <<o>>the<</o>> <<v:2>> bsd <<o>>style<</o>> license",
    "gpl-2.0": "gnu general public license <<o>>as published by the free software foundation<</o>> <<o>>either<</o>> version 2",
    "gpl-3.0": "gnu general public license <<o>>as published by the free software foundation<</o>> <<o>>either<</o>> version 3",
    "cc-by-4.0": "licensed under <<o>>a creative commons<</o>> <<o>>cc<</o>> by 4 0",
    "cc-by-nc-4.0": "licensed under <<o>>a creative commons<</o>> <<o>>cc<</o>> by nc 4 0",
    "cc-by-sa-4.0": "licensed under <<o>>a creative commons<</o>> <<o>>cc<</o>> by sa 4 0",
    "copyright": "copyright <<o>>c<</o>> <<v:6>> all rights reserved",
}

_WARRANTY = "<<v:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<v:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<o>>1<</o>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<o>>2<</o>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {0} general public license as published by the free software foundation either version {1} of the license or <<o>>at your option<</o>> any later version <<v:6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} general public license for more details you should have received a copy of the gnu {0} general public license along with <<v:6>> if not {2}"
_SEE = "see <<o>>http www gnu org licenses<</o>> <<o>>https www gnu org licenses<</o>>"
_WRITE = "write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa"

#: Whole texts of short licenses, and the whole notices that long ones ask for, behind the copyright line. (fixed values)
TEXTS = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<o>>including the next paragraph<</o>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<v:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-0": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<v:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and <<o>>or<</o>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<v:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<v:8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "0bsd": "permission to use copy modify and <<o>>or<</o>> distribute this software for any purpose with or without fee is hereby granted the software is provided as is and <<v:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<v:8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": f"{_BSD} this software is provided by {_WARRANTY}",
    "bsd-3-clause": f"{_BSD} <<o>>3<</o>> neither the name of <<v:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by {_WARRANTY}",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<o>>1<</o>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<o>>2<</o>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<o>>3<</o>> this notice may not be removed or altered from any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software <<o>>for more information please refer to <<v:4>> unlicense org<</o>>",
    "bsl-1.0": "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "wtfpl": "do what the fuck you want to public license <<o>>version 2 december 2004<</o>> <<v:16>> everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<o>>http www apache org licenses license 2 0<</o>> <<o>>https www apache org licenses license 2 0<</o>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<o>>http<</o>> <<o>>https<</o>> mozilla org mpl 2 0",
    "gpl-2.0-notice": _GNU.format("", "2", _WRITE),
    "gpl-3.0-notice": _GNU.format("", "3", _SEE),
    "lgpl-2.1-notice": _GNU.format("lesser", "2 1", _WRITE),
    "lgpl-3.0-notice": _GNU.format("lesser", "3", _SEE),
    "agpl-3.0-notice": _GNU.format("affero", "3", _SEE),
}
TEMPLATES = MENTIONS | TEXTS

#: Word characters are 0-9, a-z and all non-ASCII; A-Z become lower case; the rest separates.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

_MARK = re.compile(r"<<(o|/o|v:\d+)>>")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """All templates in one automaton over word symbols; deterministic states are made when first met.

    States of the nondeterministic automaton are numbered; ``step[s]`` maps a symbol to the states after it, ``any[s]``
    lists the states after any word, ``free[s]`` those reached without a word. ``final[s]`` names the labels accepted in s.
    """

    OTHER = "\0"

    def __init__(self, templates: Iterable[tuple[str, str, bool]], limit: int = 50_000):
        #: A word's symbol is a character above ``OTHER``, which stands for all words of no template.
        self.symbol: dict[bytes, str] = {}
        self.step: list[dict[str, list[int]]] = []
        self.any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.final: dict[int, tuple[str, bool]] = {}
        self.limit = limit
        self.start = self._state()
        for label, text, base in templates:
            self._compile(label, text, base)
        if len(self.symbol) > 1_000_000:
            raise ValueError("templates have more than a million distinct words")
        self._reset()
        #: Symbols with which a match can begin.
        self.firsts = sorted({a for s in self._closed([self.start]) for a in self.step[s]})
        if any(self.any[s] for s in self._closed([self.start])):
            raise ValueError("a template begins with a replaceable region")
        self.first_re = re.compile("[" + "".join(map(re.escape, self.firsts)) + "]")

    def _state(self) -> int:
        self.step.append({})
        self.any.append([])
        self.free.append([])
        return len(self.step) - 1

    def _compile(self, label: str, text: str, base: bool) -> None:
        at, opened = self._state(), []
        self.free[self.start].append(at)
        for i, part in enumerate(_MARK.split(text)):
            if i % 2 == 0:
                for word in words_of(part):
                    to = self._state()
                    self.step[at].setdefault(self.symbol.setdefault(word, chr(len(self.symbol) + 1)), []).append(to)
                    at = to
            elif part == "o":
                opened.append(at)
            elif part == "/o":
                to = self._state()
                self.free[at].append(to)
                self.free[opened.pop()].append(to)
                at = to
            else:
                end = self._state()
                for _ in range(int(part[2:])):
                    self.free[at].append(end)
                    to = self._state()
                    self.any[at].append(to)
                    at = to
                self.free[at].append(end)
                at = end
        if opened:
            raise ValueError(f"{label}: an optional region isn't closed")
        self.final[at] = (label, base)

    def _reset(self) -> None:
        self.ids: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[list[tuple[str, bool]]] = []
        self.root = self._intern(self._closed([self.start]))

    def _closed(self, states: Iterable[int]) -> frozenset[int]:
        todo = list(states)
        seen = set(todo)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def _intern(self, states: frozenset[int]) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.accepts.append([self.final[s] for s in sorted(states) if s in self.final])
        return self.ids[states]

    def _move(self, state: int, symbol: str) -> int:
        """The deterministic state after a symbol; -1 if no match can go on."""
        to: set[int] = set()
        for s in self.sets[state]:
            to.update(self.step[s].get(symbol, ()))
            to.update(self.any[s])
        self.moves[state][symbol] = found = self._intern(self._closed(to)) if to else -1
        return found

    def read(self, words: list[bytes]) -> str:
        """The symbols of words."""
        return "".join(map(self.symbol.get, words, [self.OTHER] * len(words)))

    def matches(self, symbols: str) -> Iterator[tuple[str, bool, int, int]]:
        """(label, base, first word, end) of each accepted place; of one label and start, the longest."""
        if len(self.sets) > self.limit:
            self._reset()
        n = len(symbols)
        for m in self.first_re.finditer(symbols):
            at = begin = m.start()
            state, found = self.root, {}
            while at < n:
                symbol = symbols[at]
                to = self.moves[state].get(symbol)
                state = self._move(state, symbol) if to is None else to
                if state < 0:
                    break
                at += 1
                for x in self.accepts[state]:
                    found[x] = at
            for (label, base), end in found.items():
                yield label, base, begin, end


def automaton(base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> Automaton:
    return Automaton([(label, text, True) for text, label in base.items()] + [(label, text, False) for label, text in templates.items()])


def scan_text(found: Automaton, text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    words = words_of(text)
    spans = list(found.matches(found.read(words)))
    starts = [s for _, base, s, _ in spans if base]
    covered, end = 0, 0
    for s, e in sorted((s, e) for _, _, s, e in spans):
        covered += max(0, e - max(s, end))
        end = max(end, e)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for x, base, *_ in spans if base})), ",".join(sorted({x for x, *_ in spans})),
        covered / len(words) if words else 0.0,
        [(x, s, e) for x, _, s, e in sorted(spans, key=lambda v: (v[2], v[3], v[0]))],
    )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``; score is the share of its words that matches cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton(base, templates)
        names = [x.split()[0] for x in SCHEMA.split(", ")[1:]]
        for b in batches:
            out = pd.DataFrame([scan_text(found, t) for t in b["text"]], columns=names).astype({"first_word": "Int64", "last_word": "Int64"})
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA)
