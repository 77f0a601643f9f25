"""License scans (operator 4).

A generalised suffix automaton holds the words of all licence templates and base phrases. A text streams through
it once and gives, at each word, the longest stretch ending there that stands in some template (the matching
statistic). Long matches are chained along the diagonal of a template: matches of one template in the same order,
not far apart, cover a span of it, and the share they cover is the score.

A base phrase is found at the words where the state's matched stretch ends with it, so overlapping and repeated
places all count.

Words are runs of 0-9, a-z (after A-Z are lower-cased) and of any character beyond U+007F.

Defined cases: a null text counts as empty and has no words; repeated rows are scanned each; an empty table gives
no rows; a null id is passed on. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import batches_of, text_of

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: The clauses of licences that are short enough to stand whole in a file, by label.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
    "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
    "or the use or other dealings in the software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution "
)
_BSD_NAMES = (
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission "
)
_BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
    "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
    "of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
    "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
    "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
    "negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
    "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
    "alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not "
    "claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the "
    "original software this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
    "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
    "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
    "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for "
    "the specific language governing permissions and limitations under the license"
)
WHOLE = (("mit", _MIT), ("bsd", _BSD_HEAD + _BSD_TAIL), ("bsd", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL), ("isc", _ISC), ("zlib", _ZLIB), ("unlicense", _UNLICENSE), ("apache-2.0", _APACHE))

#: Texts of licence notices, by label. Words in the order of the notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version",
    ),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication"),
    *WHOLE,
)

#: Words of the shortest match that is chained, and the share of a template a chain must cover for its label.
LEAST_MATCH, LEAST_COVER = 3, 0.8
#: Words of text or template that may stand between two chained matches.
MOST_GAP = 8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


class SuffixAutomaton:
    """A generalised suffix automaton over lists of words."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Where the longest stretch of a state first ended: (text, words up to its end).
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, words in enumerate(texts):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((k, i + 1))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in order:  # a suffix ends wherever its extensions do
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})

    def _state(self, length: int, link: int, then: dict[str, int]) -> int:
        self.next.append(then)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        if (q := self.next[last].get(word)) is not None:  # another text has it already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def stream(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """The state and the length of the longest stretch that ends at each word and stands in some text."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(word)) is not None:
                state, length = to, length + 1
            yield state, length


class LicenseScanner:
    """Base phrases and licence templates of one text."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(p.split(), label) for p, label in phrases]
        self.templates = [(t.split(), label) for label, t in templates]
        texts = [w for w, _ in self.phrases] + [w for w, _ in self.templates]
        self.automaton = SuffixAutomaton(texts)
        self.known = frozenset(w for ws in texts for w in ws)
        n = len(self.phrases)
        #: For each state, the phrases that end its stretches: (words, phrase).
        self.ended = [
            sorted({(len(self.phrases[k][0]), k) for k, e in ends if k < n and e == len(self.phrases[k][0])}) for ends in self._along_links()
        ]
        #: For each state, where its longest stretch ends in templates.
        self.places = [[(k - n, e) for k, e in ends if k >= n] for ends in self.automaton.ends]

    def _along_links(self) -> list[list[tuple[int, int]]]:
        """For each state, the whole phrases among its stretch's suffixes: those that end at a state along its links."""
        a, n = self.automaton, len(self.phrases)
        whole = [[(k, e) for k, e in ends if k < n and e == len(self.phrases[k][0]) and a.length[s] == e] for s, ends in enumerate(a.ends)]
        out: list[list[tuple[int, int]]] = []
        for s in range(len(a.length)):
            own, at = [], s
            while at > 0:
                own += whole[at]
                at = a.link[at]
            out.append(own)
        return out

    def _runs(self, words: list[str]) -> Iterator[tuple[int, list[str]]]:
        """Stretches of words that templates know; nothing else can match."""
        known = self.known
        at = [i for i, w in enumerate(words) if w in known]
        start = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] != at[k - 1] + 1:
                if k - start >= 2:
                    yield at[start], words[at[start] : at[k - 1] + 1]
                start = k

    def scan(self, text: str) -> dict:
        """n_words, places [(first word, phrase)], spans [(label, template, first, last + 1, share)]."""
        words = WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
        places: list[tuple[int, int]] = []
        hits: dict[int, list[tuple[int, int, int]]] = {}  # template: (template's end, text's end, words)
        for first, run in self._runs(words):
            stats = list(self.automaton.stream(run))
            for i, (state, length) in enumerate(stats):
                for size, k in self.ended[state]:
                    if size <= length:
                        places.append((first + i + 1 - size, k))
                if length >= LEAST_MATCH and (i + 1 == len(stats) or stats[i + 1][1] <= length):  # as long as it gets
                    for k, e in self.places[state]:
                        hits.setdefault(k, []).append((e, first + i + 1, length))
        return {"n_words": len(words), "places": places, "spans": [s for k, h in hits.items() for s in self._chains(k, h)]}

    def _chains(self, k: int, hits: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, int, float]]:
        """Chains of matches that go forward in text and template; each is kept if it covers enough of the template."""
        words, label = self.templates[k]
        open_: list[list] = []  # [template's end, text's end, covered, text's start]
        done: list[list] = []
        for e, t, n in sorted(hits, key=lambda h: (h[1], -h[2])):
            best = None
            for c in open_:
                gain = min(n, e - c[0], t - c[1])  # words of this match beyond the chain's end
                if gain > 0 and e - gain - c[0] <= MOST_GAP and t - gain - c[1] <= MOST_GAP and (best is None or c[2] > best[2]):
                    best = c
            if best is None:
                open_.append([e, t, n, t - n])
            else:
                best[2] += min(n, e - best[0], t - best[1])
                best[0], best[1] = e, t
            done += [c for c in open_ if t - c[1] > MOST_GAP + len(words)]
            open_ = [c for c in open_ if t - c[1] <= MOST_GAP + len(words)]
        for e, t, covered, start in done + open_:
            if covered >= LEAST_COVER * len(words):
                yield label, k, start, t, min(1.0, covered / len(words))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (first word, label) of base phrases, spans (label, first, last, share) of templates."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("places", pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string())]))),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(phrases, templates)

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out = scanner.scan(text)
                    places = [{"first": at, "label": scanner.phrases[k][1]} for at, k in out["places"]]
                    spans = [{"label": label, "first": a, "last": b - 1, "share": share} for label, _, a, b, share in out["spans"]]
                    yield doc_id, out["n_words"], places, spans

        yield from batches_of(rows(), schema)

    picked = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    ddl = "doc_id long, n_words long, places array<struct<first:long,label:string>>, spans array<struct<label:string,first:long,last:long,share:double>>"
    return picked.mapInArrow(run, ddl)
