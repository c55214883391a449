r"""License scans (operator 4): template-markup matching with token automata.

A template is plain license wording with two marks: `[[ ... ]]` is wording that may be left out, and
`{{n}}` stands for any 0 to n words. It is compiled into an automaton over words; a text is accepted from
a word where the automaton reaches its end, so everything outside the marks must match word for word.
Every template starts with three fixed words: only places where those stand are tried. Base phrases are
consecutive words and are found with array comparisons.

One pass over the texts, no shuffle. Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
`score` is the share of a text's words inside base phrases or accepted wording, 0 for a text without
words. Null and empty texts: no words, no labels (empty strings), first_word and last_word null.
Repeated rows are scanned one by one, very long texts whole. Where templates match at one place, each counts;
equal labels are one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import table
from inkstone.llm._words import ALNUM, Words, hash_words, slices

#: Phrases and labels of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wording of common notices and licenses, as (label, text); [[optional]], {{up to n other words}}.
TEMPLATES = [
    ("gpl", "under the GNU General Public License [[as published by the Free Software Foundation]] [[either]] version {{1}} of the License"),
    ("gpl", "under the GNU General Public License [[as published by the Free Software Foundation]] [[either]] version [[1]] [[2]] [[3]] [[of the License]]"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License
     as published by the Free Software Foundation either version {{1}} of the License or at your option any later version
     [[this program is distributed in the hope that it will be useful but WITHOUT ANY WARRANTY without even the implied warranty of
     MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE see the GNU General Public License for more details]]
     [[you should have received a copy of the GNU General Public License along with this program {{16}} licenses]]"""),
    ("lgpl", "under the GNU Lesser General Public License [[as published by the Free Software Foundation]] [[either]] version [[2]] [[3]] [[1]] [[0]] [[of the License]]"),
    ("apache-2", "licensed under the Apache License Version 2 0 [[the License]]"),
    ("apache-2", """licensed under the Apache License Version 2 0 the License you may not use this file except in compliance with the License
     you may obtain a copy of the License at [[http]] [[https]] {{8}} LICENSE 2 0 unless required by applicable law or agreed to in writing
     software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or
     implied see the License for the specific language governing permissions and limitations under the License"""),
    ("cc-by", "under the Creative Commons Attribution {{3}} License"),
    ("cc-by-sa", "licensed under CC BY SA [[2]] [[3]] [[4]] [[5]] [[0]]"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
     documentation files the Software to deal in the Software without restriction including without limitation the
     rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the
     Software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
     [[including the next paragraph]] shall be included in all copies or substantial portions of the Software THE SOFTWARE IS PROVIDED AS IS
     WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A
     PARTICULAR PURPOSE AND NONINFRINGEMENT IN NO EVENT SHALL THE {{12}} BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY
     WHETHER IN AN ACTION OF CONTRACT TORT OR OTHERWISE ARISING FROM OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
     DEALINGS IN THE SOFTWARE"""),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
     documentation files [[the Software]] to deal in the Software without restriction [[including without limitation the
     rights to use copy modify merge publish distribute sublicense and or sell copies of the Software]]"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that
     the following conditions are met [[1]] redistributions of source code must retain the above copyright notice"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that
     the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions
     and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions
     and the following disclaimer in the documentation and or other materials provided with the distribution
     [[3]] [[neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this
     software without specific prior written permission]] THIS SOFTWARE IS PROVIDED BY THE {{10}} AS IS AND ANY EXPRESS OR IMPLIED
     WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
     DISCLAIMED IN NO EVENT SHALL THE {{10}} BE LIABLE FOR ANY DIRECT INDIRECT INCIDENTAL SPECIAL EXEMPLARY OR CONSEQUENTIAL DAMAGES
     INCLUDING BUT NOT LIMITED TO PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES LOSS OF USE DATA OR PROFITS OR BUSINESS INTERRUPTION HOWEVER
     CAUSED AND ON ANY THEORY OF LIABILITY WHETHER IN CONTRACT STRICT LIABILITY OR TORT INCLUDING NEGLIGENCE OR OTHERWISE ARISING IN ANY
     WAY OUT OF THE USE OF THIS SOFTWARE EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
     granted provided that the above copyright notice and this permission notice appear in all copies
     [[THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
     OF MERCHANTABILITY AND FITNESS IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DIRECT INDIRECT OR CONSEQUENTIAL DAMAGES OR ANY
     DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE DATA OR PROFITS WHETHER IN AN ACTION OF CONTRACT NEGLIGENCE OR OTHER TORTIOUS ACTION
     ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE]]"""),
    ("mpl-2", """subject to the terms of the Mozilla Public License v 2 0 [[if a copy of the MPL was not distributed with this file you can
     obtain one at {{6}} MPL 2 0]]"""),
    ("unlicense", """this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile
     sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and
     by any means]]"""),
    ("proprietary", "all rights reserved {{8}} may not be reproduced [[distributed]] [[or transmitted]]"),
]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Automaton:
    """States are places in the wording. `step[s]`: word to take on; `skip[s]`: places reachable free."""

    def __init__(self, template: str):
        self.step: list[tuple[str | None, int]] = []  # (word or None for any, next state)
        self.skip: list[list[int]] = [[]]
        parts = re.split(r"(\[\[|\]\]|\{\{\d+\}\})", template)
        opened: list[int] = []
        for part in parts:
            if part == "[[":
                opened.append(len(self.step))
            elif part == "]]":
                self.skip[opened.pop()].append(len(self.step))
            elif part.startswith("{{"):
                n, first = int(part[2:-2]), len(self.step)
                for _ in range(n):
                    self._add(None)
                for s in range(first, first + n):
                    self.skip[s].append(first + n)
            else:
                for word in words_of(part):
                    self._add(word)
        if opened:
            raise ValueError("[[ without ]]")
        if parts[-1].strip() == "" and len(parts) > 1 and parts[-2].startswith("{{"):
            raise ValueError("a template does not end with {{n}}, which would take words that follow it")
        self.end = len(self.step)
        self.head = [w for w, _ in self.step[:3]]
        if len(self.head) < 3 or None in self.head or any(self.skip[:3]):
            raise ValueError("a template starts with three fixed words")

    def _add(self, word: str | None) -> None:
        self.step.append((word, len(self.step) + 1))
        self.skip.append([])

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accept(self, words, at: int, end: int) -> int:
        """The end of the longest accepted run of words[at:end], or -1."""
        states, best = self._closure({0}), -1
        while True:
            if self.end in states:
                best = at
            if at >= end or not states:
                return best
            word = words[at]
            states = self._closure({t for s in states if s < self.end for w, t in [self.step[s]] if w is None or w == word})
            at += 1


@lru_cache(None)
def _compiled() -> tuple[list[tuple[str, Automaton, np.ndarray]], list[tuple[str, np.ndarray]]]:
    autos = []
    for label, template in TEMPLATES:
        a = Automaton(template)
        autos.append((label, a, hash_words([w.encode() for w in a.head])))
    return autos, [(label, hash_words([w.encode() for w in phrase.split()])) for phrase, label in PHRASES.items()]


def _places(hashes: np.ndarray, last: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase stands; last[i]: the end of the text of word i."""
    n = len(hashes) - len(phrase) + 1
    if n < 1:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(hashes[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[hashes[at + k] == phrase[k]]
    return at[at + len(phrase) <= last[at]]


_OUT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "matches array<struct<label:string,lo:long,hi:long>>"
)
_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))


def _scan(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos, phrases = _compiled()
        for batch in batches:
            for lo, hi in slices(batch.column(keep)):
                w = Words(batch.column(keep).slice(lo, hi - lo), ALNUM)
                text = w.text_of()
                last = w.first[1:][text] if len(text) else text
                base: dict[int, list] = {}
                more: dict[int, list] = {}
                for label, phrase in phrases:
                    for at in _places(w.hash, last, phrase).tolist():
                        d = int(text[at])
                        base.setdefault(d, []).append((at - int(w.first[d]), len(phrase), label))
                for label, auto, head in autos:
                    for at in _places(w.hash, last, head).tolist():
                        d = int(text[at])
                        span = _Lazy(w)
                        end = auto.accept(span, at, int(w.first[d + 1]))
                        if end >= 0:
                            more.setdefault(d, []).append((at - int(w.first[d]), end - at, label))
                cols: list[list] = [[], [], [], [], [], []]
                for d in range(hi - lo):
                    b, m = base.get(d, []), more.get(d, [])
                    starts = [x[0] for x in b]
                    cols[0].append(len(b))
                    cols[1].append(min(starts) if b else None)
                    cols[2].append(max(starts) if b else None)
                    cols[3].append(sorted({x[2] for x in b}))
                    cols[4].append(sorted({x[2] for x in b + m}))
                    cols[5].append([{"label": x[2], "lo": x[0], "hi": x[0] + x[1]} for x in sorted(b + m)])
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), _MATCHES)
                yield pa.record_batch(
                    [batch.column(c).slice(lo, hi - lo) for c in range(keep)]
                    + [pa.array(w.counts.astype(np.int64))]
                    + [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                    names=[*batch.schema.names[:keep], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "matches"],
                )

    return run


class _Lazy:
    """Words of a Words object as strings, made when asked for."""

    def __init__(self, w: Words):
        self.w = w

    def __getitem__(self, i: int) -> str:
        return self.w.data[self.w.start[i] : self.w.end[i]].tobytes().decode("utf-8", "replace")


def scan_licenses(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, counts, labels (arrays) and the matched word ranges."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(_scan(len(keep)), f"{fields}, {_OUT}")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    covered = F.aggregate(
        "matches",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, m: F.struct(
            (a["n"] + F.greatest(m["hi"] - F.greatest(m["lo"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], m["hi"]).alias("end")
        ),
        lambda a: a["n"],
    )
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
