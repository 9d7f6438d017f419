"""License scans: template markup compiled into token automata.

A template is license wording with two kinds of marked regions: <<beginOptional>> ... <<endOptional>>
may be missing, also one inside another, and <<var;name="...";original="...";match="...">> stands for other words: .{a,b} for a to b of
them, .+ for one or more, .* for any number. Everything else is mandatory and must appear word for word,
in order. A template is compiled once into an automaton over words: states are places in the wording,
optional regions add empty moves, replaceable ones loop. All of a text's places are tried in one pass over its words: a run starts
at each mandatory first word, and of runs that meet in a state the earliest goes on. A text is accepted where a run reaches
the end; of acceptances that overlap the one from the earliest start to its last end is told.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.

Base phrases are counted at every place where their words stand consecutively. The templates cover the whole wording of MIT, BSD-2-Clause,
BSD-3-Clause, ISC, zlib, BSL-1.0 and the Unlicense, the notices that Apache-2.0, GPL, LGPL, AGPL and MPL ask to be put into files,
and usual one-line references.

Defined results: a null text counts as the empty one: no words, no labels, score 0. The score is 1 if a template accepts some part of
the text, 0.5 if there is but a base phrase, else 0. Rows are taken one by one, repeats too; other columns are kept, those named like outputs are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of public licenses and notices, with markup.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="software";original="this software and associated documentation files";match=".{1,12}">> (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. '
MIT_REST = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE'
BSD_TERMS = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
BSD_NAMES = '<<beginOptional>>3. <<endOptional>>Neither the name of <<var;name="holder";original="the copyright holder";match=".+">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. '
BSD_REST = 'THIS SOFTWARE IS PROVIDED BY <<var;name="holders";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE'
NO_WARRANTY = ' is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.'
TEMPLATES = {
    "MIT": [
        'released under the MIT License',
        'licensed under the <<beginOptional>>terms of the <<endOptional>>MIT License',
        MIT_GRANT + MIT_REST,
    ],
    "Apache-2.0": [
        'licensed under the Apache License, Version 2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name="where";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,8}">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.<<endOptional>>',
        'released under the Apache License, <<beginOptional>>Version <<endOptional>>2.0',
    ],
    "GPL-3.0": [
        'licensed under the GNU General Public License, version 3',
        'released under the <<beginOptional>>GNU <<endOptional>>General Public License, <<beginOptional>>version <<endOptional>>3',
        'is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License<<beginOptional>>, or (at your option) any later version<<beginOptional>>. <<var;name="program";original="This program";match=".{1,12}">>' + NO_WARRANTY + '<<endOptional>><<endOptional>>',
    ],
    "GPL-2.0": [
        'licensed under the GNU General Public License, version 2',
        'is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; <<beginOptional>>either <<endOptional>>version 2 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>',
    ],
    "LGPL-3.0": [
        'licensed under the GNU Lesser General Public License, version 3',
        'is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>',
    ],
    "LGPL-2.1": [
        'licensed under the GNU Lesser General Public License, version 2.1',
        'is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>',
    ],
    "AGPL-3.0": [
        'licensed under the GNU Affero General Public License, version 3',
        'is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>',
    ],
    "MPL-2.0": [
        'subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<beginOptional>><<var;name="scheme";original="http";match=".{1,1}">> <<endOptional>>mozilla.org/MPL/2.0',
        'licensed under the Mozilla Public License, <<beginOptional>>version <<endOptional>>2.0',
    ],
    "BSD-2-Clause": [BSD_TERMS + BSD_REST],
    "BSD-3-Clause": [BSD_TERMS + BSD_NAMES + BSD_REST],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="liable";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE',
    ],
    "Zlib": [
        'This software is provided \'as-is\', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1. <<endOptional>>The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2. <<endOptional>>Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3. <<endOptional>>This notice may not be removed or altered from any source distribution',
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor',
        'Distributed under the Boost Software License, Version 1.0',
    ],
    "CC-BY": ['licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons Attribution <<endOptional>>CC BY 4.0', 'licensed under a Creative Commons Attribution 4.0 International License'],
    "CC-BY-SA": ['licensed under <<beginOptional>>a Creative Commons Attribution ShareAlike <<endOptional>>CC BY-SA 4.0', 'licensed under a Creative Commons Attribution-ShareAlike 4.0 International License'],
    "CC-BY-NC": ['licensed under <<beginOptional>>a Creative Commons Attribution NonCommercial <<endOptional>>CC BY-NC 4.0', 'licensed under a Creative Commons Attribution-NonCommercial 4.0 International License'],
    "Unlicense": [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means',
    ],
    "All-Rights-Reserved": ['All rights reserved<<beginOptional>>. No part of this <<var;name="what";original="publication";match=".{1,4}">> may be reproduced<<endOptional>>'],
}

#: ASCII bytes that are no letter or digit become blanks, capitals small; other bytes are parts of words.
FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Automaton:
    """States 0..n over words: on[s] = word that leads to s + 1, None for a replaceable region, wild[s] = (least, most words there or None);
    skips[s] = states entered from s without a word."""

    def __init__(self, template: str):
        self.on: list[bytes | None] = []
        self.skips: dict[int, list[int]] = {}
        self.wild: dict[int, tuple[int, int | None]] = {}
        opened: list[int] = []
        inside: set[int] = set()
        for part in re.split(r"(<<.*?>>)", template):
            if part.lower().startswith("<<beginoptional"):
                opened.append(len(self.on))
            elif part.lower().startswith("<<endoptional"):
                if not opened:
                    raise ValueError(f"a region is closed that isn't open: {template[:60]}")
                start = opened.pop()
                self.skips.setdefault(start, []).append(len(self.on))
                inside.update(range(start, len(self.on)))
            elif part.lower().startswith("<<var"):
                m = re.search(r'match="\.(?:\{(\d+),(\d+)\}|([+*]))"', part)
                if not m or m[1] and int(m[1]) > int(m[2]):
                    raise ValueError(f"a replaceable region is .{{a,b}}, .+ or .*: {part}")
                self.wild[len(self.on)] = (int(m[1]), int(m[2])) if m[1] else (int(m[3] == "+"), None)
                self.on.append(None)
            else:
                self.on += words_of(part)
        if opened or not self.on or self.on[0] is None or 0 in inside:
            raise ValueError(f"a template starts with a mandatory word and closes its regions: {template[:60]}")
        self.first, self.end = self.on[0], len(self.on)
        #: The longest words that every accepted text holds.
        self.need = sorted({w for i, w in enumerate(self.on) if w is not None and i not in inside}, key=lambda w: (-len(w), w))[:3]

    def _close(self, states: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
        """With the states reached by empty moves. A state is (place, words taken there), its value the earliest start of a run there."""
        todo = list(states)
        while todo:
            s, k = state = todo.pop()
            start = states[state]
            more = [(t, 0) for t in self.skips.get(s, ())] if k == 0 else []
            if s in self.wild and k >= self.wild[s][0]:
                more.append((s + 1, 0))
            for x in more:
                if states.get(x, start + 1) > start:
                    states[x] = start
                    todo.append(x)
        return states

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of every acceptance, of those that overlap the one from the earliest start to its last end."""
        found: dict[int, int] = {}
        states: dict[tuple[int, int], int] = {}
        i, n = 0, len(words)
        while True:
            if (start := states.get((self.end, 0))) is not None:
                found[start] = i
            if not states:
                try:
                    i = words.index(self.first, i)
                except ValueError:
                    break
            if i == n:
                break
            w, now = words[i], {}
            states.setdefault((0, 0), i)
            for (s, k), start in states.items():
                if s == self.end:
                    continue
                if s in self.wild:
                    least, most = self.wild[s]
                    if most is not None and k >= most:
                        continue
                    x = (s, k + 1 if most is not None or k < max(1, least) else k)  # of any number, only whether it is enough counts
                elif self.on[s] == w:
                    x = (s + 1, 0)
                else:
                    continue
                if now.get(x, start + 1) > start:
                    now[x] = start
            states = self._close(now)
            i += 1
        out: list[tuple[int, int]] = []
        for start, end in sorted(found.items()):
            if not out or start >= out[-1][1]:
                out.append((start, end))
        return out


def compile_templates(templates: dict[str, list[str]] | None = None) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, texts in (TEMPLATES if templates is None else templates).items() for t in texts]


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at, n = [], 0, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at)
            if words[at : at + n] == phrase:
                out.append(at)
            at += 1
    except ValueError:
        return out


def scan_text(text: str | None, compiled, base: dict[str, str]) -> tuple:
    """(n_words, starts of base phrases, base labels, [(label, start, end)]) of one whole text."""
    raw = (text or "").encode().translate(FOLD)
    words = raw.split()
    starts, labels = [], set()
    for phrase, label in base.items():
        p = phrase.encode().split()
        if max(p, key=len) in raw and (found := places(words, p)):
            starts += found
            labels.add(label)
    spans = []
    for label, a in compiled:
        if all(w in raw for w in a.need):
            spans += [(label, i, e) for i, e in a.spans(words)]
    return len(words), sorted(starts), labels, spans


def scan_licenses(df: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Every row with n_words, base_starts, base_labels, labels, spans (label, first word, word after the last) and score. One pass, no shuffle."""
    base = BASE if base is None else base
    compiled = compile_templates(templates)
    new = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("base_starts", T.ArrayType(T.LongType())), T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]))), T.StructField("score", T.DoubleType()),
    ])
    names = [c for c in df.columns if c not in new.names or c == text]
    kept = df.select(*map(col, names))
    carried = [f for f in kept.schema.fields if f.name not in new.names]
    at = names.index(text)

    def run(batches):
        for batch in batches:
            n, starts, bases, labels, spans, score = [], [], [], [], [], []
            for t in batch.column(at):
                k, s, b, sp = scan_text(t.as_py(), compiled, base)
                n.append(k)
                starts.append(s)
                bases.append(sorted(b))
                labels.append(sorted(b | {x[0] for x in sp}))
                spans.append([{"label": x, "first": i, "after": e} for x, i, e in sp])
                score.append(1.0 if sp else 0.5 if b else 0.0)
            old = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in new.names]
            span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*old, pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(bases, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())), pa.array(spans, span), pa.array(score, pa.float64())], names=[*(f.name for f in carried), *new.names])

    return kept.mapInArrow(run, T.StructType([*carried, *new.fields]))
