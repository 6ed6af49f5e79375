"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a run of a text's words, however wrapped, of at most 1 / 0.8 times the template's number of words. It matches a
template if it holds at least 0.8 of the template's distinct five-word shingles; pieces farther apart are no block. Shingles
are the tokens of the join, ordered by their number in the whole corpus, rarest first. A text with a matching block shares
a shingle with the template's prefix (prefix filter), has enough words (length filter), and from the first shared shingle on enough of
both remain (positional filter). In texts that pass, the shared shingles' places are walked over once with two ends:
the run is extended while it is short enough, and the best one is kept. Templates are a fixed table; the order needs one
count over all documents of the templates' shingles alone. Shingles and phrases are found by a trie of their words, walked from
all words of a batch of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_bounded, text_or_empty, whole_id
from lodestar.llm.textnum import FOLD, batches

WIDTH, THRESHOLD = 5, 0.8
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences and whole texts of the licenses and of their notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-whole-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
        OF THIS SOFTWARE.""",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "mit-notice": "Released under the MIT License.",
}
_TABLE = bytes(FOLD[k] or 32 for k in range(256))
#: Stands behind each text; no word holds it.
_END = b"\x00"


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; runs of ASCII letters, digits and all other characters beyond ASCII."""
    return folded(text).split()


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def shingle_set(ws: list[bytes], width: int = WIDTH) -> set[bytes]:
    """Runs of `width` words; of fewer words their one run."""
    if not ws:
        return set()
    return {b" ".join(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))}


class Finder:
    """Finds runs of words in many texts at once: a trie of the runs, walked from all words side by side."""

    def __init__(self, runs: list[bytes]):
        split = [r.split(b" ") for r in runs]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in split for w in ws}), 1)}
        self.end = self.vocabulary[_END] = len(self.vocabulary) + 1
        nodes: dict[tuple[int, int], int] = {}
        term = {}
        for number, ws in enumerate(split):
            node = 0
            for w in ws:
                node = nodes.setdefault((node, self.vocabulary[w]), len(nodes) + 1)
            term[node] = number
        #: the children of the root by word; all nodes by their parent and word, behind them a key that is never asked for
        self.root = np.zeros(self.end + 1, dtype=np.int64)
        for (parent, w), node in nodes.items():
            if not parent:
                self.root[w] = node
        keys = np.array([parent * (self.end + 1) + w for parent, w in nodes] + [np.iinfo(np.int64).max], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array([*nodes.values(), 0], dtype=np.int64)[order]
        self.term = np.full(len(nodes) + 1, -1, dtype=np.int64)
        self.term[list(term)] = list(term.values())

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text; of each place where a run stands, by text and word: text, first word, run."""
        ws = (b" " + _END + b" ").join([*(folded(t) for t in texts), b""]).split()
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(0)), dtype=np.int32, count=len(ws))
        del ws
        ends = np.flatnonzero(ids == self.end)
        starts = np.concatenate(([0], ends + 1))[: len(texts)]
        at = np.flatnonzero(self.root[ids])
        node, found, depth = self.root[ids[at]], [(at[:0], at[:0])], 0
        while len(at):
            run = self.term[node]
            found.append((at[run >= 0], run[run >= 0]))
            depth += 1
            key = node * (self.end + 1) + ids[at + depth]  # the word before is none of the ends, so one more stands there
            k = np.searchsorted(self.keys, key)
            go = self.keys[k] == key
            at, node = at[go], self.nodes[k[go]]
        place, run = map(np.concatenate, zip(*found))
        order = np.argsort(place, kind="stable")
        place, run = place[order], run[order]
        of = np.searchsorted(ends, place)
        return ends - starts, of, place - starts[of] if len(of) else of, run


class Index:
    """Templates' shingles in the global order, with their prefixes."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, frequency: dict[bytes, int] | None = None, threshold: float = THRESHOLD):
        frequency = frequency or {}
        self.threshold = threshold
        self.sets = {name: shingle_set(words(t)) for name, t in templates.items()}
        tokens = sorted({s for v in self.sets.values() for s in v}, key=lambda s: (frequency.get(s, 0), s))
        self.tokens = tokens
        self.rank = {s: k for k, s in enumerate(tokens)}
        self.need = {name: max(1, int(np.ceil(threshold * len(v) - 1e-9))) for name, v in self.sets.items()}
        self.prefix: dict[bytes, list[tuple[str, int]]] = {}
        self.ordered = {name: sorted(v, key=self.rank.__getitem__) for name, v in self.sets.items()}
        for name, order in self.ordered.items():
            for k, s in enumerate(order[: len(order) - self.need[name] + 1]):
                self.prefix.setdefault(s, []).append((name, k))
        self.longest = {name: max(len(ws), int(len(ws) / threshold + 1e-9)) for name, ws in ((name, words(t)) for name, t in templates.items())}
        self.holders: dict[bytes, list[str]] = {}
        for name, v in self.sets.items():
            for x in v:
                self.holders.setdefault(x, []).append(name)
        self.finder = Finder(tokens)

    def match(self, found: set[bytes]) -> dict[str, float]:
        """Containment of each template that reaches the threshold in a block with these shingles."""
        mine = sorted((self.rank[s], s) for s in found if s in self.rank)
        out: dict[str, float] = {}
        tried: set[str] = set()
        for at, (_, s) in enumerate(mine):
            for name, k in self.prefix.get(s, ()):
                if name in tried:
                    continue
                tried.add(name)  # the first shared shingle in the global order
                left = 1 + min(len(mine) - at - 1, len(self.ordered[name]) - k - 1)
                if len(mine) < self.need[name] or left < self.need[name]:
                    continue
                share = len(self.sets[name] & found)
                if share >= self.need[name]:
                    out[name] = share / len(self.sets[name])
        return out


def blocks(text: str, index: Index) -> dict[str, tuple[float, int, int]]:
    """For each template that a block matches: the best containment, the first word and the end (exclusive) of the block.

    Of several blocks of the best containment the shortest counts, then the first.
    """
    _, _, at, run = index.finder.find([text])
    return blocks_of([(k, index.tokens[r]) for k, r in zip(at.tolist(), run.tolist())], index)


def blocks_of(shingles: list[tuple[int, bytes]], index: Index) -> dict[str, tuple[float, int, int]]:
    """blocks() of a text, from its templates' shingles with their first words."""
    places: dict[str, list[tuple[int, int, bytes]]] = {}
    for k, x in shingles:
        for name in index.holders[x]:
            places.setdefault(name, []).append((k, k + x.count(b" ") + 1, x))
    found = {x for _, x in shingles}
    out = {}
    for name in index.match(found):
        best: tuple[int, int, int] | None = None  # shingles missing, words, first word
        held: dict[bytes, int] = {}
        run, left = sorted(places[name]), 0
        for start, end, x in run:
            held[x] = held.get(x, 0) + 1
            while end - run[left][0] > index.longest[name] or held[run[left][2]] > 1:  # too long, or its first shingle comes again
                gone = run[left][2]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                left += 1
            if len(held) >= index.need[name]:
                here = (-len(held), end - run[left][0], run[left][0])
                best = here if best is None else min(best, here)
        if best is not None:
            out[name] = (-best[0] / len(index.sets[name]), best[2], best[2] + best[1])
    return out


def template_counts(rows: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[bytes, int]:
    """How often each of the templates' shingles stands in all texts; the templates bound its size."""
    tokens = sorted({s for t in templates.values() for s in shingle_set(words(t))})
    finder = Finder(tokens)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(tokens), dtype=np.int64)
        for pdf in batches(frames):
            total += np.bincount(finder.find(pdf["text"].tolist())[3], minlength=len(tokens))
        yield pd.DataFrame({"token": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]})

    got = rows.mapInPandas(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    return {tokens[t]: int(n) for t, n in zip(got["token"], got["n"])}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For every row: doc_id (long), n_words, n_base, first_word, last_word, base_labels, labels, score, templates, blocks.

    score: 1 with a phrase, else the best containment of a matching template, else 0. Labels of templates join those of
    phrases; `templates` lists name=containment, `blocks` name:start-end in words from 0, end exclusive. Null text counts as empty: no words, no labels (empty strings), null
    first and last word. A text without line ends is one line, however long. Repeated rows each get their row, null ids
    stay null, an empty table gives an empty result; rows are independent, without a shuffle of texts. Other columns are
    dropped.
    """
    rows = arrow_bounded(docs.select(whole_id(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")))
    index = Index(templates, template_counts(rows, templates), threshold)
    phrases = {p.encode(): label for p, label in PHRASES.items()}

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = [*index.tokens, *(p for p in phrases if p not in index.rank)]
        label_of = {k: phrases[x] for k, x in enumerate(runs) if x in phrases}
        is_phrase, is_prefix = (np.array([x in some for x in runs], dtype=bool) for some in (phrases, index.prefix))
        finder = Finder(runs)
        for pdf in batches(frames):
            n_words, of, at, run = finder.find(pdf["text"].tolist())
            places: dict[int, list[tuple[int, str]]] = {}
            for k, first, r in zip(*(x[is_phrase[run]].tolist() for x in (of, at, run))):
                places.setdefault(k, []).append((first, label_of[r]))
            matched = {}
            for k in np.unique(of[is_prefix[run]]).tolist():  # a text with a block that matches holds a prefix shingle
                mine = slice(*np.searchsorted(of, (k, k + 1)))
                matched[k] = blocks_of([(first, runs[r]) for first, r in zip(at[mine].tolist(), run[mine].tolist()) if r < len(index.tokens)], index)
            out = []
            for k, (doc, n) in enumerate(zip(pdf["doc_id"], n_words.tolist())):
                here, found = places.get(k, []), matched.get(k, {})
                base = sorted({label for _, label in here})
                labels = sorted({*base, *found})
                score = 1.0 if base else max((share for share, _, _ in found.values()), default=0.0)
                first, last = (here[0][0], here[-1][0]) if here else (None, None)
                out.append((doc, n, len(here), first, last, ",".join(base), ",".join(labels), round(score, 9), ",".join(f"{n}={s:.4f}" for n, (s, _, _) in sorted(found.items())), ",".join(f"{n}:{a}-{b}" for n, (_, a, b) in sorted(found.items()))))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates", "blocks"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return rows.mapInPandas(scan, "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates string, blocks string").withColumn("doc_id", F.col("doc_id").cast("long"))
