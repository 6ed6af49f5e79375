"""SentencePiece BPE encoding and decoding as a max-plus scan.

A piece sequence is the BPE encoding of its text exactly if every two neighbours are: encoding the two pieces'
joined text gives the two back. So the encoding is the one path of weight 0 in a lattice whose arcs weigh 0 for
such neighbours and minus infinity otherwise. A state at a text position is the piece that covers the character
before it. A chunk of text yields the max-plus transfer matrix from the states at its left edge to those at its
right edge; the product of matrices is associative, so chunks are evaluated in parallel, their products scanned,
and each chunk is backtraced alone once its two edge states are known.

No piece of a vocabulary spans certain character pairs (a letter and a following space mark, say). Between such a
pair every path is in the same state, the matrix there has rank one, and the stretch between two such cuts (a word)
has one encoding whatever surrounds it; those are memoised. Runs of two or more space marks merge only among
themselves and have equal scores, left first; they are encoded by that rule and never hold an edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_bounded, stash, text_or_empty, whole_id

SPACE = "▁"
NEG = -np.inf
#: Characters of a chunk of a giant document.
CHUNK = 32_768
#: Words memoised per worker; beyond it the memo is dropped and fills anew.
MEMO = 400_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_LOADED: dict[str, "Pieces"] = {}


def load(path: str = MODEL) -> "Pieces":
    if path not in _LOADED:
        _LOADED[path] = Pieces.from_file(path)
    return _LOADED[path]


class Pieces:
    """A BPE vocabulary: piece text to id and merge score, ids of bytes, and the lattice over it."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int, texts: list[str]):
        self.scores, self.byte_ids, self.unknown, self.texts = scores, byte_ids, unknown, texts
        self.longest = max(map(len, scores), default=1)
        inside = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.inside = inside - {SPACE * 2}
        #: words by number; the ids of number k are known[firsts[k] : firsts[k] + sizes[k]]
        self.memo: dict[str, int] = {}
        self.known, self.firsts, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.usable: dict[str, bool] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        byte_of = {b: i for i, b in enumerate(byte_ids)}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else t.encode() for i, t in enumerate(texts)]
        self.table: Table | None = None
        self.words: re.Pattern | None = None

    @classmethod
    def from_file(cls, path: str) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        skip = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        scores = {t: (i, sp.get_score(i)) for i, t in enumerate(texts) if not skip[i]}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(scores, byte_ids if sp.is_byte(byte_ids[0]) else [], sp.unk_id(), texts)

    # -- the plain definition, for neighbours and as the tests' yardstick

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: again and again the best-scored neighbouring pair, left first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = self.scores.get(parts[i] + parts[i + 1])
                if got and (best is None or got[1] > best):
                    best, at = got[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joined(self, a: str, b: str) -> bool:
        """Weight of the arc between neighbours: True for 0, False for minus infinity."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            if a[-1] + b[0] not in self.inside and not a[-1] == b[0] == SPACE:
                got = True
            elif a[:2] == SPACE * 2 or b[:2] == SPACE * 2 or a == b == SPACE:
                got = self.merge(a + b) == [a, b]
            else:
                got = self.seam(a, b)
            self.pairs[key] = got
        return got

    def seam(self, a: str, b: str) -> bool:
        """Undo the merges at the seam from the last to the first: no two symbols that met there would have merged.

        Two symbols that stand at the seam at one time merge if their piece is better than those that they went into;
        of equal pieces the left one merges first.
        """
        scores, best_a, best_b = self.scores, -np.inf, -np.inf
        while True:
            got = scores.get(a + b)
            if got and got[1] > best_a and got[1] >= best_b:
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            if len(b) == 1 or (len(a) > 1 and scores[a][1] < scores[b][1]):
                best_a, a = scores[a][1], self.halves(a)[1]
            else:
                best_b, b = scores[b][1], self.halves(b)[0]

    def halves(self, piece: str) -> tuple[str, str]:
        """The two parts that the piece's last merge joins."""
        got = self.parts.get(piece)
        if got is None:
            got = self.parts[piece] = self._halves(piece)
        return got

    def _halves(self, piece: str) -> tuple[str, str]:
        parts = list(piece)
        while len(parts) > 2:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s and s[1] > best:
                    best, at = s[1], i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def can_use(self, piece: str) -> bool:
        """Whether the piece is its own encoding."""
        got = self.usable.get(piece)
        if got is None:
            got = self.usable[piece] = len(piece) == 1 or (piece in self.scores and self.merge(piece) == [piece])
        return got

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            got = self.scores.get(p)
            if got:
                out.append(got[0])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    # -- the lattice

    def cuts(self, text: str) -> list[int]:
        """Positions that no piece spans, but not within a run of space marks."""
        inside = self.inside
        return [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside and not (text[i - 1] == text[i] == SPACE)]

    def walk(self, text: str, first: str | None, start: int, end: int) -> list[list[tuple[str, int]]]:
        """For each position from start to end the pieces that end a path of weight 0 there, with where they start.

        first: the piece that ends at start, None at a cut.
        """
        ends: list[list[tuple[str, int]]] = [[] for _ in range(end - start + 1)]
        scores, longest = self.scores, self.longest
        for j in range(start + 1, end + 1):
            found = ends[j - start]
            for i in range(j - 1, max(start, j - longest) - 1, -1):
                before = ends[i - start]
                if not before and i > start:
                    continue
                p = text[i:j]
                if (j - i > 1) and (p not in scores or not self.can_use(p)):
                    continue
                if i == start:
                    if first is None or self.joined(first, p):
                        found.append((p, i))
                elif any(self.joined(q, p) for q, _ in before):
                    found.append((p, i))
        return ends

    def trace(self, ends: list[list[tuple[str, int]]], start: int, last: str, at: int) -> list[str]:
        """Back from the piece that starts at `at` (exclusive) to start: the pieces in text order."""
        out: list[str] = []
        nxt = last
        while at > start:
            p, i = next((q, i) for q, i in ends[at - start] if nxt is None or self.joined(q, nxt))
            out.append(p)
            at, nxt = i, p
        return out[::-1]

    def spaces(self, n: int) -> list[str]:
        """A run of space marks by leftmost merging of equal scores: the front grows while the longer run is a piece."""
        out: list[str] = []
        most = max((k for k in range(1, self.longest + 1) if SPACE * k in self.scores), default=1)
        steps = all(SPACE * k in self.scores for k in range(1, most + 1))
        if not steps:
            return self.merge(SPACE * n)
        while n > 0:
            out.append(SPACE * min(n, most))
            n -= min(n, most)
        return out

    def word(self, text: str) -> list[str]:
        """The encoding of a stretch between two cuts."""
        n = len(text) - len(text.lstrip(SPACE))
        if n > 1:
            rest = self.word(text[n - 1 :]) if n < len(text) else []
            if not rest:
                return self.spaces(n)
            lone = rest[0] == SPACE
            return self.spaces(n - (not lone)) + rest[lone:]
        if len(text) == 1:
            return [text]
        return self.trace(self.walk(text, None, 0, len(text)), 0, None, len(text))

    def stretch(self, text: str) -> list[int]:
        """Ids of text between two cuts that may hold further cuts."""
        return self.stretches([text])[0].tolist()

    def stretches(self, texts: list[str]) -> list[np.ndarray]:
        """stretch() of many texts: the words not yet known are encoded together."""
        if not texts:
            return []
        words = [self.split(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.known, self.firsts, self.sizes = self.known[:0].copy(), self.firsts[:0].copy(), self.sizes[:0].copy()
        self.learn(list(set().union(*words).difference(self.memo)))
        ends = np.cumsum([len(ws) for ws in words])
        number = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=ends[-1])
        size = self.sizes[number]
        behind = np.concatenate(([0], np.cumsum(size)))
        ids = self.known[np.arange(behind[-1]) + np.repeat(self.firsts[number] - behind[:-1], size)]
        return np.split(ids, behind[ends[:-1]])

    def learn(self, new: list[str]) -> None:
        """Put the encodings of words not yet known into the memo."""
        if not new:
            return
        if self.table is None:
            self.table = Table(self)
        known, firsts, sizes, end = [self.known], [self.firsts], [self.sizes], len(self.known)
        for words, ids, size in chain(self.table.encode(new), self._others(new)):
            self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words))))
            known.append(ids)
            firsts.append(end + np.cumsum(size) - size)
            sizes.append(size)
            end += len(ids)
        self.known, self.firsts, self.sizes = np.concatenate(known), np.concatenate(firsts), np.concatenate(sizes)

    def _others(self, new: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """The words that the table has left, as Table.encode() returns them."""
        words = [w for w in new if w not in self.memo]
        ids: list[int] = []
        sizes = []
        for w in words:
            before = len(ids)
            edges = [0, *self.cuts(w), len(w)]
            for a, b in zip(edges, edges[1:]):
                ids += self.ids(self.word(w[a:b]))
            sizes.append(len(ids) - before)
        yield words, np.array(ids, dtype=np.int32), np.array(sizes, dtype=np.int64)

    def _words(self) -> re.Pattern:
        """Matches stretches between cuts: at space marks, and between Latin letters and all else where no piece spans them."""
        letters = "a-zA-Z\u00c0-\u024f"
        kind = re.compile(f"[{letters}]")
        if any(p[1] == SPACE for p in self.inside):
            return re.compile(r"(?s).+")
        if any(p[0] != SPACE and bool(kind.match(p[0])) != bool(kind.match(p[1])) for p in self.inside):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"{SPACE}*[{letters}]+|{SPACE}*[^{letters}{SPACE}]+|{SPACE}+")

    def split(self, text: str) -> list[str]:
        """Words: stretches that end at cuts."""
        if self.words is None:
            self.words = self._words()
        return self.words.findall(text)

    # -- chunks

    def chunks(self, text: str, size: int = CHUNK) -> list[tuple[int, int]]:
        """[start, end) of each chunk; an edge inside a run of space marks moves to behind the run."""
        edges, at = [0], size
        while at < len(text):
            if text[at] == SPACE or text[at - 1] == SPACE:
                while at < len(text) and text[at] == SPACE:
                    at += 1
                at += 1  # the mark may join the character behind it, so the edge moves past that too
            if at < len(text):
                edges.append(at)
            at += size
        return list(zip(edges, [*edges[1:], len(text)]))

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces that cover the character before `at` as (start, end); at the text's ends the one empty state."""
        if at <= 0 or at >= len(text):
            return [(at, at)]
        out = []
        for i in range(max(0, at - self.longest), at):
            for j in range(at, min(len(text), i + self.longest) + 1):
                if j - i == 1 or (text[i:j] in self.scores and self.can_use(text[i:j])):
                    out.append((i, j))
        return out

    def _last_cut(self, text: str, lo: int, hi: int) -> int | None:
        """The last cut in [lo, hi], but none that a run of space marks would touch from the left."""
        inside = self.inside
        for i in range(hi, lo - 1, -1):
            if 0 < i < len(text) and text[i - 1 : i + 1] not in inside and not (text[i - 1] == text[i] == SPACE):
                return i
        return None

    def _first_cut(self, text: str, lo: int, hi: int) -> int | None:
        inside = self.inside
        for i in range(lo, hi + 1):
            if 0 < i < len(text) and text[i - 1 : i + 1] not in inside and not (text[i - 1] == text[i] == SPACE):
                return i
        return None

    def _ways(self, text: str, first: tuple[int, int], stop: int, outs: list[tuple[int, int]], whole: bool) -> list[float]:
        """Weights from the state `first` to each of outs, without a cut between."""
        start = first[1]
        lead = text[first[0] : first[1]] or None
        ends = self.walk(text, lead, start, max([stop, *(i for i, _ in outs), start]))
        row = []
        for i, j in outs:
            if (i, j) == first:
                row.append(0.0)
            elif i < start:
                row.append(NEG)
            else:
                p = text[i:j]
                if not p:
                    ok = i == start or bool(ends[i - start])
                elif i == start:
                    ok = lead is None or self.joined(lead, p)
                else:
                    ok = any(self.joined(q, p) for q, _ in ends[i - start])
                row.append(0.0 if ok else NEG)
        return row

    def matrix(self, text: str, a: int, b: int) -> np.ndarray:
        """Max-plus transfer from states(text, a) to states(text, b). text holds `longest` characters around [a, b)."""
        ins, outs = self.states(text, a), self.states(text, b)
        c1 = 0 if a == 0 else self._first_cut(text, a, b - 1)
        c2 = b if b == len(text) else self._last_cut(text, a, b - 1)
        if c1 is None or c2 is None or c1 > c2:
            return np.array([self._ways(text, s, b, outs, True) for s in ins])
        head = np.array([self._ways(text, s, c1, [(c1, c1)], False)[0] if s[1] <= c1 else NEG for s in ins])
        tail = np.array(self._ways(text, (c2, c2), b, outs, False))
        return head[:, None] + tail[None, :]

    def backtrace(self, text: str, a: int, b: int, enter: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Ids of the pieces that start in [enter's end, leave's end): those after enter, up to and with leave."""
        if enter == leave:
            return []
        lo, hi = enter[1], leave[0]
        lead = text[enter[0] : enter[1]] or None
        last = text[leave[0] : leave[1]] or None
        c1 = lo if lead is None else self._first_cut(text, lo, hi)
        c2 = hi if last is None else self._last_cut(text, lo, hi)
        if c1 is None or c2 is None or c1 > c2:
            mid = self.ids(self.trace(self.walk(text, lead, lo, hi), lo, last, hi))
        else:
            mid = self.ids(self.trace(self.walk(text, lead, lo, c1), lo, None, c1)) if c1 > lo else []
            mid += self.stretch(text[c1:c2])
            mid += self.ids(self.trace(self.walk(text, None, c2, hi), c2, last, hi)) if hi > c2 else []
        return mid + (self.ids([last]) if last else [])

    # -- whole texts

    @staticmethod
    def marked(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str, size: int = CHUNK) -> list[int]:
        """The whole scan on one text: matrices, their products from the left, backtraces."""
        t = self.marked(text)
        parts = self.chunks(t, size)
        if len(parts) <= 1:
            return self.stretch(t)
        mats = [self.matrix(t, a, b) for a, b in parts]
        route = scan(mats)
        edges = [self.states(t, 0), *(self.states(t, b) for _, b in parts)]
        out: list[int] = []
        for k, (a, b) in enumerate(parts):
            out += self.backtrace(t, a, b, edges[k][route[k]], edges[k + 1][route[k + 1]])
        return out

    def decode(self, ids) -> str:
        """Text of ids; byte pieces join to UTF-8, and the leading space mark goes."""
        s = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return s[1:] if s[:1] == " " else s


class Table:
    """The lattice's forward pass over many short words at once, in numpy.

    Pieces over the most frequent characters of the vocabulary stand in a dense trie. Weights of neighbours are kept
    in a hash table of fixed size. Words with other characters, and long ones, are left to Pieces.word(). Words of all
    lengths stand side by side, so that passes follow the longest piece and the longest word alone.
    """

    CHARS, LONGEST_WORD, SLOTS = 160, 40, 1 << 21
    #: Words of a pass.
    WORDS = 20_000

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        count: dict[str, int] = {}
        for p in pieces.scores:
            for c in p:
                count[c] = count.get(c, 0) + 1
        chars = sorted((c for c in count if ord(c) < 0x3000 and c in pieces.scores), key=lambda c: (-count[c], c))[: self.CHARS]
        self.codes = np.zeros(0x3000, dtype=np.int32)
        for k, c in enumerate(chars, 1):
            self.codes[ord(c)] = k
        known = set(chars)
        self.tokens = [p for p in pieces.scores if known.issuperset(p) and pieces.can_use(p)]
        self.token_ids = np.array([pieces.scores[p][0] for p in self.tokens], dtype=np.int32)
        rows: list[dict[int, int]] = [{}]
        term = [-1]
        for k, p in enumerate(self.tokens):
            node = 0
            for c in p:
                row, code = rows[node], int(self.codes[ord(c)])
                if code not in row:
                    row[code] = len(rows)
                    rows.append({})
                    term.append(-1)
                node = row[code]
            term[node] = k
        self.next = np.full((len(rows), len(chars) + 1), -1, dtype=np.int32)
        for k, row in enumerate(rows):
            if row:
                self.next[k, list(row)] = list(row.values())
        self.term = np.array(term, dtype=np.int32)
        self.keys = np.full(self.SLOTS, -1, dtype=np.int64)
        self.values = np.zeros(self.SLOTS, dtype=bool)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.tokens) + b
        slot = (key * 0x9E3779B1 >> 7) & (self.SLOTS - 1)
        miss = self.keys[slot] != key
        out = self.values[slot]
        if miss.any():
            asked, back = np.unique(key[miss], return_inverse=True)
            n, tokens, ask = len(self.tokens), self.tokens, self.pieces.joined
            got = np.array([ask(tokens[k // n], tokens[k % n]) for k in asked.tolist()], dtype=bool)
            out[miss] = got[back]
            at = (asked * 0x9E3779B1 >> 7) & (self.SLOTS - 1)
            self.keys[at] = asked
            self.values[at] = got  # of two keys in one slot the last write wins in both arrays
        return out

    def encode(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Words that the table can encode, in portions: the words, their ids in order, and how many each has."""
        fit = [w for w in words if len(w) <= self.LONGEST_WORD and w[:2] != SPACE * 2]
        for at in range(0, len(fit), self.WORDS):
            yield self._encode(fit[at : at + self.WORDS])

    def _encode(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.codes[np.minimum(raw, 0x2FFF)]
        codes[raw >= 0x3000] = 0
        stop = np.cumsum(n + 1) - 1  # the mark of code 0 behind each word
        start = stop - n
        good = np.add.reduceat((codes == 0).astype(np.int64), start) == 1
        codes[np.repeat(~good, n + 1)] = 0
        within = np.arange(len(codes)) - np.repeat(start, n + 1)
        at = np.flatnonzero(codes)
        node = np.zeros(len(at), dtype=np.int32)
        found = []
        for length in range(1, self.pieces.longest + 1):
            node = self.next[node, codes[at + length - 1]]  # the mark has no node, so no piece leaves its word
            alive = node >= 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            t = self.term[node]
            has = t >= 0
            found.append((at[has], at[has] + length, t[has]))
        last = np.full(len(codes), -1, dtype=np.int32)
        size = np.zeros(len(codes), dtype=np.int64)
        if found:
            begin, end, t = map(np.concatenate, zip(*found))
            order = np.argsort(within[end], kind="stable")
            begin, end, t = begin[order], end[order], t[order]
            bounds = np.searchsorted(within[end], np.arange(1, int(n.max()) + 2))
            for a, b in zip(bounds, bounds[1:]):
                i, j, piece = begin[a:b], end[a:b], t[a:b]
                ok = within[i] == 0
                before = last[i]
                ask = np.flatnonzero(before >= 0)
                ok[ask] = self.joined(before[ask], piece[ask])
                last[j[ok]] = piece[ok]  # a text has one encoding, so one piece at most ends a path here
                size[j[ok]] = j[ok] - i[ok]
        done = good & (last[stop] >= 0)
        chosen = np.zeros(len(codes), dtype=bool)
        at, first = stop[done], start[done]
        while len(at):
            chosen[at] = True
            at = at - size[at]
            more = at > first
            at, first = at[more], first[more]
        count = np.add.reduceat(chosen.astype(np.int64), start)
        return [w for w, d in zip(words, done.tolist()) if d], self.token_ids[last[chosen]], count[done]


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (x[:, :, None] + y[None, :, :]).max(axis=1)


def total(mats: list[np.ndarray]) -> np.ndarray:
    """The product of matrices, combined in pairs; products are associative, so any bracketing gives it."""
    while len(mats) > 1:
        mats = [product(*mats[k : k + 2]) if k + 1 < len(mats) else mats[k] for k in range(0, len(mats), 2)]
    return mats[0]


def scan(mats: list[np.ndarray], enter: int = 0, leave: int | None = None) -> list[int]:
    """State index at every edge, from `enter` before the first matrix to `leave` (by default the best) behind the last."""
    left = [np.where(np.arange(mats[0].shape[0]) == enter, 0.0, NEG)]
    for m in mats:
        left.append((left[-1][:, None] + m).max(axis=0))
    at = int(left[-1].argmax()) if leave is None else leave
    route = [at]
    for k in range(len(mats) - 1, 0, -1):
        at = int((left[k] + mats[k][:, at]).argmax())
        route.append(at)
    return [enter, *route[::-1]]


#: Chunks whose matrices one task combines; a document's blocks of them are combined in turn.
BLOCK = 64


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc id, n_chars, n_chunks, n_tokens, ids (array<int>) and round_trip for every row.

    Null text counts as empty: no pieces. Repeated rows each get their row. A literal space mark (U+2581) in a text
    encodes as a space, as in the library, and so does not come back on decoding; round_trip says so. Documents of
    one chunk are encoded where they are read. Longer ones are split into chunk rows dealt over the cluster: a matrix
    for each chunk; the product of each block of chunks, in any block's own task; the states at the blocks' edges from
    these products alone; then in every block those at its chunks' edges; backtrace of each chunk on its own, and the ids
    in order. Null ids stay null. An empty table gives an empty result. Other columns are dropped.
    """
    rows = arrow_bounded(docs.select(whole_id(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")))
    fits = F.char_length("text") < chunk
    longest = load(model).longest

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(model)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids = vocabulary.stretches([vocabulary.marked(t) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_chars": part["text"].map(len), "n_chunks": 1, "n_tokens": [len(x) for x in ids], "ids": ids, "round_trip": [vocabulary.decode(x.tolist()) == t for x, t in zip(ids, part["text"])]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(model)
        for pdf in batches:
            for doc, text, key, sha in pdf[["doc_id", "text", "key", "sha"]].itertuples(index=False):
                t = vocabulary.marked(text)
                parts = vocabulary.chunks(t, chunk)
                for k, (a, b) in enumerate(parts):
                    lo, hi = max(0, a - 2 * longest), min(len(t), b + 2 * longest)
                    yield pd.DataFrame([(doc, key, sha, k, k // BLOCK, len(parts), len(text), a - lo, b - lo, t[lo:hi])], columns=["doc_id", "key", "sha", "seq", "block", "n", "n_chars", "a", "b", "body"])

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(model)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m = vocabulary.matrix(r.body, r.a, r.b)
                out.append((r.key, r.seq, r.block, r.n, m.shape[0], m.shape[1], (m == 0).tobytes()))
            yield pd.DataFrame(out, columns=["key", "seq", "block", "n", "rows", "cols", "m"])

    def unpacked(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.where(np.frombuffer(m, dtype=bool).reshape(r, c), 0.0, NEG) for m, r, c in zip(pdf["m"], pdf["rows"], pdf["cols"])]

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        m = total(unpacked(pdf.sort_values("seq")))
        return pd.DataFrame([(pdf["key"].iloc[0], pdf["block"].iloc[0], m.shape[0], m.shape[1], (m == 0).tobytes())], columns=["key", "block", "rows", "cols", "m"])

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        route = scan(unpacked(pdf))
        return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "first": route[:-1], "last": route[1:]})

    def routes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        last = int(pdf["last"].iloc[0])
        route = scan(unpacked(pdf), int(pdf["first"].iloc[0]), last if last >= 0 else None)
        return pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "enter": route[:-1], "leave": route[1:]})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load(model)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ins, outs = vocabulary.states(r.body, r.a), vocabulary.states(r.body, r.b)
                ids = vocabulary.backtrace(r.body, r.a, r.b, ins[r.enter], outs[r.leave])
                out.append((r.doc_id, r.key, r.sha, r.seq, r.n, r.n_chars, np.array(ids, dtype=np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "key", "sha", "seq", "n", "n_chars", "ids"])

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        vocabulary = load(model)
        return ids.map(lambda x: vocabulary.decode(x.tolist()))

    kinds = "doc_id string, n_chars long, n_chunks int, n_tokens long, ids array<int>, round_trip boolean"
    near = rows.filter(fits).mapInPandas(short, kinds)
    giant = rows.filter(~fits).select("doc_id", "text", F.monotonically_increasing_id().alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    pieces = giant.mapInPandas(cut, "doc_id string, key long, sha string, seq int, block int, n int, n_chars long, a int, b int, body string")
    pieces = stash(pieces.repartition("key", "seq"), "pieces")  # rows' keys hold from here on
    found = stash(pieces.mapInPandas(matrices, "key long, seq int, block int, n int, rows int, cols int, m binary"), "matrices")
    # the edges of a document's only block are the document's own
    single, several = found.filter(F.col("n") <= BLOCK), found.filter(F.col("n") > BLOCK)
    blocks = several.groupBy("key", "block").applyInPandas(combine, "key long, block int, rows int, cols int, m binary")
    edge = blocks.groupBy("key").applyInPandas(edges, "key long, block int, first int, last int")
    placed = several.join(edge, ["key", "block"]).unionByName(single.withColumns({"first": F.lit(0), "last": F.lit(-1)}))
    route = placed.groupBy("key", "block").applyInPandas(routes, "key long, seq int, enter int, leave int")
    traced = pieces.join(route, ["key", "seq"]).mapInPandas(trace, "doc_id string, key long, sha string, seq int, n int, n_chars long, ids array<int>")
    far = traced.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("sha").alias("sha"), F.first("n_chars").alias("n_chars"), F.first("n").alias("n_chunks"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])).alias("ids"),
    )
    same = F.sha2(decoded("ids").cast("binary"), 256) == F.col("sha")
    far = far.select("doc_id", "n_chars", "n_chunks", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))
    return near.unionByName(far).withColumn("doc_id", F.col("doc_id").cast("long"))
