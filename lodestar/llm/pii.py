"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The patterns' spans always count. The tagger adds spans of the same kinds that the patterns miss: telephone numbers
without a plus sign, card numbers and addresses that are grouped or split unusually, spelt-out mail addresses. It is
trained on labelled spans of all these forms. It reads overlapping windows of a fixed grid; a window is read if a digit,
an @ or a spelt-out one lies in it, as every kind of span holds one of them. Each window is decoded alone by Viterbi, and
a decoded span counts if its posterior under the CRF reaches a bound. A span that touches an inner edge of its window is
left to the neighbouring window, and of all spans of a document those are chosen that do not overlap and weigh most
together (weighted interval scheduling over the whole text).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_bounded, release, text_or_empty, whole_id
from lodestar.llm.textnum import batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Window length and stride; a tagged span is at most as long as the overlap.
WINDOW, STRIDE = 96, 48
HIDDEN, EMBED = 16, 10
TAGS = 1 + 2 * len(KINDS)
#: Least posterior probability of a tagged span.
SURE = 0.5
#: Windows that are decoded together.
TOGETHER = 256


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the pattern, found from each @ so that long runs without one cost nothing."""
    out, behind, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > behind and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            behind = m.end()
            at = text.find("@", behind)
        else:
            behind = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# -- the tagger

_MARKS = "@.+-()_%:/=,#$'\""


def char_class(c: str) -> int:
    if c in "0123456789":
        return 1
    if c == " ":
        return 2
    if c in _MARKS:
        return 7 + _MARKS.index(c)
    if c.isupper():
        return 3
    if c.isalpha():
        return 4
    return 5 if c.isspace() else 6


CLASSES = 7 + len(_MARKS)
_CODES = np.array([char_class(chr(k)) for k in range(0x250)], dtype=np.int8)


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(raw < 0x250, _CODES[np.minimum(raw, 0x24F)], np.int8(4))


def _allowed() -> np.ndarray:
    """Legal transitions between tags: 0 outside, 1 + 2k begins kind k, 2 + 2k continues it."""
    ok = np.ones((TAGS, TAGS), dtype=bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()
STARTS = np.array([True] + [True, False] * len(KINDS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Parameters as numpy arrays; forward, loss with gradients, and decoding."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def new(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = {"E": new(CLASSES, EMBED), "O": new(2 * HIDDEN, TAGS), "o": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"W{d}": new(EMBED, 4 * HIDDEN), f"U{d}": new(HIDDEN, 4 * HIDDEN), f"c{d}": np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))}

    def _lstm(self, x: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """x: time, batch, embedding. Gates in the order input, forget, output, candidate. keep: what the backward pass needs."""
        p, n = self.p, x.shape[1]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        xw = x @ p[f"W{d}"] + p[f"c{d}"]
        hs, tape = np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)):
            z = xw[t] + h @ p[f"U{d}"]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, a = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * a
            tc = np.tanh(c)
            if keep:
                tape.append((i, f, o, a, before, tc, h))
            h = o * tc
            hs[t] = h
        return hs, tape

    def _lstm_back(self, x: np.ndarray, tape: list, dh: np.ndarray, d: str, grads: dict) -> np.ndarray:
        p, dx = self.p, np.empty_like(x)
        nh, nc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, a, before, tc, h = tape[t]
            g = dh[t] + nh
            dc = nc + g * o * (1 - tc * tc)
            dz = np.concatenate((dc * a * i * (1 - i), dc * before * f * (1 - f), g * tc * o * (1 - o), dc * i * (1 - a * a)), axis=1)
            grads[f"W{d}"] += x[t].T @ dz
            grads[f"U{d}"] += h.T @ dz
            grads[f"c{d}"] += dz.sum(axis=0)
            dx[t] = dz @ p[f"W{d}"].T
            nh, nc = dz @ p[f"U{d}"].T, dc * f
        return dx

    def emissions(self, batch: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        """batch: (n, length) of character classes. Scores (length, n, tags) and what the backward pass needs."""
        x = self.p["E"][batch.T]
        hf, tf = self._lstm(x, "f", keep)
        hb, tb = self._lstm(x[::-1], "b", keep)
        h = np.concatenate((hf, hb[::-1]), axis=2)
        return h @ self.p["O"] + self.p["o"], (x, tf, tb, h)

    def _transitions(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(ALLOWED, self.p["T"], -1e4), np.where(STARTS, self.p["S"], -1e4)

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over all paths up to and from each position and tag, and over all paths."""
        T, S = self._transitions()
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = S + e[0]
        for t in range(1, len(e)):
            m = alpha[t - 1].max(axis=1, keepdims=True)
            alpha[t] = e[t] + m + np.log(np.exp(alpha[t - 1] - m) @ np.exp(T) + 1e-300)
        for t in range(len(e) - 2, -1, -1):
            v = e[t + 1] + beta[t + 1]
            m = v.max(axis=1, keepdims=True)
            beta[t] = m + np.log(np.exp(v - m) @ np.exp(T).T + 1e-300)
        top = alpha[-1].max(axis=1)
        return alpha, beta, top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))

    def loss(self, batch: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the CRF, and gradients."""
        e, (x, tf, tb, h) = self.emissions(batch)
        T, S = self._transitions()
        length, n, _ = e.shape
        alpha, beta, z = self._sums(e)
        y = tags.T
        rows = np.arange(n)
        gold = S[y[0]] + sum(e[t, rows, y[t]] for t in range(length)) + sum(T[y[t - 1], y[t]] for t in range(1, length))
        de = np.exp(alpha + beta - z[:, None])
        dT = np.zeros_like(T)
        for t in range(1, length):
            left, right = alpha[t - 1] - z[:, None], e[t] + beta[t]
            m = right.max(axis=1, keepdims=True)
            dT += np.exp(T) * (np.exp(left + m).T @ np.exp(right - m))
            np.subtract.at(dT, (y[t - 1], y[t]), 1)
        dS = de[0].sum(axis=0) - np.bincount(y[0], minlength=TAGS)
        for t in range(length):
            de[t, rows, y[t]] -= 1
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["T"], grads["S"] = np.where(ALLOWED, dT, 0), np.where(STARTS, dS, 0)
        grads["O"], grads["o"] = np.einsum("tnh,tnk->hk", h, de), de.sum(axis=(0, 1))
        dh = de @ self.p["O"].T
        dx = self._lstm_back(x, tf, dh[:, :, :HIDDEN], "f", grads)
        dx += self._lstm_back(x[::-1], tb, dh[::-1, :, HIDDEN:], "b", grads)[::-1]
        np.add.at(grads["E"], batch.T, dx)
        return float((z - gold).mean()), {k: v / n for k, v in grads.items()}

    def fit(self, steps: int = 450, size: int = 48, length: int = 64, rate: float = 0.03, seed: int = 5) -> "Tagger":
        rng = random.Random(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            batch, tags = examples(rng, size, length)
            _, grads = self.loss(batch, tags)
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.p[k] -= rate * (1 - 0.9 * step / steps) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window by Viterbi, and the emissions."""
        e, _ = self.emissions(batch, keep=False)
        T, S = self._transitions()
        length, n, _ = e.shape
        score, back = S + e[0], np.zeros((length, n, TAGS), dtype=np.int8)
        for t in range(1, length):
            step = score[:, :, None] + T
            back[t] = step.argmax(axis=1)
            score = step.max(axis=1) + e[t]
        tags = np.empty((length, n), dtype=np.int8)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[t - 1] = back[t, rows, tags[t]]
        return tags.T, e

    def spans(self, batch: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(window, kind, start, end, posterior) of each span on the windows' best paths."""
        tags, e = self.decode(batch)
        T, length = self._transitions()[0], batch.shape[1]
        hit = np.flatnonzero(tags.any(axis=1))
        if not len(hit):
            return []
        alpha, beta, z = self._sums(e[:, hit])
        out = []
        for r, w in enumerate(hit.tolist()):
            path = tags[w]
            for a in np.flatnonzero(path % 2 == 1).tolist():
                kind, b = int(path[a]) // 2, a + 1
                while b < length and path[b] == path[a] + 1:
                    b += 1
                inside = path[a:b].astype(np.int64)
                weight = alpha[a, r, inside[0]] + e[np.arange(a + 1, b), w, inside[1:]].sum() + T[inside[:-1], inside[1:]].sum()
                if b < length:  # any path goes on that does not continue the span
                    after = T[inside[-1]] + e[b, w] + beta[b, r]
                    after[2 + 2 * kind] = -np.inf
                    weight += after.max() + np.log(np.exp(after - after.max()).sum())
                out.append((w, kind, a, b, float(np.exp(min(0.0, weight - z[r])))))
        return out


def _word(rng: random.Random) -> str:
    w = "".join(rng.choice("etaoinshrdlucmfwypvbgkäéñ") for _ in range(rng.randint(1, 11)))
    return w.capitalize() if rng.random() < 0.1 else w


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _positive(rng: random.Random) -> tuple[int, str]:
    """A labelled span: kind and text, in usual and in unusual forms."""
    kind = rng.randrange(4)
    if kind == 0:
        local = re.sub("[^a-z]", "x", _word(rng).lower()) + rng.choice(["", "." + _digits(rng, 2), "_" + _digits(rng, 1), "." + "kim", "+tag"])
        host = re.sub("[^a-z]", "y", _word(rng).lower()) + rng.choice(["", _digits(rng, 1)])
        at, dot = rng.choice([("@", ".")] * 5 + [(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", "."), ("[at]", "[dot]")])
        return 0, f"{local}{at}{host}{rng.choice(['', dot + 'example'])}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"
    if kind == 1:
        dot = rng.choice(["."] * 5 + [" . ", "[.]", ". "])
        return 1, dot.join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == 2:
        d = _digits(rng, 15)
        d = "4" + d[1:]
        d += next(c for c in "0123456789" if luhn(d + c))
        gap = rng.choice([" ", "-", " - ", "  ", ".", "\n"])
        return 2, rng.choice([d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4)), gap.join(d[k : k + 4] for k in range(0, 16, 4))])
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return 3, rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"+{a}{b}{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}"])


def _negative(rng: random.Random) -> str:
    return rng.choice([
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(1, 99)}.{_digits(rng, 2)}",
        lambda: _digits(rng, rng.randint(1, 9)), lambda: "@" + re.sub("[^a-z]", "z", _word(rng).lower()), lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
        lambda: "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 16, 32]))),
        lambda: f"{rng.randint(0, 23)}:{_digits(rng, 2)}", lambda: f"${rng.randint(1, 999)},{_digits(rng, 3)}", lambda: f"{_digits(rng, 4)}/{_digits(rng, 4)}", lambda: f"#{_digits(rng, 5)}", lambda: f"{_digits(rng, 2)}-{_digits(rng, 2)}", lambda: f"({_digits(rng, 4)})",
        lambda: f"{_word(rng)} at {_word(rng)}", lambda: f"{_word(rng)} dot {_word(rng)}", lambda: f"{_word(rng)} @ {_word(rng)}", lambda: ", ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(2, 5))), lambda: " ".join(str(rng.randint(0, 999)) for _ in range(rng.randint(2, 4))),
    ])()


def examples(rng: random.Random, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: words with personal data, of known spans, and numbers that are none."""
    batch, tags = np.zeros((size, length), dtype=np.int64), np.zeros((size, length), dtype=np.int64)
    for row in range(size):
        text, spans = "", []
        skip = rng.randint(0, 12)
        while len(text) < length + skip:
            r = rng.random()
            if r < 0.16:
                kind, s = _positive(rng)
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + rng.choice([" ", " ", " ", ", ", ". ", "\n", ") "])
            elif r < 0.3:
                text += _negative(rng) + rng.choice([" ", " ", ", ", ". ", "\n"])
            else:
                text += _word(rng) + rng.choice([" "] * 8 + [". ", ", ", "\n"])
        batch[row] = codes(text[skip : skip + length])
        for kind, a, b in spans:
            a, b = a - skip, b - skip
            if a >= 0 and b <= length:
                tags[row, a] = 1 + 2 * kind
                tags[row, a + 1 : b] = 2 + 2 * kind
            elif b > 0 and a < length:  # cut by the edge: begins where the window does
                a, b = max(a, 0), min(b, length)
                tags[row, a] = 1 + 2 * kind
                tags[row, a + 1 : b] = 2 + 2 * kind
    return batch, tags


_TRAINED: dict[int, Tagger] = {}


def trained(seed: int = 3) -> Tagger:
    if seed not in _TRAINED:
        _TRAINED[seed] = Tagger(seed).fit()
    return _TRAINED[seed]


def possible(kind: int, s: str) -> bool:
    """What every span of a kind holds: a mark of the kind, its number of digits, a card's checksum."""
    digits = sum(c in "0123456789" for c in s)
    if kind == 0:
        return bool(_AT.search(s))
    if kind == 2 and not luhn("".join(c for c in s if c in "0123456789")):
        return False
    return (4 <= digits <= 12, 16 <= digits <= 19, 7 <= digits <= 15)[kind - 1]


def schedule(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, weight) those without overlap that weigh most together; ties go to the earlier end."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[1], s[0]))
    ends, best = [s[2] for s in spans], [0.0]
    take = []
    from bisect import bisect_right

    for k, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, k)
        w = best[before] + s[3]
        take.append(w > best[k])
        best.append(max(best[k], w))
    out, k = [], len(spans)
    while k:
        if take[k - 1]:
            out.append(spans[k - 1][:3])
            k = bisect_right(ends, spans[k - 1][1], 0, k - 1)
        else:
            k -= 1
    return out[::-1]


_AT = re.compile(r"@|[\[(] ?at ?[\])]| at .{1,40} dot ", re.S)
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]| dot ")


def tagged(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text, whole windows at a time."""
    jobs: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        last = -1
        for m in _TRIGGER.finditer(text):
            cell = m.start() // STRIDE
            for w in range(max(last + 1, cell - 1), cell + 1):
                jobs.append((k, w * STRIDE))
            last = cell
    found: dict[int, dict] = {}
    for at in range(0, len(jobs), TOGETHER):
        part = jobs[at : at + TOGETHER]
        batch = np.zeros((len(part), WINDOW), dtype=np.int64)
        for r, (k, a) in enumerate(part):
            c = codes(texts[k][a : a + WINDOW])
            batch[r, : len(c)] = c
            batch[r, len(c) :] = 2
        for r, kind, c, end, sure in model.spans(batch):
            k, a = part[r]
            text = texts[k]
            if (c == 0 and a > 0) or (end == WINDOW and a + WINDOW < len(text)) or a + end > len(text):
                continue
            if sure >= SURE and possible(kind, text[a + c : a + end]):
                most = found.setdefault(k, {})
                key = (kind, a + c, a + end)  # the same span from two windows
                most[key] = max(round(sure * (end - c), 6), most.get(key, 0.0))
    best: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, most in found.items():
        best[k] = schedule([(*key, w) for key, w in most.items()])
    return best


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text; an added span overlaps no base span."""
    out = []
    for text, more in zip(texts, tagged(texts, model)):
        base = base_spans(text)
        added = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)] if more else []
        out.append((base, sorted(base + added) if added else base))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """For every row: doc_id (long), n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added.

    Null text counts as empty; no spans give an empty string, whose digest stands in base_sha256. Null ids stay null,
    repeated rows each get their row, an empty table gives an empty result. Rows are independent: no shuffle. Other
    columns are dropped.
    """
    rows = arrow_bounded(docs.select(whole_id(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")))
    tagger = model or trained()

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(frames):
            found = all_spans(pdf["text"].tolist(), tagger)
            out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()})
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[0] == k for s in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [joined(every) for _, every in found]
            out["n_added"] = [len(every) - len(base) for base, every in found]
            yield out

    found = rows.mapInPandas(find, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in brackets; overlapping spans are replaced together, by the first one's kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Pipeline stage: documents with every span replaced in text, and n_chars set to the new length; null texts and other columns as they were."""
    tagger = model or trained()
    schema = docs.schema

    def clean(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            columns = {name: batch.column(name) for name in schema.names}
            texts, lengths = columns["text"].to_pylist(), columns["n_chars"].to_pylist()
            at = 0
            for part in batches(iter([pd.DataFrame({"text": [t or "" for t in texts]}, dtype=object)])):
                for k, (text, (_, every)) in enumerate(zip(part["text"], all_spans(part["text"].tolist(), tagger)), at):
                    if every:
                        texts[k] = redact(text, every)
                        lengths[k] = len(texts[k])
                at += len(part)
            columns["text"] = pa.array(texts, columns["text"].type)
            columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        release()

    return arrow_bounded(docs).mapInArrow(clean, schema)
