"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from lodestar.llm.common import release

_P = np.uint64(0x100000001B3)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(1 << 12, _P, dtype=np.uint64))
#: Bytes as words see them: A-Z lower-cased, ASCII that is neither letter nor digit as 0; bytes of other characters stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[:48] = 0
FOLD[58:65] = 0
FOLD[91:97] = 0
FOLD[123:128] = 0
#: Case and marks kept, words parted by ASCII blanks and controls.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[:33] = 0


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(29))) * _M2
        return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str], fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, index of its text)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    b = fold[np.frombuffer(b"\x00".join(raw) + b"\x00", dtype=np.uint8)]
    inside = b > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n = ends - starts
    at = np.flatnonzero(inside)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        terms = (b[at].astype(np.uint64) + np.uint64(1)) * _POWERS[offset & 4095]
        h = mix(np.add.reduceat(terms, np.cumsum(n) - n) + n.astype(np.uint64))
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return h, np.searchsorted(bounds, starts, side="right")


def shingles(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words; a text of fewer words has one, of all its words."""
    h, of = word_hashes(texts)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        if len(h) >= width:
            s = np.zeros(len(h) - width + 1, dtype=np.uint64)
            for k in range(width):
                s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
            s = mix(s)
        else:
            s = np.zeros(0, dtype=np.uint64)
        out = []
        for k, n in enumerate(counts.tolist()):
            a = first[k]
            if n >= width:
                out.append(np.unique(s[a : a + n - width + 1]))
            elif n:
                v = np.uint64(n)
                for x in h[a : a + n]:
                    v = v * np.uint64(0x9E3779B97F4A7C15) + x
                out.append(mix(np.array([v], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def batches(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = 400_000) -> Iterator[pd.DataFrame]:
    """Parts of bounded text (or one row); at the end freed memory goes back to the system."""
    for pdf in frames:
        if len(pdf):
            part = (pdf[column].map(len).cumsum() // chars).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                yield pdf.iloc[a:b]
    release()
