"""Word shingles of texts as sorted arrays of 62-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes worked through at a time; the arrays take some forty times as much.
GROUP_BYTES = 500_000
_STEPS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _STEPS[0]
    h = (h ^ (h >> np.uint64(27))) * _STEPS[1]
    return h ^ (h >> np.uint64(31))


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes that end in white space."""
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[::2], edge[1::2]
    powers = np.full(len(b), _ODD)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    powers *= b.astype(np.uint64) + np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers)])
    powers[:] = _INVERSE
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return _mixed((total[stops] - total[starts]) * powers[starts] + (stops - starts).astype(np.uint64)), starts


def word_hashes(texts: Sequence[bytes]) -> list[np.ndarray]:
    """Hashes of all words ``[^\x20\x09-\x0D]+`` of each lower-cased (A-Z) text, in order.

    Work goes by ``GROUP_BYTES``: short texts together, a long one in parts that end between words.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and size + len(texts[upto]) <= GROUP_BYTES:
            size += len(texts[upto])
            upto += 1
        if upto == at:
            raw, parts, i = texts[at].translate(_LOWER) + b" ", [], 0
            while i < len(raw):
                cut = _BREAK.search(raw, min(len(raw) - 1, i + GROUP_BYTES)).end()
                parts.append(_hashes(raw[i:cut])[0])
                i = cut
            out.append(np.concatenate(parts))
            at += 1
            continue
        words, starts = _hashes(b" ".join(texts[at:upto]).translate(_LOWER) + b" ")
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[at:upto]), np.int64, upto - at))
        out += np.split(words, np.searchsorted(starts, ends)[:-1])
        at = upto
    return out


def shingle_sets(texts: Sequence[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct ``size``-word shingles as ascending int64 hashes below 2**62; a shorter text has one, an empty one
    none."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for own in word_hashes(texts):
            n = len(own)
            if not n:
                out.append(np.empty(0, np.int64))
                continue
            k = min(n, size)
            h = np.full(n - k + 1, np.uint64(k))
            for i in range(k):
                h = h * _STEPS[2 + i % 6] + own[i : n - k + 1 + i]
            out.append(np.unique((_mixed(h) >> np.uint64(2)).astype(np.int64)))
    return out
