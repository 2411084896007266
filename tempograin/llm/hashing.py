"""64-bit hashes of words and word shingles of one text, computed with numpy over its bytes."""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Every ASCII character but letters and digits.
PUNCTUATION = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(256, dtype=np.uint64))
_powers = _inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _BASE)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = _INVERSE
        _inverses = np.cumprod(steps)


def _block(data: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(gaps[data].astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes, gaps: np.ndarray = WHITE) -> np.ndarray:
    """A hash for each maximal run of bytes outside gaps, in order. Works through long texts in blocks cut at a gap."""
    whole, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(whole):
        end = at + _BLOCK
        while end < len(whole) and not len(cut := np.flatnonzero(gaps[whole[max(at, end - _BLOCK) : end]])):
            end += _BLOCK
        if end < len(whole):
            end = max(at, end - _BLOCK) + int(cut[-1]) + 1
        out.append(_block(whole[at:end], gaps))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n words, in order; none if there are fewer words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        total = mix(total) + words[k : len(words) - n + 1 + k]
    return mix(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word windows; of the whole sequence if it is shorter."""
    return np.unique(ngrams(words, min(n, len(words)))) if len(words) else words
