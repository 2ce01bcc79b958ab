"""Hashes of word shingles, vectorised over a text's bytes."""

from __future__ import annotations

import numpy as np

WIDTH = 5  # words of a shingle
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with all bits depending on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    size = max(1 << 17, 1 << n.bit_length())
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    steps = np.ones(size, np.uint64)
    steps[1:] = _ODD
    _powers = np.cumprod(steps, dtype=np.uint64)
    steps[1:] = inverse
    _inverse = np.cumprod(steps, dtype=np.uint64)


NOT_BLANK = np.arange(256) > 32
#: ASCII letters and digits, and all bytes of other characters.
WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def runs(data: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes for which kept holds."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], kept[data], [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """From these, span_hashes makes the hash of any span in constant time."""
    n = len(data)
    if n >= len(_powers):
        _grow(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers[:n], dtype=np.uint64, out=sums[1:])
    return sums


def span_values(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit values of the bytes from starts to ends, whose high bits, not the low ones, tell spans apart."""
    return (sums[ends] - sums[starts]) * _inverse[starts]


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from starts to ends."""
    return mixed(span_values(sums, starts, ends))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's lower-cased words: longest runs of bytes above the blank."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    return span_hashes(prefix_sums(data), *runs(data, NOT_BLANK))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """One hash for each run of width words, repeats included; a shorter text is one shingle, and so is one without words."""
    words = word_hashes(text)
    n = len(words) - width + 1
    if n < 1:
        return mixed(np.array([np.sum(words * _STEPS[: len(words)], dtype=np.uint64) + np.uint64(len(words))], np.uint64))
    total = words[:n] * _STEPS[0]
    for k in range(1, width):
        total = total + words[k : k + n] * _STEPS[k]
    return mixed(total + np.uint64(width))
