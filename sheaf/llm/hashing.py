"""Hashes of many spans of a text at once, and texts packed side by side for them.

The hash of a span is the sum of its bytes' random numbers times powers of an odd base, modulo 2**64. Prefix
sums give any span's hash from its two ends, whatever its place, since the base can be inverted. Hashes
depend on nothing but the bytes, so they agree between tasks, machines and runs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
NUMBERS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _reach(n: int) -> None:
    """Make the tables of powers reach to n."""
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, min(2 * len(_powers), 1 << 21))
        bases = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        for column in bases:
            column[0] = 1
        _powers, _inverse = (np.cumprod(column) for column in bases)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread differences in any bit over all of them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def prefix_of(numbers: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hashes`` over any numbers, uint64 that are spread well; they are overwritten."""
    _reach(len(numbers))
    sums = np.empty(len(numbers) + 1, np.uint64)
    sums[0] = 0
    numbers *= _powers[: len(numbers)]
    np.cumsum(numbers, out=sums[1:])
    return sums


def prefix(buffer: np.ndarray, seed: int = 0) -> np.ndarray:
    """The same over bytes; buffer: uint8."""
    return prefix_of(NUMBERS[seed][buffer])


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of buffer[start:end], as uint64."""
    return mix((sums[ends] - sums[starts]) * _inverse[starts])


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Of all windows of ``size`` bytes."""
    n = len(sums) - 1
    if n < size:
        return np.empty(0, np.uint64)
    return mix((sums[size:] - sums[: n - size + 1]) * _inverse[: n - size + 1])


class Words(NamedTuple):
    """The words of several texts, joined by one space in a text and a line feed after each text."""

    data: bytes
    buffer: np.ndarray  # the same as uint8
    starts: np.ndarray  # of each word
    ends: np.ndarray
    text: np.ndarray  # the text that a word belongs to
    first: np.ndarray  # of each text, its first word; one more at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> np.ndarray:
        """The first words of all windows of ``size`` words that lie inside one text."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.text[:n] == self.text[size - 1 :])


def scan_words(data: bytes) -> Words:
    """The words of texts that are joined already."""
    buffer = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero((buffer == 0x20) | (buffer == 0x0A))
    before = np.concatenate(([-1], stops[:-1])) if len(stops) else stops
    real = stops > before + 1  # not the line feed of a text without words
    starts, ends = before[real] + 1, stops[real]
    text = np.cumsum(buffer[stops] == 0x0A) - (buffer[stops] == 0x0A)
    n = int(text[-1]) + 1 if len(text) else 0
    text = text[real]
    return Words(data, buffer, starts, ends, text, np.searchsorted(text, np.arange(n + 1)))


def pack_words(texts: list[list[bytes]]) -> Words:
    """Texts as lists of words without spaces and line feeds in them."""
    return scan_words(b"".join([b" ".join(words) + b"\n" for words in texts]))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    change = np.diff(np.concatenate(([0], marked.view(np.int8), [0])))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)
