"""Words of many texts as 64-bit hashes, computed on whole batches with numpy."""

from __future__ import annotations

import numpy as np

# Odd multiplier of the polynomial hash over bytes, its inverse modulo 2**64, and the finisher's constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & ((1 << 64) - 1)), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ((48, 58), (97, 123), (128, 256)):
        table[low:high] = True
    return table


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the first and last-plus-one word of each text.

    Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case; a null text has none.
    """
    raw = [t.lower().encode(errors="surrogatepass") if t else b"" for t in texts]
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _word_bytes()[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, after = edges[::2], edges[1::2]
    # Each word's polynomial hash is a difference of prefix sums, scaled back to its own start.
    hashes = _spans(data, first, after)
    text_ends = np.cumsum(lengths)
    ends = np.searchsorted(first, text_ends)
    starts = np.concatenate([[0], ends[:-1]])
    return hashes, starts, ends


def _spans(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    n = len(data)
    powers = _powers(BASE, n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    inverse = _powers(INVERSE, n)
    return mixed((sums[after] - sums[first]) * inverse[first] + (after - first).astype(np.uint64) * M2)


def hash_words(text: str | None) -> np.ndarray:
    """The word hashes of one text."""
    return word_hashes([text])[0]


def shingle_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside each text, and the number of them per text.

    A text with fewer words, but at least one, has one shingle of all its words.
    """
    counts = ends - starts
    numbers = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(starts)), numbers)
    at = np.arange(len(text)) - np.repeat(np.cumsum(numbers) - numbers, numbers) + starts[text]
    out = np.zeros(len(text), np.uint64)
    last = ends[text]
    for i in range(size):
        there = at + i < last
        word = words[np.minimum(at + i, max(0, len(words) - 1))] if len(words) else np.zeros(0, np.uint64)
        out = out * np.uint64(BASE) + np.where(there, word, np.uint64(0))
    return mixed(out), numbers
