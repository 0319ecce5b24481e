"""Hashes of words and of runs of words, for a batch of texts at once.

Words are runs of ASCII letters, digits and non-ASCII bytes, with A-Z folded to
a-z: case and punctuation do not count.
"""

from __future__ import annotations

import numpy as np

FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, BATCH_BYTES + 1)
        _TABLES[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _TABLES


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash of every word, first word of each text (one more at the end), word ends, folded bytes.

    A word's hash is a difference of running sums of ``byte * base**place``, moved
    back by the inverse power: no loop over words.
    """
    folded = b"\x00".join((t or b"").translate(FOLD) for t in texts) + b"\x00"
    data = np.frombuffer(folded, np.uint8)
    inside = np.zeros(len(data) + 1, np.bool_)
    np.greater(data, 32, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * power[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    stops = np.flatnonzero(data == 0)
    first = np.concatenate(([0], np.searchsorted(starts, stops)))
    return words, first, ends, folded


def run_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words of a text, and the first run of each text.

    A text of fewer words, but not none, has one run: all its words.
    """
    n = len(words)
    mixed = np.zeros(n, np.uint64)
    step = _powers(0xD6E8FEB86659FD93, width)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    for k in range(width):
        mixed += padded[k : k + n] * step[k]
    counts = np.diff(first)
    keep = np.ones(n, np.bool_)
    tail = np.repeat(first[1:], counts) - np.arange(n)  # words from here to the end of the text
    keep &= tail >= width
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = first[d], first[d + 1]
        mixed[a] = (words[a:b] * step[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        keep[a] = True
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return mix(mixed[keep]), np.concatenate(([0], np.cumsum(runs)))


def text_batches(texts: list[bytes | None], limit: int = BATCH_BYTES):
    """Ranges of neighbouring texts of about ``limit`` bytes; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def counted(runs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text, in order: text number, hash, number of times."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((runs, text))
    text, runs = text[order], runs[order]
    new = np.ones(len(runs), np.bool_)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], runs[at], np.diff(np.concatenate((at, [len(runs)])))
