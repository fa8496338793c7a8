"""Word and shingle hashes of whole Arrow text columns, by numpy over the UTF-8 buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A word's hash is a polynomial over
its bytes modulo 2**64, taken as a difference of prefix sums, so the cost does not depend on the number of words.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(n, BASE if which == "up" else INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def word_spans(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of ``buf``; no word crosses a position in ``starts`` (the texts' beginnings)."""
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = starts[(starts > 0) & (starts < len(buf))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_slice(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, end = word_spans(buf, starts)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * _power("up", len(buf)), out=sums[1:])
    h = (sums[end] - sums[at]) * _power("down", len(buf) + 1)[at]
    return mix(h + (end - at).astype(np.uint64)), at


def buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string column (null texts count as empty)."""
    import pyarrow as pa

    valid = np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets, valid


def hashed_words(column):
    """``(row, hashes)`` per text, in order; work is cut into slices of about one MB, a longer text at white space."""
    raw, offsets, _ = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        if offsets[row + 1] - offsets[row] > 2 * SLICE:
            parts, at, stop = [], int(offsets[row]), int(offsets[row + 1])
            while at < stop:
                end = min(stop, at + SLICE)
                while end < stop and not _SPACE[raw[end]]:
                    end += 1
                parts.append(_hash_slice(raw[at:end], np.zeros(1, np.int64))[0])
                at = end
            yield row, np.concatenate(parts)
            row += 1
            continue
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        buf, starts = raw[offsets[row] : offsets[until]], offsets[row : until + 1] - offsets[row]
        h, at = _hash_slice(buf, starts[:-1])
        cuts = np.searchsorted(at, starts)
        for k in range(until - row):
            yield row + k, h[cuts[k] : cuts[k + 1]]
        row = until


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return words[:0]
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - span + 1 + i])
    return np.unique(total)
