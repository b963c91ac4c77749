"""Hashes of words and word shingles, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters of the joined texts handled at a time; bounds the memory of the arrays below.
BLOCK_BYTES = 500_000
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of the 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))
_places = mix(np.arange(64, dtype=np.uint64)) | np.uint64(1)


def _place_values(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = mix(np.arange(2 * n, dtype=np.uint64)) | np.uint64(1)
    return _places


def blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_SPACES[data]
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends))))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
    at = np.flatnonzero(inside)
    lengths = ends - starts
    local = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _BYTES[data[at]] * _place_values(int(lengths.max()))[local]
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mix(sums ^ lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[str | None], width: int = 2) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes.

    A-Z count as a-z.  A text of fewer words than ``width`` has its whole
    sequence as one shingle; one without words has none.
    """
    for part in blocks([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]):
        words, counts = word_hashes(part)
        joined = words.copy()
        for k in range(1, min(width, len(words))):
            joined[: len(words) - k] = mix(joined[: len(words) - k] * np.uint64(0xD1342543DE82EF95) + words[k:])
        at = 0
        for n in counts:
            if n >= width:
                yield np.unique(joined[at : at + n - width + 1])
            elif n:
                whole = np.uint64(n)
                for w in words[at : at + n]:
                    whole = mix(np.array([whole ^ w]))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            at += n
