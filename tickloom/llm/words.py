"""Words of many texts at once, as numpy arrays over the UTF-8 bytes.

A word is a run of bytes outside [\\x20\\x09-\\x0D]. A word's hash is a polynomial in
2^64 over random byte values, taken from prefix sums, so no Python object is made for
a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RAW = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once; a longer text is cut where a word has just ended, so memory beside the words is bounded, but for a single longer word.
PIECE = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of both bases; those for a piece are kept, those for a longer word are not."""
    if _powers and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    found = []
    for base in (_P, _P_INVERSE):
        steps = np.full(max(n, 2 * PIECE), base, np.uint64)
        steps[0] = 1
        found.append(np.cumprod(steps))
    if n <= 2 * PIECE:
        _powers[:] = found
    return found[0], found[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    joined: np.ndarray  # bytes of all texts, one separator after each
    begins: np.ndarray  # of the texts, in joined
    start: np.ndarray  # of the words, in joined
    end: np.ndarray
    doc: np.ndarray  # number of the word's text
    hash: np.ndarray
    count: np.ndarray  # words of each text


def _pieces(joined: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces that end with a separator, as the whole does."""
    at = 0
    while at < len(joined):
        end = at + PIECE
        while end < len(joined):
            gap = np.flatnonzero(SPACE[joined[end - 1 : end - 1 + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end += PIECE
        end = min(end, len(joined))
        yield at, end
        at = end


def _words(piece: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a piece."""
    turns = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[piece])).view(np.int8)))
    start, end = turns[0::2], turns[1::2]
    power, inverse = _power_tables(len(piece))
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(table[piece] * power[: len(piece)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * inverse[start])


def words_of(texts: list[bytes], lower: bool) -> Words:
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    found = [(a, *_words(joined[a:b], _LOWER if lower else _RAW)) for a, b in _pieces(joined)]
    start, end = (np.concatenate([a + x[k] for a, *x in found]) for k in (0, 1))
    doc = np.searchsorted(begins, start, "right") - 1
    return Words(joined, begins, start, end, doc, np.concatenate([x[3] for x in found]), np.bincount(doc, minlength=len(texts)))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `size` words inside a text, and the index of its first word."""
    h, doc = words.hash, words.doc
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, factor = np.zeros(n, np.uint64), np.uint64(1)
    for j in range(size):
        total += h[j : n + j] * factor
        factor = np.uint64((int(factor) * int(_Q)) & 0xFFFFFFFFFFFFFFFF)
    at = np.flatnonzero(doc[:n] == doc[size - 1 : n + size - 1])
    return mix(total[at] + np.uint64(size)), at


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, in order of text and hash, and their number by text.

    Lower-case A-Z; a text of fewer words has one shingle, the whole sequence; one
    without words has none.
    """
    words = words_of(texts, lower=True)
    hashes, at = windows(words, size)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        firsts = np.cumsum(words.count) - words.count
        whole = np.zeros(len(short), np.uint64)
        factor = 1
        for j in range(size - 1):
            has = words.count[short] > j
            whole[has] += words.hash[firsts[short][has] + j] * np.uint64(factor)
            factor = (factor * int(_Q)) & 0xFFFFFFFFFFFFFFFF
        hashes = np.concatenate((hashes, mix(whole + words.count[short].astype(np.uint64))))
        doc = np.concatenate((doc, short))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
        hashes, doc = hashes[new], doc[new]
    return hashes, np.bincount(doc, minlength=len(texts))
