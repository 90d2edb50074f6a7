"""Sets of word shingles of whole batches of texts, in numpy.

A word is a run of bytes other than white space, A-Z lower-cased. Its hash is a polynomial over random numbers of its bytes,
modulo 2^64 and then mixed; two given words share one with a probability under 2^-50. A shingle's hash folds those
of its words. Long texts are hashed piece by piece, so beside its words' hashes a text needs bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time, and after which a slice of rows ends.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C13
DRAW = np.random.default_rng(5)
LETTER = DRAW.integers(0, 2**64, 256, dtype=np.uint64)
LETTER[65:91] = LETTER[97:123]
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
FACTOR = np.uint64(0x2545F4914F6CDD1D)
SHORT = np.uint64(0xA24BAED4963EE407)


def powers(base: int, count: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(count - 1, base, np.uint64)])


UP, DOWN = powers(BASE, PIECE + 1), powers(pow(BASE, -1, 1 << 64), PIECE + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, at most PIECE, and where each starts; a word ends where one of begins lies."""
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    start = inside & (edge[:-1] | np.r_[True, ~inside[:-1]])
    stop = inside & (edge[1:] | np.r_[~inside[1:], True])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[data] * UP[: len(data)], dtype=np.uint64)])
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return mixed((sums[last] - sums[first]) * DOWN[first]), first


def long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of a text of any length; pieces end at white space, and a word beyond PIECE is folded from its parts."""
    out, at = [], 0
    while at < len(data):
        piece = data[at : at + PIECE]
        if at + PIECE < len(data) and IN_WORD[data[at + PIECE]]:
            gaps = np.flatnonzero(~IN_WORD[piece])
            piece = piece[: gaps[-1] + 1] if len(gaps) else piece
        found = hashed_words(piece, np.zeros(1, np.int64))[0]
        end = at + len(piece)
        if len(out) and at and IN_WORD[data[at - 1]] and IN_WORD[data[at]]:
            out[-1][-1:] = mixed(out[-1][-1:] * FACTOR + found[:1])
            found = found[1:]
        out.append(found)
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes; a longer row has one of its own."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, end
        at = end


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice of texts without nulls, and how many each text has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if len(data) > PIECE:
        hashes = long_text(data)
        return hashes, np.array([len(hashes)])
    begins = offsets - offsets[0]
    hashes, first = hashed_words(data, begins[begins <= len(data)])
    return hashes, np.diff(np.searchsorted(first, begins))


def sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles in ascending order; a text with fewer words has its whole sequence as one."""
    hashes, counts = words(column)
    folded = hashes[: max(len(hashes) - size + 1, 0)]
    for k in range(1, size):
        folded = mixed(folded) * FACTOR + hashes[k : k + len(folded)]
    folded = mixed(folded)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            found = np.sort(folded[at : at + n - size + 1])
            out.append(found[np.r_[True, found[1:] != found[:-1]]])
        elif n:
            whole = np.full(1, n, np.uint64) * SHORT
            for h in hashes[at : at + n]:
                whole = mixed(whole) * FACTOR + h
            out.append(mixed(whole))
        else:
            out.append(folded[:0])
        at += n
    return out
