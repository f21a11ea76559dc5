"""Word shingles of texts as 64-bit hashes, computed for whole Arrow batches at a time with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte at each of 32 places; later places reuse them times a power of an odd number.
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (32, 256)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread bits for each number (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, A-Z lower-cased, and where each text's words begin (with the end of the last).

    Words are what stands between ASCII white space; null texts have none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[raw]
    first = inside.copy()  # a word begins where the byte before is white space, or where a text begins
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins_text = at[inside[at]]
    first[1:] &= ~inside[:-1]
    first[begins_text] = True
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    letters = np.flatnonzero(inside)
    begins = np.flatnonzero(first[letters])  # the same starts, counted in letters
    lengths = np.diff(np.append(begins, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        value = _TABLE.ravel().take(((place & 31) << 8) + _LOWER.take(raw[letters]))
        if lengths.max() > 32:
            far = place >= 32
            value[far] *= np.power(_ODD, (place[far] >> 5).astype(np.uint64))
        sums = np.add.reduceat(value, begins)
    return mixed(sums), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, words: int, rows: int = 256) -> list[np.ndarray]:
    """For each text its distinct shingles, as sorted 64-bit hashes.

    A text with fewer words has the whole sequence as its one shingle; a text without words, or null, has none.
    """
    return [s for i in range(0, len(texts), rows) for s in _sets(texts.slice(i, rows), words)]


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    hashes, edges = word_hashes(texts)
    with np.errstate(over="ignore"):
        run = hashes * np.uint64(2 * words + 1)
        for k in range(1, words):
            run = mixed(run[:-1] ^ np.uint64(k)) * _ODD + hashes[k:] if len(run) > 1 else run[:0]
        run = mixed(run)
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= words:
                found = np.sort(run[a : b - words + 1])
                fresh = np.empty(len(found), bool)
                fresh[0] = True
                np.not_equal(found[1:], found[:-1], out=fresh[1:])
                out.append(found[fresh])
            elif b > a:
                h = np.uint64(b - a)
                for x in hashes[a:b]:
                    h = mixed(np.array([h * _ODD + x]))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out
