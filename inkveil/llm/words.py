"""Ids of texts by their words: Arrow splits and numbers the words, ids are gathered from a pool of those already known."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time (one text at least), and words (and their bytes) a worker remembers before it starts anew.
TEXT_BYTES, REMEMBERED, REMEMBERED_BYTES = 4 << 20, 600_000, 64 << 20
#: Powers of an odd number, by which hashes weigh the bytes of a word.
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; behind the last the worker gives back the memory that Arrow and malloc hold in reserve, as it stays alive for later stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def text_slices(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts that together hold no more than so many bytes, or one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop - at
        at = stop


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at starts, one behind the other."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def run_sums(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of lengths over runs of so many entries each."""
    ends = np.cumsum(counts)
    sums = np.r_[0, np.cumsum(lengths)]
    return sums[ends] - sums[ends - counts]


def utf8(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, one behind the other, and where each word's begin (with the end of the last)."""
    if not len(words):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, edges, data = words.buffers()
    edges = np.frombuffer(edges, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
    return data, edges - edges[0]


def strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The words whose bytes stand one behind the other, each from one edge to the next."""
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(np.ascontiguousarray(edges, np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit number of each word's bytes: a sum of products, so that all words take a few passes."""
    data, edges = utf8(words)
    place = np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_POWERS[place & len(_POWERS) - 1] * (data + np.uint64(1)), out=sums[1:])
    return sums[edges[1:]] - sums[edges[:-1]]


class WordIds:
    """Ids of words: encode gives those of words that aren't known yet, one behind the other, and how many each has.

    Known words are one Arrow array, which takes a fraction of the memory of Python strings. They are found by their
    hashes, which are sorted, and compared as a whole; one whose hash is another's too is encoded anew each time.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.known, self.hashes, self.numbers = pa.array([], pa.string()), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.starts, self.lengths, self.pool, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, np.int32), 0

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> None:
        found, lengths = self.encode(words)
        if self.used + len(found) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(found), len(self.pool)), np.int32)])
        self.pool[self.used : self.used + len(found)] = found
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order], "right")  # behind equal ones
        self.hashes, self.numbers = np.insert(self.hashes, at, hashes[order]), np.insert(self.numbers, at, len(self.known) + order)
        self.known = pa.concat_arrays([self.known, words])
        self.starts = np.r_[self.starts, self.used + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.used += len(found)

    def _numbers(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, or -1 where it isn't known."""
        if not len(self.known):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        own = np.where(self.hashes[at] == hashes, self.numbers[at], -1)
        met = np.flatnonzero(own >= 0)
        same = pc.equal(self.known.take(pa.array(own[met])), words.take(pa.array(met)))
        own[met[~np.asarray(same)]] = -1
        return own

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind the other, and how many each has."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        if len(self.known) > REMEMBERED or self.known.nbytes + distinct.nbytes > REMEMBERED_BYTES:
            self._empty()
        hashes = hashed(distinct)
        own = self._numbers(distinct, hashes)
        fresh = own < 0
        if fresh.any():
            own[fresh] = np.arange(len(self.known), len(self.known) + np.count_nonzero(fresh))
            self._learn(distinct.filter(pa.array(fresh)), hashes[fresh])
        each = own[np.asarray(coded.indices)]
        lengths = self.lengths[each]
        return gathered(self.pool, self.starts[each], lengths), lengths
