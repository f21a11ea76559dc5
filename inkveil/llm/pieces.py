"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

For every prefix of a word the pass keeps the last piece of the prefix's encoding. A merge-based model encodes a text
as pieces of which each two neighbours, joined, encode as themselves again; so the piece that ends at a position is
the one (there is one only) that its word's hash finds among the piece keys and that may stand behind the last piece
of the prefix before it. Words of all lengths advance together: from every character the hashes of the substrings that
begin there are made as long as a piece begins like them, and those of pieces are kept; then, at one distance from the
words' beginnings after the other, forbidden neighbours lose, and what is left is the back pointer. The pieces that the
back pointers use are compared letter by letter. Whether two pieces may be neighbours is worked out once a pair, by
merging their letters, and remembered.

Results equal the sentencepiece library's, with byte fallback for characters that no piece has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.words import WordIds, freed, gathered, run_sums, text_slices, utf8
from inkveil.session import ship

SPACE = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The longest word that advances with others; longer ones go through the same pass alone. Characters that advance together.
LONGEST, LETTERS = 40, 1 << 18
#: Pairs of pieces whose neighbourhood a worker remembers before it starts anew, and how many of them it holds apart as met lately.
PAIRS, LATE = 4_000_000, 4096
#: Bits of the numbers of places in the table of hashes (a byte each) and in that of pairs (8 bytes each).
HASH_BITS, PAIR_BITS = 21, 20
#: What stands behind a hash in its table: a piece, the beginning of a longer one.
WHOLE, BEGINNING = 1, 2


def _place(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Places of 64-bit numbers in a table."""
    return (numbers * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


class Pieces:
    """A sentencepiece model file as tables for the batched pass."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.bytes_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        own = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in own}
        self.names, self.unknown = names, n  # n stands for one character without a piece
        spelled = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.spelled_pool = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_lengths = np.array([len(x) for x in spelled], np.int64)
        self.spelled_starts = np.cumsum(self.spelled_lengths) - self.spelled_lengths
        self.widest = max(map(len, self.ids), default=1)
        self.keys, self.key_ids, self.letters = self._keys(own)
        low = min((self.score[i] for i in own), default=0.0) - 1
        self.rank = {names[i]: -1.0 - (self.score[i] - low) for i in own}  # the best score is the smallest number
        self._forget()
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        line = "" if "\n" in inner else "\\n"
        glued = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # a word: what no piece reaches across
        self.cut = re.compile("(?s).+" if glued else f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else ""))
        #: What the library sets before a text that is not empty.
        self.before = SPACE if names[next(iter(sp.encode("a")), 0)].startswith(SPACE) else ""
        self.words = WordIds(self._fresh)
        #: Whether texts may be cut at single spaces: no piece reaches across one or a line end, and a space stands before a text.
        self.by_runs = not glued and bool(line) and bool(self.before)

    def _keys(self, own: list[int]):
        letters = np.zeros((len(self.names) + 1, self.widest), np.uint32)
        hashes, self.sizes = np.zeros(len(own), np.uint64), np.zeros(len(self.names) + 1, np.int64)
        self.hints = np.zeros(1 << HASH_BITS, np.uint8)
        for k, i in enumerate(own):
            codes = np.array([ord(c) for c in self.names[i]], np.uint32)
            letters[i, : len(codes)], self.sizes[i] = codes, len(codes)
        for size in range(1, self.widest + 1):  # hashes of the first letters of all pieces that have as many
            long = np.flatnonzero(self.sizes[own] >= size)
            hashes[long] = hashes[long] * _BASE + letters[own, size - 1][long] + np.uint64(1)
            whole = self.sizes[own][long] == size
            np.bitwise_or.at(self.hints, _place(hashes[long], HASH_BITS), np.where(whole, WHOLE, BEGINNING).astype(np.uint8))
        order = np.argsort(hashes)
        return hashes[order], np.array(own, np.int32)[order], letters

    def merged(self, text: str) -> list[str]:
        """A short text's pieces, by merging the neighbours with the best score, the leftmost of equals."""
        parts, rank = list(text), self.rank
        worth = [rank.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False)]  # below 0, or 0: no piece
        while worth and (best := min(worth)) < 0:
            k = worth.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del worth[k]
            if k:
                worth[k - 1] = rank.get(parts[k - 1] + parts[k], 0.0)
            if k < len(worth):
                worth[k] = rank.get(parts[k] + parts[k + 1], 0.0)
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether piece b may stand behind a (-1: at the beginning)."""
        if self.unknown in (a, b):
            return self.unknown != a and a >= 0 and self.merged(self.names[a]) == [self.names[a]] or b == self.unknown or self.merged(self.names[b]) == [self.names[b]]
        if a >= 0 and self.names[a] + self.names[b] in self.ids:
            return False
        want = [self.names[b]] if a < 0 else [self.names[a], self.names[b]]
        return self.merged("".join(want)) == want

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b may stand behind its a: pairs are looked up in a table that has room for one a place, the rest by _found."""
        pair = (a.astype(np.int64) + 1) * (self.unknown + 1) + b
        at = _place(pair.view(np.uint64), PAIR_BITS)
        held = self.held[at]
        out = (held & 1).astype(bool)
        miss = np.flatnonzero(held >> 1 != pair)
        if len(miss):
            out[miss] = self._found(pair[miss])
            self.held[at[miss]] = pair[miss] * 2 + out[miss]
        return out

    def _found(self, pair: np.ndarray) -> np.ndarray:
        """Whether pairs may be neighbours; they are looked up in two sorted arrays, the second of those met lately."""
        out, left = np.zeros(len(pair), bool), np.ones(len(pair), bool)
        for keys, good in self.pairs:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                hit = keys[at] == pair
                out |= hit & good[at]
                left &= ~hit
        if left.any():
            fresh, back = np.unique(pair[left], return_inverse=True)
            good = np.array([self._may_follow(p // (self.unknown + 1) - 1, p % (self.unknown + 1)) for p in fresh.tolist()], bool)
            out[left] = good[back]
            (old, old_good), (late, late_good) = self.pairs
            late, late_good = np.r_[late, fresh], np.r_[late_good, good]
            if len(late) > LATE:
                late, late_good, old, old_good = late[:0], late_good[:0], np.r_[old, late], np.r_[old_good, late_good]
                order = np.argsort(old)
                old, old_good = old[order], old_good[order]
            order = np.argsort(late)
            self.pairs = [(old, old_good), (late[order], late_good[order])]
        return out

    def _matches(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces seem to end, their sizes and ids, in order of size; a character without a piece is one of its own. room: characters from a place to its word's end."""
        start = np.flatnonzero(room)
        h, found = np.zeros(len(start), np.uint64), []
        for size in range(1, self.widest + 1):
            h = h * _BASE + codes[start + (size - 1)] + np.uint64(1)
            hints = self.hints[_place(h, HASH_BITS)]
            rows = np.arange(len(start)) if size == 1 else np.flatnonzero(hints & WHOLE)
            at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
            same = self.keys[at] == h[rows]
            if size == 1:
                piece = np.where(same, self.key_ids[at], np.int32(self.unknown))
            else:
                rows, piece = rows[same], self.key_ids[at[same]]
            found.append(((start[rows] + (size - 1)).astype(np.int32), np.full(len(rows), size, np.int32), piece))
            more = np.flatnonzero((hints & BEGINNING > 0) & (room[start] > size))
            start, h = start[more], h[more]
            if not len(start):
                break
        end, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return end, size, piece

    def _advance(self, words: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of words, one behind the other, how many each has, and whether it is right (False: two substrings' hashes clash)."""
        n, ends = len(words), np.cumsum(lengths + 1) - 1  # the words stand one behind the other, each behind an empty place
        total = int(ends[-1]) + 1
        word = np.repeat(np.arange(n, dtype=np.int32), lengths + 1)
        step = np.arange(total) - (ends - lengths)[word]  # characters of the word up to here
        codes = np.zeros(total, np.uint32)
        codes[step > 0] = np.frombuffer(utf8(words)[0].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        end, size, piece = self._matches(codes, np.where(step > 0, ends[word] - np.arange(total) + 1, 0))
        last, width = np.full(total, -1, np.int32), np.zeros(total, np.int32)
        far = step[end].astype(np.uint8)  # sorted in one go; LONGEST is less than 256
        order = np.argsort(far, kind="stable")
        end, size, piece, stops = end[order], size[order], piece[order], np.cumsum(np.bincount(far))
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            good = np.flatnonzero(self.may_follow(last[end[a:b] - size[a:b]], piece[a:b])) + a
            last[end[good]], width[end[good]] = piece[good], size[good]  # in order of size: the longest is written last
        used, right, at = np.zeros(total, bool), np.ones(n, bool), ends[lengths > 0]
        while len(at):  # follow the back pointers of all words at once
            used[at] = True
            moves = width[at]
            right[word[at[moves == 0]]] = False
            at = (at - moves)[moves > 0]
            at = at[step[at] > 0]
        at = np.flatnonzero(used)
        piece, size = last[at], width[at]
        wrong = (piece != self.unknown) & (self.sizes[piece] != size)
        for k in range(int(size.max(initial=0))):
            rows = np.flatnonzero((size > k) & (piece != self.unknown))
            wrong[rows] |= self.letters[piece[rows], k] != codes[at[rows] - size[rows] + 1 + k]
        right[word[at[wrong]]] = False
        at = at[right[word[at]]]
        return *self._spelled(last[at], codes[at], word[at], n), right

    def _spelled(self, flat: np.ndarray, codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with characters that no piece has as bytes, and how many each of n words has."""
        odd = np.flatnonzero(flat == self.unknown)
        if not len(odd):
            return flat.astype(np.int32), np.bincount(row, minlength=n)
        spelled = {k: self.fallback(chr(codes[k])) for k in odd.tolist()}
        sizes = np.ones(len(flat), np.int64)
        sizes[odd] = [len(x) for x in spelled.values()]
        out = np.repeat(flat, sizes)
        starts = np.cumsum(sizes) - sizes
        for k, x in spelled.items():
            out[starts[k] : starts[k] + len(x)] = x
        return out.astype(np.int32), np.bincount(row, sizes, n).astype(np.int64)

    def fallback(self, letter: str) -> list[int]:
        return [self.bytes_ids[b] for b in letter.encode("utf-8", "surrogatepass")]

    def _one(self, word: str) -> np.ndarray:
        """A long word's pieces: the same pass, one position after the other."""
        last, width = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        base, pairs = self.unknown + 1, {}
        for e in range(1, len(word) + 1):
            for size in range(min(self.widest, e), 0, -1):
                piece = self.ids.get(word[e - size : e], self.unknown if size == 1 else -1)
                if piece < 0:
                    continue
                pair = (last[e - size] + 1) * base + piece
                good = pairs.get(pair)
                if good is None:
                    good = pairs[pair] = self._may_follow(last[e - size], piece)
                if good:
                    last[e], width[e] = piece, size
                    break
        used, e = [], len(word)
        while e:
            if not width[e]:
                raise ValueError(f"no pieces for {word!r}")
            used.append([last[e]] if last[e] != self.unknown else self.fallback(word[e - 1]))
            e -= width[e]
        return np.array([x for ids in reversed(used) for x in ids], np.int32)

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of runs that stood between spaces, the space before them included unless they begin with a line end."""
        if pc.any(pc.match_substring(words, SPACE)).as_py():
            return self._of_parts([self.cut.findall(w if w[:1] == "\n" else SPACE + w) for w in words.to_pylist()])
        return self._viterbi(pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(SPACE, words, "")))

    def _of_parts(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        coded = pa.array([x for c in cut for x in c], pa.string()).dictionary_encode()
        pool, each = self._viterbi(coded.dictionary)
        own = np.asarray(coded.indices)
        return gathered(pool, (np.cumsum(each) - each)[own], each[own]), run_sums(each[own], np.array([len(c) for c in cut], np.int64))

    def _viterbi(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of words, and how many each has; those that aren't long advance together."""
        if len(self.pairs[0][0]) > PAIRS:
            self._forget()
        lengths = np.asarray(pc.utf8_length(words)).astype(np.int64)
        out, order, counts, alone = [np.empty(0, np.int32)], [], np.zeros(len(words), np.int64), lengths > LONGEST
        short = np.flatnonzero(~alone)
        ends, i = np.cumsum(lengths[short]), 0
        while i < len(short):
            stop = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LETTERS, "right")))
            part = short[i:stop]
            ids, counts[part], right = self._advance(words.take(pa.array(part)), lengths[part])
            alone[part] = ~right
            out.append(ids)
            order.append(part[right])
            i = stop
        for k in np.flatnonzero(alone).tolist():
            out.append(self._one(words[k].as_py()))
            order.append([k])
            counts[k] = len(out[-1])
        order = np.concatenate([np.empty(0, np.int64), *order]).astype(np.int64)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return gathered(np.concatenate(out), starts, counts), counts

    def _forget(self) -> None:
        self.pairs = [(np.empty(0, np.int64), np.empty(0, bool))] * 2
        self.held = np.full(1 << PAIR_BITS, -1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's begin (with the end of the last). Null texts have none."""
        texts = texts.fill_null("")
        # a line end is a part of its own, and no space belongs to what stands behind it
        runs = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words, edges = runs.values, np.asarray(runs.offsets).astype(np.int64)
        odd = np.asarray(pc.or_(pc.equal(pc.binary_length(words), 0), pc.ends_with(words, SPACE)))  # spaces in a row, and at the ends
        alone = np.add.reduceat(np.r_[odd, False].astype(np.int64), edges[:-1]) > 0 if len(texts) else np.empty(0, bool)
        if not self.by_runs:
            alone[:] = True
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        if not alone.any():
            ids, each = self.words.ids(words)
            return ids, np.r_[0, np.cumsum(each)][edges]
        rest = np.flatnonzero(~alone)
        if len(rest):
            ids, each = self.words.ids(words.filter(pa.array(np.repeat(~alone, np.diff(edges)))))
            ends = np.r_[0, np.cumsum(each)][np.cumsum(np.r_[0, np.diff(edges)[rest]])]
            counts[rest] = np.diff(ends)
        whole = [self.before + t.replace(" ", SPACE) if t else "" for t in texts.filter(pa.array(alone)).to_pylist()]
        pool, each = self._of_parts([self.cut.findall(t) for t in whole])
        own = np.split(pool, np.cumsum(each)[:-1])
        at = 0
        for k, single in enumerate(alone.tolist()):
            if single:
                out.append(own[at])
                counts[k], at = len(out[-1]), at + 1
            else:
                j = int(np.searchsorted(rest, k))
                out.append(ids[ends[j] : ends[j + 1]])
        return np.concatenate([np.empty(0, np.int32), *out]), np.r_[0, np.cumsum(counts)]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The texts of ids (each from one edge to the next). The escape for spaces (U+2581) always reads as a space."""
        lengths = self.spelled_lengths[ids]
        at = np.r_[0, np.cumsum(lengths)][edges].tolist()
        data = gathered(self.spelled_pool, self.spelled_starts[ids], lengths).tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        return [t.removeprefix(" ") for t in texts] if self.before else texts


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's tables for a model file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_texts(df: DataFrame, model: Callable[[], str], text: str = "text", out: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """df with the ids of each whole text (array<int>), and the text decoded from them again if decoded names a column.

    model gives the model file's path on the executor. A null text has null ids; an empty one has none. Texts are
    encoded whole, rows that repeat each. Columns of df with the new names are replaced. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    df = df.drop(out, *([decoded] if decoded else []))
    names = df.columns
    more = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = T.StructType([*df.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model())
        where = names.index(text)
        for batch in freed(batches):
            for i, n in text_slices(batch.column(where)):
                part = batch.slice(i, n)
                texts = part.column(where)
                ids, edges = own.encode(texts)
                nulls = texts.is_null()
                offsets = pa.array(edges, pa.int32(), mask=np.r_[np.asarray(nulls), False])
                more = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
                if decoded:
                    more.append(pc.if_else(nulls, None, pa.array(own.decode(ids, edges), pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, out, *([decoded] if decoded else [])])

    return df.mapInArrow(run, schema)


def piece_digests(df: DataFrame, model: Callable[[], str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of df: key, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers), text_sha256 of what the ids decode to, and whether that is the text again.

    Null texts count as empty. Rows that repeat give equal rows; other columns of df are left out. An empty table gives an empty result.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in freed(batches):
            for i, n in text_slices(batch.column(1)):
                part = batch.slice(i, n)
                texts = part.column(1).fill_null("")
                ids, edges = own.encode(texts)
                back, raw, at = own.decode(ids, edges), memoryview(ids.astype("<i4").tobytes()), (4 * edges).tolist()
                digests = [sha(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                same = pc.equal(texts, pa.array(back, texts.type))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edges)), pa.array(digests), pa.array([sha(t.encode()) for t in back]), same], names=["key", "n_pieces", "ids_sha256", "text_sha256", "round_trip"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, n_pieces long, ids_sha256 string, text_sha256 string, round_trip boolean").withColumnRenamed("key", key)
