"""Self-join of texts by the Jaccard similarity of their word shingles, exact and without pairs of copies.

1. Each text becomes a set of 64-bit shingle hashes, its tokens; texts with equal sets are one set from here on. Beside
   it stands a parity sketch: each token flips one bit. Two sets' sketches differ in at most as many bits as the sets
   have tokens apart, so the sketch rejects pairs but never a link.
2. All tokens of all texts are counted in a table that is dealt out by token, so it grows with the data and no task or
   driver holds it. Tokens counted more than RARE times are the frequent class; only these are kept.
3. Token-combination prefixes. Tokens are ordered rare ones first, then by hash. A set of n tokens can have at most e
   that a linked set lacks. Each of its rare tokens is a signature, up to the first e + 1. Where it has fewer, the prefix
   is extended into the frequent tokens. These are split by hash into classes, and every combination of K = 2 tokens of
   one class is a signature. p tokens of a class cover p - K + 1 of the e + 1: after taking away e tokens of the prefix,
   some rare token or K tokens of some class are left, so linked sets share a signature. The number of classes goes by
   the size of the smaller set, so a set makes combinations for each class of sizes that a linked smaller set can have.
4. The sets with a common signature stand in cells, cut where the next size is too far from the one before to be linked; a
   cell has the name of the least of its sets. Any linked pair shares a cell, and is looked at in the first that it shares. In a cell blocks of bounded size are held against each other: sizes and sketches
   pick the members that may have a link, and of these whole sets are counted exactly. A block gives sums of links and
   one edge a member to join its components; no step emits all pairs of a group.
5. The edges are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.components import components
from inkveil.llm.shingles import mixed, shingle_sets
from inkveil.llm.words import freed
from inkveil.session import Scratch, ship

#: Tokens counted more often than this are the frequent class.
RARE = 64
#: Tokens of a combination, and how many tokens of a prefix a class gets on average.
K, PER_CLASS = 2, 2.0
#: Bits of a token that are counted, tokens counted at a time, and frequent tokens up to which they are broadcast (8 bytes each).
COUNTED, BUFFER, BROADCAST_TOKENS = 40, 1 << 20, 4 << 20
#: Members of a cell that one group compares.
BLOCK = 1024
#: Tokens of one side of a block whose links are counted.
SIDE = 1 << 22
#: Bits of the filter that picks the texts to be counted exactly (a fixed 2 MB).
FILTER_BITS, PIECES = 1 << 24, 16
_SHIFT = np.uint64(64 - COUNTED)


def least_shared(n: int, top: int, bottom: int) -> int:
    """How many of a set's n tokens any linked set shares at least."""
    return -(-n * top // bottom)


def size_classes(upto: int, top: int, bottom: int) -> list[int]:
    """The smallest size of each class; a set and a linked one are in the same class or in neighbouring ones, but for small sizes."""
    at = [1]
    while at[-1] <= upto:
        at.append(max(at[-1] + 1, at[-1] * bottom // top))
    return at


def token_classes(size: int, top: int, bottom: int) -> int:
    """Classes of frequent tokens for sets of about this size: so many that few combinations cover a prefix, and no more than any set covers."""
    apart = size - least_shared(size, top, bottom)
    # with PER_CLASS tokens a class, one in PER_CLASS - 1 + exp(-PER_CLASS) of them counts for the prefix
    return max(1, min(int((apart + 1) / (PER_CLASS - 1 + np.exp(-PER_CLASS))), size - apart - 1))


def set_id(found: np.ndarray) -> int:
    """A 64-bit identifier of a set of hashes."""
    with np.errstate(over="ignore"):
        h = mixed(found).sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5))) * np.uint64(0x9E3779B97F4A7C15))
        return int(mixed(np.array([h + np.uint64(len(found))]))[0].astype(np.int64))


def sketch(found: np.ndarray) -> bytes:
    """One parity bit for each residue of the hashes; one to two times as many bits as the set has tokens, 64 at least."""
    bits = max(64, 1 << int(len(found)).bit_length())
    odd = (np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def folded(one: np.ndarray, size: int) -> np.ndarray:
    """A sketch with fewer bits: halves are added modulo two. Rows are sketches of 64-bit words."""
    while one.shape[-1] > size:
        half = one.shape[-1] // 2
        one = one[..., :half] ^ one[..., half:]
    return one


def combinations(frequent: np.ndarray, classes: int, seed: int, missing: int) -> np.ndarray:
    """Signatures of the shortest run of frequent tokens (in order) that covers so much: the pairs within each class."""
    with np.errstate(over="ignore"):
        salt = mixed(np.array([seed], np.uint64))[0]
        own = (mixed(frequent ^ salt) % np.uint64(classes)).astype(np.int64)
        fresh = np.zeros(len(own), bool)
        fresh[np.unique(own, return_index=True)[1]] = True
        length = int(np.searchsorted(np.cumsum(~fresh), missing)) + 1
        order = np.argsort(own[:length], kind="stable")
        tokens, own = frequent[:length][order], own[:length][order]
        out = []
        for d in range(1, length):
            same = np.flatnonzero(own[d:] == own[:-d])
            if not len(same):
                break
            out.append(mixed(mixed(tokens[same] + salt) * np.uint64(0x9E3779B97F4A7C15) + tokens[same + d]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def signatures(found: np.ndarray, often: np.ndarray, sizes: list[int], top: int, bottom: int) -> np.ndarray:
    """The signatures of a set (sorted tokens, and whether each is frequent)."""
    n = len(found)
    apart = n - least_shared(n, top, bottom)
    rare = found[~often][: apart + 1]
    if len(rare) > apart:
        return rare
    least, frequent, out = n - apart, found[often], [rare]
    for c, size in enumerate(sizes):
        if size > n:
            break
        if sizes[c + 1] > least:
            out.append(combinations(frequent, token_classes(size, top, bottom), c, apart + 1 - len(rare)))
    return np.concatenate(out)


def _record(fields: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)


_FIRST = pa.schema([("piece", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("set", pa.int64()), ("data", pa.binary())])
_FIRST_SQL = "piece int, kind int, id long, n int, set long, data binary"


def _begin(piece: int, pieces: int) -> np.uint64:
    """The least number of a piece; pieces are a power of two, 256 at least, so that a piece spans four bytes."""
    return np.uint64((int(piece) << COUNTED) // pieces)


def _first_pass(words: int, pieces: int):
    """A mapInArrow function over (id, text): a row for each text (kind 0), and tokens to be counted (kind 1), dealt to pieces by their upper bits.

    Tokens go as the gaps between sorted numbers, counted from where their piece begins, byte by byte (the upper ones are
    mostly zero). Of those that repeat in one buffer so many are sent that the sum is above RARE if it should be.
    """
    edges = np.array([_begin(k, pieces) for k in range(1, pieces)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, row = [], 0, 0

        def flushed():
            tokens = np.sort(np.concatenate(held) >> _SHIFT)
            tokens = tokens[np.r_[np.ones(min(RARE + 1, len(tokens)), bool), tokens[RARE + 1 :] != tokens[: -RARE - 1]]]
            at = np.r_[0, np.searchsorted(tokens, edges), len(tokens)]
            full = np.flatnonzero(np.diff(at))
            data = [np.diff(tokens[a:b], prepend=_begin(k, pieces)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for k, a, b in zip(full, at[full], at[full + 1], strict=True)]
            return _record(_FIRST, [full, [1] * len(full), [0] * len(full), np.diff(at)[full], [0] * len(full), data])

        for batch in freed(batches):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(part.column(1), words)
                ids = [set_id(x) if len(x) else None for x in sets]
                yield _record(_FIRST, [np.arange(row, row + len(ids)) % pieces, [0] * len(ids), part.column(0), [len(x) for x in sets], ids, [sketch(x) if len(x) else None for x in sets]])
                row += len(ids)
                fresh = {s: x for s, x in zip(ids, sets, strict=True) if len(x)}
                held += fresh.values()
                size += sum(map(len, fresh.values()))
                if size >= BUFFER:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return run


def _frequent(pieces: int):
    """A mapInArrow function over rows of the first pass, sorted by (piece, kind): those of texts as they are, and for each piece its frequent tokens (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = None, []

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = tokens[n > RARE] + _begin(piece, pieces)
            return _record(_FIRST, [[piece], [1], [0], [len(often)], [0], [often.astype("<u8").tobytes()]])

        for batch in freed(batches):
            kinds = np.asarray(batch.column(1))
            if (kinds == 0).any():
                yield batch.filter(pa.array(kinds == 0))
            for at in np.flatnonzero(kinds).tolist():
                if held and batch.column(0)[at].as_py() != piece:
                    yield counted()
                    held = []
                piece = batch.column(0)[at].as_py()
                gaps = np.frombuffer(batch.column(5)[at].as_buffer(), np.uint8).reshape(4, -1).T
                held.append(np.ascontiguousarray(gaps).view("<u4").ravel().cumsum(dtype=np.uint64))
        if held:
            yield counted()

    return run


def _signed(words: int, top: int, bottom: int, largest: int, often_of):
    """A mapInArrow function giving (signature, set, n); often_of tells for a batch's sets which of their tokens are frequent."""
    fields = pa.schema([("signature", pa.int64()), ("set", pa.int64()), ("n", pa.int32())])
    sizes = size_classes(largest, top, bottom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                known, n = {}, {}
                sets = shingle_sets(part.column(0), words)
                for found, often in zip(sets, often_of(sets, part), strict=True):
                    if len(found) and (s := set_id(found)) not in known:  # copies within the batch say the same
                        known[s], n[s] = signatures(found, often, sizes, top, bottom), len(found)
                if known:
                    sigs = list(known.values())
                    each = [len(x) for x in sigs]
                    yield _record(fields, [np.concatenate(sigs).view(np.int64), np.repeat(np.fromiter(known, np.int64, len(known)), each), np.repeat(np.fromiter(n.values(), np.int32, len(n)), each)])

    return run


def _in_sorted(sets: list[np.ndarray], frequent: np.ndarray) -> list[np.ndarray]:
    """For each set which of its tokens are among the sorted frequent ones."""
    if not len(frequent) or not sum(map(len, sets)):
        return [np.zeros(len(x), bool) for x in sets]
    tokens = np.concatenate(sets) >> _SHIFT
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return np.split(frequent[at] == tokens, np.cumsum([len(x) for x in sets])[:-1])


def _tokens(words: int):
    """A mapInArrow function over (id, text): (token, set) with the counted bits of each token, for tables of frequent tokens that aren't broadcast."""
    fields = pa.schema([("token", pa.int64()), ("set", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for i in range(0, batch.num_rows, 256):
                sets = {set_id(x): x for x in shingle_sets(batch.slice(i, 256).column(1), words) if len(x)}
                if sets:
                    yield _record(fields, [(np.concatenate(list(sets.values())) >> _SHIFT).astype(np.int64), np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(x) for x in sets.values()])])

    return run


def _named(words: int):
    """A mapInArrow function over (id, text): (set, text)."""
    fields = pa.schema([("set", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            yield _record(fields, [[set_id(x) if len(x) else None for x in shingle_sets(batch.column(1), words)], batch.column(1)])

    return run


def _places(ids: np.ndarray) -> list[np.ndarray]:
    h = mixed(ids.astype(np.int64).view(np.uint64))
    return [(h & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)]


def _wanted(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over a column of numbers."""
    step = FILTER_BITS // 8 // PIECES

    def fill(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in freed(batches):
            for at in _places(batch.column(0).to_numpy()):
                bits[at] = True
        packed = np.packbits(bits)
        full = [i for i in range(PIECES) if packed[i * step : (i + 1) * step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed[i * step : (i + 1) * step].tobytes() for i in full], pa.binary())], names=["piece", "data"])

    def join(batches):
        total: dict[int, np.ndarray] = {}
        for batch in freed(batches):
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(data.as_buffer(), np.uint8)
                total[piece] = total[piece] | got if piece in total else got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "data"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in ids.mapInArrow(fill, "piece int, data binary").repartition(PIECES, "piece").mapInArrow(join, "piece int, data binary").collect():
        out[r["piece"] * step : (r["piece"] + 1) * step] = np.frombuffer(r["data"], np.uint8)
    return out


def _texts(words: int, wanted):
    """A mapInArrow function over (id, text): (set, text) of those rows whose ids the filter lets through, and of rows without an id."""
    fields = pa.schema([("set", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in freed(batches):
            keys = batch.column(0)
            passes = np.asarray(keys.is_null())
            at = _places(keys.fill_null(0).to_numpy(zero_copy_only=False))
            passes |= np.logical_and.reduce([(bits[x >> 3] & (128 >> (x & 7)).astype(np.uint8)) > 0 for x in at])
            kept = batch.filter(pa.array(passes))
            ids = [set_id(x) if len(x) else None for x in shingle_sets(kept.column(1), words)]
            if ids:
                yield _record(fields, [ids, kept.column(1)])

    return run


def _by_group(batches, names: tuple[str, ...], each=None) -> Iterator[dict[str, list]]:
    """Columns of each group of equal (cell, i, j) from sorted rows; each makes values of a batch's last column."""
    key, rows = None, None
    for batch in freed(batches):
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            last = part.column(part.num_columns - 1)
            columns = [c.to_pylist() for c in part.columns[:-1]] + [each(last) if each else last.to_pylist()]
            for r in zip(*columns, strict=True):
                if r[:3] != key:
                    if rows is not None:
                        yield rows
                    key, rows = r[:3], {k: [] for k in names}
                for k, v in zip(names, r, strict=True):
                    rows[k].append(v)
    if rows is not None:
        yield rows


def _sides(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Which members of a group are held against which: all against all, or the blocks i and j."""
    i, j, side = rows["i"][0], rows["j"][0], np.array(rows["side"])
    every = np.arange(len(side))
    return (every, every) if i == j else (np.flatnonzero(side == i), np.flatnonzero(side == j))


def _hopeful(top: int, bottom: int):
    """A mapInArrow function over (cell, i, j, side, set, n, cells, data), sorted: (cell, set) that sizes and sketches let have a link there.

    cells are all cells of the set; a pair that shares an earlier one is looked at there.
    """
    fields = pa.schema([("cell", pa.int64()), ("set", pa.int64())])

    def run(batches):
        for rows in _by_group(batches, ("cell", "i", "j", "side", "set", "n", "cells", "data")):
            n = np.array(rows["n"], np.int64)
            left, right = _sides(rows)
            alone = rows["i"][0] == rows["j"][0]
            right = right[np.argsort(n[right], kind="stable")]
            size = n[right]
            sketches = [np.frombuffer(x, np.uint64) for x in rows["data"]]
            earlier = _Overlap([np.array([c for c in x if c < rows["cell"][0]], np.int64) for x in rows["cells"]])
            stacks: dict[int, np.ndarray] = {}  # sketches of the right side, folded to each width that occurs
            good = np.zeros(len(n), bool)
            for i in left.tolist():
                a, b = np.searchsorted(size, [least_shared(int(n[i]), top, bottom), n[i] * bottom // top + 1])
                if b - a <= alone:
                    continue
                width = min(len(sketches[i]), len(sketches[right[a]]))
                if width not in stacks:
                    stacks[width] = np.stack([folded(sketches[k], width) if len(sketches[k]) >= width else np.zeros(width, np.uint64) for k in right])
                here = a + np.flatnonzero((earlier.shared(i)[right[a:b]] == 0) & (right[a:b] != i))
                near = right[here]
                apart = np.bitwise_count(stacks[width][here] ^ folded(sketches[i], width)).sum(1, dtype=np.int64)
                near = near[apart <= (n[near] + n[i]) * (bottom - top) // (bottom + top)]
                good[near] = True
                good[i] |= len(near) > 0
            if good.any():
                found = np.array(rows["set"], np.int64)[good]
                yield _record(fields, [np.full(len(found), rows["cell"][0], np.int64), found])

    return run


class _Overlap:
    """How many elements each of some arrays of distinct values shares with one of them."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        sizes = [len(x) for x in arrays]
        owner = np.repeat(np.arange(len(arrays)), sizes)
        values, place, n = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
        several = (n > 1)[place]  # what one array has alone is shared with none
        self.owner, self.place = owner[several], place[several]
        self.ends, self.mask = np.searchsorted(self.owner, np.arange(len(arrays) + 1)), np.zeros(len(values), bool)

    def shared(self, i: int) -> np.ndarray:
        mine = self.place[self.ends[i] : self.ends[i + 1]]
        self.mask[mine] = True
        out = np.bincount(self.owner[self.mask[self.place]], minlength=len(self.ends) - 1)
        self.mask[mine] = False
        return out


def _counted(words: int, top: int, bottom: int):
    """A mapInArrow function over (cell, i, j, side, set, copies, cells, text), sorted: (set, links, other).

    links counts the partners' copies; other is a member that the set is connected with in this group. cells are all cells of the
    set; a pair that shares an earlier one isn't counted here, as it is there.
    """
    fields = pa.schema([("set", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(batches):
        for rows in _by_group(batches, ("cell", "i", "j", "side", "set", "copies", "cells", "text"), lambda texts: shingle_sets(texts, words)):
            once = sorted({s: k for k, s in enumerate(rows["set"])}.values())  # rows that share a key and a text
            rows = {k: [v[x] for x in once] for k, v in rows.items()}
            n, copies, sets = np.array([len(x) for x in rows["text"]], np.int64), np.array(rows["copies"], np.int64), np.array(rows["set"], np.int64)
            both, earlier = _Overlap(rows["text"]), _Overlap([np.array([c for c in x if c < rows["cell"][0]], np.int64) for x in rows["cells"]])
            left, right = _sides(rows)
            links, root = np.zeros(len(n), np.int64), np.arange(len(n))
            for i in left.tolist():
                near = right[(earlier.shared(i)[right] == 0) & (right != i)]
                if not len(near):
                    continue
                shared = both.shared(i)[near]
                linked = near[bottom * shared >= top * (n[near] + n[i] - shared)]
                if len(linked):
                    links[i] += copies[linked].sum()
                    if left is not right:
                        links[linked] += copies[i]
                    joined = np.unique(np.r_[root[i], root[linked]])
                    if len(joined) > 1:
                        root[np.isin(root, joined)] = joined[0]
            some = links > 0
            if some.any():
                other = np.arange(len(n))
                for members in np.split(np.argsort(root, kind="stable"), np.flatnonzero(np.diff(np.sort(root))) + 1):
                    other[members] = members[np.maximum(np.arange(len(members)) - 1, 0) // 16]  # a tree in which no member has many neighbours
                yield _record(fields, [sets[some], links[some], sets[other[some]]])

    return run


def jaccard_components(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, top: int = 80, bottom: int = 100, block: int = BLOCK, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id, n_links.

    Texts are linked when bottom * (shared shingles) >= top * (shingles of either). component_id is the smallest key
    that can be reached by links, itself included; n_links counts all other rows that the row is linked with, rows with an
    equal set included. key must be an integer; rows that
    share a key stay rows of their own. A row with a null key has component_id null unless another row's key is
    reached. Null, empty and blank texts have no shingles and their own key as component. Texts are read whole, however long.
    Columns of df other than text and key are left out, so none can clash. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard-join")
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    pieces = max(256, 1 << (4 * partitions - 1).bit_length())
    dealt = docs.mapInArrow(_first_pass(words, pieces), _FIRST_SQL).repartition(partitions, "piece").sortWithinPartitions("piece", "kind")
    first = scratch.save(dealt.mapInArrow(_frequent(pieces), _FIRST_SQL), "first")
    rows, often = first.filter("kind = 0"), first.filter("kind = 1 and n > 0").select("n", "data")
    per_set = rows.filter("n > 0").groupBy("set").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("data").alias("data"), F.count("*").alias("copies"))
    per_set = scratch.save(per_set, "sets")
    largest = per_set.agg(F.max("n")).first()[0] or 1

    if (often.agg(F.sum("n")).first()[0] or 0) <= broadcast_tokens:
        table = spark.sparkContext.broadcast(np.sort(np.concatenate([np.empty(0, "<u8"), *[np.frombuffer(r["data"], "<u8") for r in often.collect()]])))
        signed = docs.select("text").mapInArrow(_signed(words, top, bottom, largest, lambda sets, _: _in_sorted(sets, table.value)), "signature long, set long, n int")
    else:  # too many to broadcast: each set is sent its own frequent tokens

        def unpacked(batches):
            for batch in freed(batches):
                for data in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.as_buffer(), "<i8"))], names=["token"])

        met = docs.mapInArrow(_tokens(words), "token long, set long").join(often.select("data").mapInArrow(unpacked, "token long"), "token")
        own = met.groupBy("set").agg(F.collect_set("token").alias("tokens"))  # no more than a text has
        texts = docs.mapInArrow(_named(words), "set long, text string").filter("set is not null").join(own, "set", "left").select("text", "tokens")
        mine = lambda sets, part: [np.isin(x >> _SHIFT, np.array(t or [], np.uint64)) for x, t in zip(sets, part.column(1).to_pylist(), strict=True)]
        signed = texts.mapInArrow(_signed(words, top, bottom, largest, mine), "signature long, set long, n int")
    # a signature's sets by size, cut where neighbours are too far apart to be linked; a cell has the name of the least of its
    # sets, so that signatures of the same texts mostly agree on it. The windows stream a signature's rows, and spill
    by_size = "partition by signature order by n, set"
    begins = F.expr(f"coalesce(lag(n) over ({by_size}) * {bottom}L < n * {top}L, true)")
    run = F.expr(f"sum(cast(begins as int)) over ({by_size} rows between unbounded preceding and current row)")
    met = signed.withColumn("begins", begins).withColumn("run", run).withColumn("cell", F.expr("first(set) over (partition by signature, run order by set rows between unbounded preceding and current row)"))
    met = scratch.save(met.filter("cell <> set").select("cell", "set", "n").distinct(), "met")
    heads = met.select("cell").distinct().join(per_set.select(F.col("set").alias("cell"), "n"), "cell").select("cell", F.col("cell").alias("set"), "n")
    member = scratch.save(met.union(heads), "members")

    def blocks(members: DataFrame, *columns: str) -> DataFrame:
        """Members (cell, set, n) in pairs of blocks."""
        sizes = members.groupBy("cell").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).filter("size > 1")
        count = F.ceil(F.greatest(F.col("size") / block, F.col("tokens") / SIDE)).cast("int")
        placed = members.join(sizes.select("cell", count.alias("blocks")), "cell").withColumn("side", F.pmod(F.xxhash64("set"), F.col("blocks").cast("long")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return placed.select("cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "set", *columns)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def with_cells(members: DataFrame) -> DataFrame:
        """The cells of each set: no more than it has signatures."""
        return members.groupBy("set").agg(F.collect_list("cell").alias("cells"))

    described = blocks(member, "n").join(with_cells(member).join(per_set.select("set", "data"), "set"), "set")
    hopeful = grouped(described.select("cell", "i", "j", "side", "set", "n", "cells", "data")).mapInArrow(_hopeful(top, bottom), "cell long, set long").distinct()
    hopeful = scratch.save(hopeful, "hopeful")
    scratch.drop("met", "members")
    sizes = per_set.select("set", "id", "n", "copies")
    ends = blocks(hopeful.join(sizes.select("set", "n"), "set").select("cell", "set", "n")).join(with_cells(hopeful).join(sizes.drop("n"), "set"), "set")
    ends = scratch.save(ends.select("cell", "i", "j", "side", "set", "id", "copies", "cells"), "ends")
    run = _texts(words, spark.sparkContext.broadcast(_wanted(ends.select("id").filter("id is not null").distinct())))
    texts = docs.mapInArrow(run, "set long, text string")
    whole = grouped(ends.drop("id").join(texts, "set").select("cell", "i", "j", "side", "set", "copies", "cells", "text"))
    found = scratch.save(whole.mapInArrow(_counted(words, top, bottom), "set long, links long, other long"), "links")
    scratch.drop("ends", "hopeful")

    edges = found.filter("set <> other").select(F.col("set").alias("a"), F.col("other").alias("b")).distinct()
    joined = components(edges, scratch, "components").join(per_set.select(F.col("set").alias("node"), "id"), "node")
    lowest = joined.groupBy("component").agg(F.min("id").alias("lowest"))
    named = joined.join(lowest, "component").select("node", "lowest")
    counted = found.groupBy(F.col("set").alias("counted")).agg(F.sum("links").alias("links"))
    labels = per_set.join(named, per_set["set"] == named["node"], "left").join(counted, per_set["set"] == counted["counted"], "left")
    labels = scratch.save(labels.select(F.col("set").alias("label"), F.coalesce("lowest", "id").alias("lowest"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).filter("lowest is distinct from id or n_links > 0"), "labels")
    scratch.keep("first", "labels")
    slim = rows.select("id", "n", "set")
    out = slim.join(labels, slim["set"] == labels["label"], "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
