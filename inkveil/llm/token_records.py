"""Token ids as length-delimited binary records with an offset index.

A shard is two files. NAME.rec holds a record for each document, in ascending order of the key:

    length    8 bytes, unsigned: bytes of the payload
    check     4 bytes, unsigned: masked CRC-32 of the eight length bytes
    payload   flags (1 byte: 1 = the key is null, 2 = ids have four bytes), key (8 bytes, signed), ids (2 or 4 bytes each)
    check     4 bytes, unsigned: masked CRC-32 of the payload

NAME.idx holds 16 bytes a record: the offset of the record and the number of its ids, so that a reader can take
records in any order. All numbers are little-endian. A checksum is masked by rotating it right by 15 bits and adding
a constant, because checksums of data that hold checksums are weak.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.words import WordIds, freed, gathered, run_sums, strings, text_slices, utf8
from inkveil.session import Scratch, ship

#: The constant that masked checksums add (fixed value of the record format).
MASK_DELTA = 0xA282EAD8
NULL_KEY, WIDE = 1, 2
WRITE_BYTES = 4 << 20
#: What a byte of a word is: a letter, a digit, another plain character, or one that the cuts can't be sure of; and the same byte lower-cased.
LETTER, DIGIT, OTHER, UNSURE = range(4)
KINDS = np.array([LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else UNSURE if b < 32 or b == 127 or chr(b) in "'<" else OTHER for b in range(128)] + [UNSURE] * 128, np.uint8)
LOWER = np.array([ord(chr(b).lower()) for b in range(128)] + [*range(128, 256)], np.uint8)


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes lower-cased where that is sure, and their kinds. Letters from U+00C0 to U+00FF (two bytes, the first 0xC3) are plain ones too: composing leaves them alone."""
    out, kinds = LOWER[data], KINDS[data]
    at = np.flatnonzero(data == 0xC3)
    second = data[at + 1]
    kinds[at], kinds[at + 1] = LETTER, np.where((second == 0x97) | (second == 0xB7), UNSURE, LETTER)  # the signs for times and divided by
    out[at + 1] = second + 0x20 * (second < 0x9F)
    return out, kinds


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def record(key: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    payload = struct.pack("<Bq", NULL_KEY * (key is None) | WIDE * bool(wide), key or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def parsed(data: bytes, at: int) -> tuple[int | None, np.ndarray]:
    """Key and ids of the record at an offset; raises ValueError where a checksum differs."""
    length = data[at : at + 8]
    if len(length) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(length):
        raise ValueError(f"damaged length at byte {at}")
    payload = data[at + 12 : at + 12 + struct.unpack("<Q", length)[0]]
    if struct.unpack_from("<I", data, at + 12 + len(payload))[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    flags, key = struct.unpack_from("<Bq", payload)
    return None if flags & NULL_KEY else key, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9)


class Encoder:
    """Encodes texts with a tokenizers file, remembering the ids of what occurs between spaces.

    Texts are cut at spaces and line ends if the file is seen never to have a token there: it drops white space, and what it
    does before that (composing, lower-casing) doesn't reach across. Where it also lower-cases and splits digits one by
    one, plain runs (ASCII and the letters of Latin-1) are cut further into letters, single digits and the rest, as the tokenizer does.
    What the cuts can't be sure of (apostrophes, control characters, special tokens, other scripts) goes to the tokenizer between spaces, and with any
    other file whole texts do.
    """

    #: The pattern of tokenizers that take letters, single digits and other runs, without white space (a fixed value).
    RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts, self.plain = self._checked(json.loads(self.tokenizer.to_str()))
        self.words, self.parts = WordIds(self._fresh), WordIds(self._single)

    def _checked(self, file: dict) -> tuple[bool, bool]:
        """Whether texts may be cut at spaces, and plain runs further."""
        before = file.get("normalizer") or {}
        steps = before.get("normalizers", [before]) if before else []
        kinds = [x.get("type") for x in steps]
        blank = all(x.get("type") != "Replace" or x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in steps)
        parts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [file.get("pre_tokenizer") or {}])
        first, rest = parts[0], parts[1:]
        runs = first.get("type") == "Split" and first.get("pattern") == {"Regex": self.RUNS} and first.get("behavior") == "Removed" and first.get("invert") is True
        bytewise = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in rest)
        added = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not re.search(r"\s", x["content"]) and x["content"].startswith("<") for x in file.get("added_tokens", []))
        cuts = set(kinds) <= {"NFC", "Replace", "Lowercase"} and blank and runs and bytewise and added and not file.get("truncation") and not file.get("padding")
        return cuts, cuts and "Lowercase" in kinds

    def _single(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of what is one word to the tokenizer: many words together are one text."""
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(words), 2048):
            part = words.slice(i, 2048).to_pylist()
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            counts.append(np.bincount(e.word_ids, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    def _parts(self, data: np.ndarray, kinds: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """What the tokenizer takes as words within plain words: runs of letters, single digits, other runs; and how many each word has."""
        first = np.r_[True, kinds[1:] != kinds[:-1]][: len(kinds)] | (kinds == DIGIT)
        ends = np.cumsum(lengths)
        first[ends - lengths] = True
        return strings(data, np.r_[np.flatnonzero(first), len(data)]), run_sums(first, lengths)

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that stand between spaces."""
        data, edges = utf8(words)
        data, kinds = lowered(data)
        lengths = np.diff(edges)
        plain = (run_sums(kinds == UNSURE, lengths) == 0) & (lengths > 0) & self.plain
        inside = np.repeat(plain, lengths)
        parts, cuts = self._parts(data[inside], kinds[inside], lengths[plain])
        ids, each = self.parts.ids(parts)
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        counts = np.zeros(len(words), np.int64)
        counts[plain] = run_sums(each, cuts)
        counts[~plain] = [len(x) for x in whole]
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]  # the order in which ids stand in the pool
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return gathered(np.r_[ids, np.fromiter(chain.from_iterable(whole), np.int32)], starts, counts), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's begin (with the end of the last). Null texts have none."""
        texts = texts.fill_null("")
        if not self.cuts:
            ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.int32), *ids]), np.cumsum([0, *map(len, ids)])
        runs = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ids, each = self.words.ids(runs.values)
        return ids, np.r_[0, np.cumsum(each)][np.asarray(runs.offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _place(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _write(tokenizer: Callable[[], str], folder: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = _place(folder)
        name, own = f"{root}/shard-{task.partitionId():06d}", f"{root}/_{task.partitionId()}-{task.taskAttemptId()}"
        code, at, tokens, index = encoder(tokenizer()), 0, 0, []
        end = np.array([] if end_id is None else [end_id], np.int32)
        with files.open_output_stream(f"{own}.rec") as out:
            for batch in freed(batches):
                for i, n in text_slices(batch.column(1)):
                    part = batch.slice(i, n)
                    ids, edges = code.encode(part.column(1))
                    for key, a, b in zip(part.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        data = record(key, np.concatenate([ids[a:b], end]))
                        out.write(data)
                        index.append((at, b - a + len(end)))
                        at, tokens = at + len(data), tokens + b - a + len(end)
        if not index:
            files.delete_file(f"{own}.rec")
            return
        with files.open_output_stream(f"{own}.idx") as out:
            out.write(np.array(index, "<u8").tobytes())
        for kind in ("rec", "idx"):  # a second attempt writes the same bytes
            files.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([len(index)], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "records", "tokens"])

    return run


def write_records(df: DataFrame, tokenizer: Callable[[], str], folder: str, text: str = "text", key: str = "doc_id", end_id: int | None = 2, shards: int | None = None) -> list[tuple[int, int, int]]:
    """Encode every whole text and write it to shards in folder (a URI that all executors reach), ordered by key.

    tokenizer gives the path of the tokenizer file on the executor. Null texts count as empty; end_id (if any) is
    appended to each document. Rows with a null key come first; rows that share a key are ordered by their texts.
    Returns (shard, records, tokens) of each shard that has records: one line for each file, not for each row.
    """
    spark = df.sparkSession
    ship(spark)
    files, root = _place(folder)
    files.create_dir(root, recursive=True)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    return sorted(tuple(r) for r in dealt.mapInArrow(_write(tokenizer, folder, end_id), "shard int, records long, tokens long").collect())


def _read(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _place(folder)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{root}/shard-{shard:06d}"
                with files.open_input_stream(f"{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                ends = np.append(index[1:, 0], files.get_file_info(f"{name}.rec").size).astype(np.int64)
                with files.open_input_file(f"{name}.rec") as f:
                    first = 0
                    while first < len(index):  # some megabytes of records at a time
                        begin = int(index[first, 0])
                        last = max(first + 1, int(np.searchsorted(ends, begin + WRITE_BYTES, "right")))
                        data = f.read_at(int(ends[last - 1]) - begin, begin)
                        out = []
                        for at, n in index[first:last].tolist():
                            key, ids = parsed(data, at - begin)
                            if len(ids) != n:
                                raise ValueError(f"{name}: the index says {n} ids, the record has {len(ids)}")
                            out.append((key, start, n, zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                            start += n
                        columns = list(zip(*out, strict=True))
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["key", "start", "n_tokens", "ids_crc32", "ids"])
                        first = last

    return run


def read_records(spark, folder: str, shards: list[tuple[int, int, int]], key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row a record: key, start (ids before it in all shards), n_tokens, ids_crc32, and ids (array) if asked for.

    Checksums and the index are verified as the files are read.
    """
    ship(spark)
    starts, before = [], 0
    for shard, _, tokens in shards:
        starts.append((shard, before))
        before += tokens
    listed = spark.createDataFrame(starts, "shard int, start long").repartition(max(1, len(starts)))
    out = listed.mapInArrow(_read(folder, with_ids), "key long, start long, n_tokens long, ids_crc32 long, ids array<int>").withColumnRenamed("key", key)
    return out if with_ids else out.drop("ids")


def token_records(df: DataFrame, tokenizer: Callable[[], str], folder: str | None = None, **options) -> DataFrame:
    """Write df's token ids as records and read them back; folder defaults to one in the shared folder.

    Null texts count as empty, rows that repeat or share a key are records of their own, other columns of df are left out. An
    empty table has no files and gives an empty result.
    """
    folder = folder or Scratch(df.sparkSession, "token-records").path("shards")
    shards = write_records(df, tokenizer, folder, **options)
    return read_records(df.sparkSession, folder, shards, options.get("key", "doc_id"), with_ids=False)
