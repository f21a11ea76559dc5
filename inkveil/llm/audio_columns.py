"""Bytes as audio: lossless WAV columns, short-time Fourier transforms and spectral-peak fingerprints.

Bytes are stored as unsigned 8-bit mono samples by the wave module and read back by it. Frames of 576 samples, half
overlapping, go through a Hann window and a Fourier transform. In each of four bands of frequencies a frame's largest
magnitude is a peak if it is no smaller than that of the frames beside it. Each peak is paired with the next few
peaks; a pair gives a code (both frequencies and the frames between) and a time (the first peak's frame).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.session import ship

FRAME, HOP = 576, 288
RATE = 16_000
#: The first frequency of each band, and the one after the last; the constant part (0) belongs to none.
BANDS = (1, 12, 36, 108, 289)
#: Peaks that a peak is paired with, at most so many frames ahead.
FAN_OUT, REACH = 3, 63
#: Frames that are transformed at a time.
BLOCK = 2048


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """Bytes 255 appended up to a positive multiple of the unit."""
    return data + b"\xff" * (unit - len(data) % unit if len(data) % unit or not data else 0)


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the peak pairs, in order of time. Needs one frame of samples at least."""
    wave_ = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    frames = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[::HOP]
    where, height = [], []
    for i in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[i : i + BLOCK] * _WINDOW)).astype(np.float32)
        best = [power[:, a:b].argmax(1) + a for a, b in zip(BANDS[:-1], BANDS[1:], strict=True)]
        where.append(np.stack(best, 1))
        height.append(np.take_along_axis(power, where[-1], 1))
    where, height = np.concatenate(where), np.concatenate(height)
    edge = np.full((1, height.shape[1]), -1, np.float32)
    kept = (height >= np.concatenate([edge, height[:-1]])) & (height >= np.concatenate([height[1:], edge])) & (height > 0)
    time, band = np.nonzero(kept)
    pitch = where[time, band]
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        if len(time) > k:
            gap = time[k:] - time[:-k]
            near = gap <= REACH
            times.append(time[:-k][near])
            codes.append((pitch[:-k] << 15 | pitch[k:] << 6 | gap)[near])
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    times, codes = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def audio_columns(df: DataFrame, text: str = "text", key: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """One row per row of df: key, n_bytes, media (WAV, if kept), what was read back from it, and the fingerprint.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, times, codes (arrays
    of int), and media (binary). Null texts count as empty: one frame of bytes 255. Texts that repeat give equal
    rows. Other columns of df are left out, so none can clash. Texts are taken whole. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    fields = [("key", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("media", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, out = batch.slice(i, 64), []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = (t or "").encode()
                    media = to_wav(padded(data))
                    back = from_wav(media)
                    times, codes = fingerprint(back)
                    out.append((k, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), times, codes, media if keep_media else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f[1]) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=[f[0] for f in fields])

    schema = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>, media binary"
    out = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
    return out if keep_media else out.drop("media")


def feature_digest(df: DataFrame) -> DataFrame:
    """The fingerprint (arrays times and codes) and beside it one string: the SHA-256 of time:code, comma-joined; and how many pairs there are."""
    pairs = F.array_join(F.zip_with("times", "codes", lambda t, c: F.concat_ws(":", t.cast("string"), c.cast("string"))), ",")
    return df.withColumns({"feature": F.sha2(pairs, 256), "n_pairs": F.size("times").cast("long")})
