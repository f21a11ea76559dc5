"""Blanking of text inside page content streams; every function keeps the length of the bytes."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from inkveil.session import ship

#: How far from a region a string may begin and still be blanked.
MARGIN = 10.0
_SPACE = b" \t\n\r"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")


def _string_end(data: bytes, at: int) -> int:
    """Where the literal string that opens at a place ends (behind its closing parenthesis)."""
    depth, at = 1, at + 1
    while at < len(data) and depth:
        c = data[at]
        if c == 0x5C:
            at += 2
            continue
        depth += (c == 0x28) - (c == 0x29)
        at += 1
    return min(at, len(data))


def _tokens(data: bytes):
    """(kind, start, end): strings, hex strings, and other words; dictionaries' brackets are words."""
    at, n = 0, len(data)
    while at < n:
        c = data[at]
        if c == 0x28:
            end = _string_end(data, at)
            yield "string", at, end
        elif c == 0x3C and data[at + 1 : at + 2] != b"<":
            end = data.find(b">", at)
            end = n if end < 0 else end + 1
            yield "hex", at, end
        elif c in b"<>" and data[at : at + 2] in (b"<<", b">>"):
            end = at + 2
            yield "word", at, end
        elif c in _SPACE or c in b"[]>)":
            end = at + 1
        else:
            end = at
            while end < n and data[end] not in b" \t\n\r()<>[]":
                end += 1
            yield "word", at, end
        at = end


def _blank(out: bytearray, kind: str, start: int, end: int) -> None:
    if kind == "string":
        closed = end - 1 if out[end - 1 : end] == b")" else end
        out[start + 1 : closed] = b" " * (closed - start - 1)
    else:
        closed = end - 1 if out[end - 1 : end] == b">" else end
        out[start + 1 : closed] = b"0" * (closed - start - 1)


def decimal(data: bytes, at: int) -> tuple[float, int] | None:
    """The number that begins at a place, and where it ends; None if there is none. A digit may be missing before the point; there are no exponents."""
    m = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)").match(data, at)
    return (float(m[0]), m.end()) if m else None


def numbers_before(data: bytes, end: int, n: int, start: int = 0) -> list[float] | None:
    """The last n numbers in a row before a place, None if there are fewer; strings and other words interrupt them."""
    numbers: list[float] = []
    for kind, a, b in _tokens(data[:end]):
        if a < start:
            continue
        if kind == "word" and _NUMBER.match(data[a:b]):
            numbers.append(float(data[a:b]))
        else:
            numbers = []
    return numbers[-n:] if n and len(numbers) >= n else None


def is_operator(data: bytes, at: int, word: bytes) -> bool:
    """Whether an operator stands at a place: the word, and behind it a blank, a delimiter or the end."""
    after = data[at + len(word) : at + len(word) + 1]
    return data[at : at + len(word)] == word and (not after or after in b" \t\n\r()<>[]/%")


def blank_all(data: bytes, kinds: tuple[str, ...] = ("string", "hex")) -> bytes:
    """All text strings blanked: literal strings by spaces, hex strings by zeros."""
    out = bytearray(data)
    for kind, start, end in _tokens(data):
        if kind in kinds and end - start > 1:
            _blank(out, kind, start, end)
    return bytes(out)


def blank_regions(data: bytes, regions: list[tuple[float, float, float, float]]) -> bytes:
    """Strings of text objects blanked whose position lies within MARGIN of one of the regions (x1, y1, x2, y2)."""
    out, inside, x, y = bytearray(data), False, 0.0, 0.0
    numbers: list[float] = []
    for kind, start, end in _tokens(data):
        if kind == "word":
            word = data[start:end]
            if _NUMBER.match(word):
                numbers.append(float(word))
                continue
            if word == b"BT":
                inside, x, y = True, 0.0, 0.0
            elif word == b"ET":
                inside = False
            elif word == b"Tm" and len(numbers) >= 6:
                x, y = numbers[-2:]
            elif word in (b"Td", b"TD") and len(numbers) >= 2:
                x, y = x + numbers[-2], y + numbers[-1]
        elif inside and end - start > 1 and any(a - MARGIN <= x <= c + MARGIN and b - MARGIN <= y <= d + MARGIN for a, b, c, d in regions):
            _blank(out, kind, start, end)
        numbers = []
    return bytes(out)


#: Another name under which all text of a stream is blanked, whatever region is asked for.
blank_text_operators = blank_all


def blank_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """All strings blanked that lie within certain bytes."""
    out, spans = bytearray(data), sorted(spans)
    for start, end in spans:
        for kind, a, b in _tokens(data[start:end]):
            if kind in ("string", "hex") and b - a > 1:
                _blank(out, kind, start + a, start + b)
    return bytes(out)


def deflated(data: bytes) -> bytes:
    return zlib.compress(data)


def inflated(data: bytes) -> bytes:
    """A compressed stream's bytes; with or without a zlib header."""
    try:
        return zlib.decompress(data)
    except zlib.error:
        return zlib.decompress(data, -15)


def blank_stream(content: Column) -> Column:
    """blank_all for a binary column, in Arrow batches."""
    if spark := SparkSession.getActiveSession():
        ship(spark)

    @F.pandas_udf("binary")
    def blanked(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else blank_all(bytes(b)))

    return blanked(content)
