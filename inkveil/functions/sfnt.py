"""Advance widths of embedded TrueType and OpenType fonts."""

from __future__ import annotations

import struct


def advances(data: bytes) -> dict[str, float]:
    """Advance of each character that the font's Unicode map has, in thousandths of the size; raises ValueError for other bytes."""
    try:
        count = struct.unpack_from(">H", data, 4)[0]
        tables = {data[at : at + 4]: struct.unpack_from(">II", data, at + 8) for at in range(12, 12 + 16 * count, 16)}
        units = struct.unpack_from(">H", data, tables[b"head"][0] + 18)[0]
        metrics = struct.unpack_from(">H", data, tables[b"hhea"][0] + 34)[0]
        widths = [struct.unpack_from(">H", data, tables[b"hmtx"][0] + 4 * k)[0] for k in range(metrics)]
        glyphs = _characters(data, tables[b"cmap"][0])
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError("not a font with widths and characters") from e
    if not units or not widths:
        raise ValueError("a font without units or widths")
    return {chr(c): widths[min(g, len(widths) - 1)] * 1000 / units for c, g in glyphs.items() if g}


def _characters(data: bytes, at: int) -> dict[int, int]:
    """Glyph of each code point, from the best of the font's maps."""
    count = struct.unpack_from(">H", data, at + 2)[0]
    found = {}
    for k in range(count):
        platform, encoding, offset = struct.unpack_from(">HHI", data, at + 4 + 8 * k)
        found[platform, encoding] = at + offset
    for kind in ((3, 10), (0, 4), (0, 6), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0)):
        if kind in found:
            return _map(data, found[kind])
    return {}


def _map(data: bytes, at: int) -> dict[int, int]:
    kind = struct.unpack_from(">H", data, at)[0]
    out: dict[int, int] = {}
    if kind == 12:
        for k in range(struct.unpack_from(">I", data, at + 12)[0]):
            first, last, glyph = struct.unpack_from(">III", data, at + 16 + 12 * k)
            out |= {c: glyph + c - first for c in range(first, min(last, 0x10FFFF) + 1)}
    elif kind == 4:
        n = struct.unpack_from(">H", data, at + 6)[0] // 2
        part = lambda place: struct.unpack_from(f">{n}H", data, place)
        ends, starts, deltas, offsets = part(at + 14), part(at + 16 + 2 * n), part(at + 16 + 4 * n), part(at + 16 + 6 * n)
        for k in range(n):
            for c in range(starts[k], ends[k] + 1):
                if c == 0xFFFF:
                    continue
                glyph = c
                if offsets[k]:
                    glyph = struct.unpack_from(">H", data, at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (c - starts[k]))[0]
                    if not glyph:
                        continue
                out[c] = (glyph + deltas[k]) & 0xFFFF
    return out
