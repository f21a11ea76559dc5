"""Geometry on columns. Coordinates are bottom-left inside; regions of the public interface are top-left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest width and height of a bar for verifying and for auditing, the audit's inset, and the padding of regions.
VERIFY_BAR, AUDIT_BAR, INSET, PADDING = (5.0, 2.0), (5.0, 5.0), 1.0, 2.0

# Advance widths of the standard fonts (the public metrics of Helvetica and Times-Roman), in thousandths of the size.
_ORDER = "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789"
HELVETICA = dict(zip(_ORDER, (
    556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500,
    667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556), strict=True)) | {
    " ": 278, ".": 278, ",": 278, ":": 278, ";": 278, "-": 333, "/": 278, "!": 278, "?": 556, "(": 333, ")": 333, "[": 278, "]": 278,
    "{": 334, "}": 334, "_": 556, "+": 584, "=": 584, '"': 355, "'": 222, "`": 222, "@": 1015, "#": 556, "$": 556, "%": 889, "^": 469, "&": 722, "*": 389,
}
TIMES = dict(zip(_ORDER, (
    444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444,
    722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611,
    500, 500, 500, 500, 500, 500, 500, 500, 500, 500), strict=True)) | {" ": 250, ".": 250, ",": 250, ":": 278, ";": 278, "-": 333, "/": 278}
FONTS = {
    **{f"Helvetica{x}": (HELVETICA, 556) for x in ("", "-Bold", "-Oblique", "-BoldOblique")},
    **{f"Times-{x}": (TIMES, 500) for x in ("Roman", "Bold", "Italic", "BoldItalic")},
    **{f"Courier{x}": ({}, 600) for x in ("", "-Bold", "-Oblique", "-BoldOblique")},
    "Symbol": ({}, 600), "ZapfDingbats": ({}, 600),
}
FALLBACK = 556


def font(name: str | None) -> tuple[dict[str, int], int]:
    """Widths and default width of a font by name; unknown ones by what follows the last underscore, then a constant."""
    name = (name or "").removeprefix("/")
    return FONTS.get(name) or FONTS.get(name.rsplit("_", 1)[-1]) or ({}, FALLBACK)


def _kinds(name: str) -> list[int]:
    """The widths of a font other than its default."""
    widths, default = font(name)
    return sorted(set(widths.values()) - {default})


def width_coded(text: Column, name: str) -> Column:
    """A text with each character spelled as a letter for its width in a font."""
    widths, default = font(name)
    kinds = _kinds(name)
    spelled = "".join(chr(1 + k) for k in range(len(kinds) + 1))  # control characters, whose own width is the default
    return F.translate(text, "".join(widths) + spelled, "".join(spelled[kinds.index(w)] if w != default else spelled[-1] for w in widths.values()) + spelled[-1] * len(spelled))


def coded_moments(coded: Column, name: str) -> tuple[Column, Column]:
    """Sums of the advance widths and of their squares, from a text that width_coded() spelled."""
    _, default = font(name)
    length = F.length(coded).cast("long")
    first, second = length * default, length * default**2
    for k, w in enumerate(_kinds(name)):
        n = length - F.length(F.replace(coded, F.lit(chr(1 + k)), F.lit("")))
        first, second = first + n * (w - default), second + n * (w**2 - default**2)
    return first, second


def text_moments(text: Column, name: str = "Helvetica") -> tuple[Column, Column]:
    """Sums of the advance widths of a text's characters and of their squares (longs, in thousandths).

    One pass spells every width as a letter of its own, and the letters are counted, so it stays in generated code. That pass is
    made once where one projection has the sums; with_units() holds it apart from later expressions too.
    """
    return coded_moments(width_coded(text, name) if _kinds(name) else text, name)


def with_units(df: DataFrame, text: str, name: str = "Helvetica", units: str = "units") -> DataFrame:
    """df with the sum of a text's advances. Generated, not projected: conditions of joins that name it don't work it out again."""
    held = df.select("*", F.inline(F.array(F.struct(width_coded(F.col(text), name).alias("_coded")))))
    return held.select("*", F.inline(F.array(F.struct(coded_moments(F.col("_coded"), name)[0].alias(units))))).drop("_coded")


def text_units(text: Column, name: str = "Helvetica") -> Column:
    """Sum of the advance widths of a text's characters (long, in thousandths)."""
    return text_moments(text, name)[0]


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...], inset: float = 0.0) -> Column:
    """Whether rectangles (x1, y1, x2, y2) overlap; touching edges do not. b may be drawn in by an inset."""
    return (a[0] < b[2] - inset) & (a[2] > b[0] + inset) & (a[1] < b[3] - inset) & (a[3] > b[1] + inset)


def canonical(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)


def hex_color(text: Column) -> Column:
    """#rrggbb as three doubles; anything else is black."""
    good = text.rlike("^#?[0-9a-fA-F]{6}$")
    digits = F.regexp_replace(text, "^#", "")
    parts = [F.conv(F.substring(digits, k, 2), 16, 10).cast("double") / 255 for k in (1, 3, 5)]
    return F.when(good, F.array(*parts)).otherwise(F.array(*[F.lit(0.0)] * 3))
