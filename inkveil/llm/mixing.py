"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words. The share target / size is what each of its rows is copied on average; its
whole part is copied outright, the fraction is a probability. Pivotal rounding pairs two rows with fractional
probabilities and moves words from one to the other, at random but without changing any row's chance, until one of
the two is 0 or 1. The expected words of a pair stay what they were, so the words taken from a source differ from its
target only by the one row that is left in the end and is drawn by its probability: by less than its size. Rows meet in
the order of their sizes, largest first, so that large ones meet many others; with few rows the one left may be large.

The pairs form a reduction tree: the rows of a source are dealt to small groups by a hash; each group leaves at most
one row unresolved, and those meet in the next level's groups, of bounded size too, until a source has one left. No
task holds more than a few groups, however large a source is.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.session import Scratch, ship

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
CEILING = 2
SEED = 20_240_501
#: Rows that a group of the first level holds on average, and groups that one of a later level takes in.
GROUP_ROWS, FAN_IN = 2048, 512


def words(text: Column) -> Column:
    """Number of runs of other than the six ASCII white-space characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, ceiling: int = CEILING) -> dict[str | None, Fraction]:
    """A target for each source: share of all sizes by weight, never above ceiling times the source's size.

    Sources in code-point order, null last, take the weights in turn. What exceeds a ceiling is shared again by
    weight among the sources below theirs, until none exceeds it.
    """
    ordered = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for s, _ in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    size = dict(sizes)
    left, open_, found = share * sum(size.values()), set(ordered), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > ceiling * size[s]}
        if not full:
            return found | {s: left * weight[s] / total for s in open_}
        found |= {s: Fraction(ceiling * size[s]) for s in full}
        left -= sum(found[s] for s in full)
        open_ -= full
    return found


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> None:
    """Round p in place, in its order, until at most one entry is fractional.

    sum(p * size) stays what it was and every entry's expectation is its own p.
    """
    eps = 1e-9
    held = -1
    for i in range(len(p)):
        if p[i] < eps or p[i] > 1 - eps:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
        move = up if draws[i] * (up + down) < down else -down
        p[held] += move / a
        p[i] -= move / b
        for k in (held, i):
            if p[k] < eps or p[k] > 1 - eps:
                p[k] = round(p[k])
        if not 0 < p[held] < 1:
            held = i if 0 < p[i] < 1 else -1


def _draws(keys: np.ndarray, level: int) -> np.ndarray:
    """Uniform numbers that depend on the rows' keys and the level only, so that reruns agree (splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((SEED + level) % 2**64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / 2.0**53


def _groups(level: int, last: bool):
    """A function over partitions sorted by group: rounds each group, whole groups at a time."""

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        p, size, draw = rows["p"].to_numpy(copy=True), rows["size"].to_numpy().astype(float), _draws(rows["key"].to_numpy(), level)
        edges = np.flatnonzero(np.r_[True, rows["group"].to_numpy()[1:] != rows["group"].to_numpy()[:-1], True])
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            part = p[i:j]
            pivot(part, size[i:j], draw[i:j])
            if last:
                still = (part > 0) & (part < 1)
                part[still] = draw[i:j][still] < part[still]
        return rows.assign(p=p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            end = rows["group"].iloc[-1]
            whole = rows["group"].to_numpy() != end  # rows are sorted: the last group may go on
            rest = rows[~whole].reset_index(drop=True)
            if whole.any():
                yield done(rows[whole].reset_index(drop=True))
        if rest is not None:
            yield done(rest)

    return run


def _round(rows: DataFrame, level: int, last: bool) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group", F.desc("size"), "key").mapInPandas(_groups(level, last), rows.schema)


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, ceiling: int = CEILING, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of df: key, size, source_size, target, copies, taken.

    size counts words (null: 0), source_size sums them over the row's source (null is a source of its own), target
    is the source's target in words, copies how often the mix takes the row (at most ceiling) and taken = copies *
    size. Rows without words take the whole part of their source's share. Rows that repeat key and size are rounded each
    on its own; a null key is a key like any other. An empty table gives an empty result. The sources (never rows)
    come to the driver, with one number each. Texts are counted whole. Columns of df other than text, source and key are left out, so none can clash.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mix")
    sized = scratch.save(df.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size")), "sizes")
    per = [(r["source"], r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]
    goal = targets([(s, size) for s, size, _ in per], weights, share, ceiling)
    shares = []
    for number, (s, size, n) in enumerate(sorted(per, key=lambda x: (x[0] is None, x[0] or ""))):
        rate = min(goal[s] / size, Fraction(ceiling)) if size else Fraction(0)
        whole = rate.numerator // rate.denominator
        shares.append((number, s, int(size), float(goal[s]), int(whole), float(rate - whole), max(1, round(n / group_rows))))
    table = spark.createDataFrame(shares, "number int, source string, source_size long, target double, whole int, p double, salts int")
    rows = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["source"])).drop(table["source"])  # one row a source
    hashed = F.xxhash64("id", "size", F.lit(SEED))
    salt = F.pmod(hashed, F.col("salts").cast("long")).cast("int")
    rows = rows.withColumns({"key": hashed, "p": F.when(F.col("size") > 0, F.col("p")).otherwise(0.0), "salt": salt, "group": F.concat_ws("/", "number", salt)})
    wide = int(max([x[-1] for x in shares], default=1))
    cols = ["id", "key", "size", "source_size", "target", "whole", "p", "number", "salt", "group"]
    level, rows = 1, scratch.save(_round(rows.select(*cols), 1, False), "level1")
    scratch.drop("sizes")
    done = []
    while True:
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rows.filter(~fractional))
        level, last = level + 1, wide == 1
        wide = -(-wide // fan_in)
        salt = F.floor(F.col("salt") / fan_in).cast("int")
        rest = rows.filter(fractional).withColumns({"salt": salt, "group": F.col("number").cast("string") if last else F.concat_ws("/", "number", salt)})
        rows = scratch.save(_round(rest, level, last), f"level{level}")
        if last:
            done.append(rows)
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("p")).cast("int")
    return out.select(F.col("id").alias(key), F.col("size"), F.col("source_size"), F.col("target"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
