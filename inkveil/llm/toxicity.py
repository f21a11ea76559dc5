"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words and the beginnings of these words, hashed. One weight vector is shared by all
ordered thresholds: P(grade >= k) = sigmoid(w * x - threshold k). The weights are fitted on a bounded sample of labelled
rows on the driver (Newton steps over the features that toxic rows have more often than clean ones, with a
ridge penalty that is small for those that surely do); the
expected severity is the sum of P(grade >= k).

Labels say whether a text is toxic. Severity grades are derived from them: 0 for clean rows; toxic rows are 2
if they have more telling words (words of several toxic rows and no clean one of the sample) than the median, else 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.words import freed
from inkveil.session import ship

#: Most labelled rows that the model is fitted on; they are those with the smallest hashes of their keys.
SAMPLE = 10_000
#: Features are hashed into so many weights.
DIMENSIONS = 1 << 18
PREFIXES = (4, 5)
#: The most features (those that differ most surely), the penalty of their weights, and the most Newton steps.
FEATURES, RIDGE, ROUNDS = 1000, 0.3, 40
#: Rows of the rarer kind weigh more, up to so many times.
HEAVIER = 2.0
#: Features enter the model whose share of toxic rows exceeds that of clean rows by so many standard errors.
TELLING = 4.0
#: Rows whose chance of a grade of 1 or more exceeds this are rejected.
REJECT = 0.5
_WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 100_000
#: Rows that a step of the fit turns into floating point at a time.
BLOCK = 1024


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % DIMENSIONS


def word_features(word: str) -> list[int]:
    return [_hash("=" + word), *[_hash(word[:k] + "*") for k in PREFIXES if len(word) >= k]]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, float] = {}

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at, self.weights[at], self.thresholds

    def __setstate__(self, state):
        at, values, self.thresholds = state
        self.weights, self.known = np.zeros(DIMENSIONS), {}
        self.weights[at] = values

    def margin(self, text: str | None) -> float:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, total = self.known, 0.0
        for w in sorted(distinct_words(text)):  # in a fixed order, so that reruns agree to the last bit
            v = known.get(w)
            if v is None:
                v = known[w] = float(self.weights[word_features(w)].sum())
            total += v
        return total

    def chances(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each k from 1, one column each."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds, -40, 40)))


def grades(words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Severity grades of labelled rows; words has the distinct word numbers of each."""
    out = toxic.astype(np.int64)
    bad, clean = [w for w, t in zip(words, toxic, strict=True) if t], [w for w, t in zip(words, toxic, strict=True) if not t]
    if bad:
        ids, n = np.unique(np.concatenate(bad), return_counts=True)
        telling = np.setdiff1d(ids[n >= 4], np.concatenate(clean) if clean else ids[:0])
        found = np.array([np.isin(w, telling).sum() for w in bad])
        out[toxic == 1] += found > np.median(found)
    return out


def fit(rows: list[np.ndarray], grade: np.ndarray, levels: int = 2, ridge: float = RIDGE, most: int = FEATURES, rounds: int = ROUNDS) -> Ordinal:
    """Fit to rows (each an array of feature numbers, repeats counted) and their grades."""
    # a feature of few rows says nothing that would hold elsewhere, one as frequent in either kind of rows says nothing
    bad = grade > 0

    def block(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row (from i) and number of each feature of BLOCK rows."""
        part = rows[i : i + BLOCK]
        return np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part).astype(np.int64)

    in_bad, in_all = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
    for i in range(0, len(rows), BLOCK):
        of, at = block(i)
        of, at = np.divmod(np.unique(of * DIMENSIONS + at), DIMENSIONS)
        in_all += np.bincount(at, minlength=DIMENSIONS)
        in_bad += np.bincount(at[bad[i + of]], minlength=DIMENSIONS)
    nb, ng = max(1, bad.sum()), max(1, (~bad).sum())
    p = in_all / max(1, len(rows))
    z = (in_bad / nb - (in_all - in_bad) / ng) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / nb + 1 / ng))
    seen = (in_all >= 4) & (z >= TELLING)
    used = np.flatnonzero(seen)
    used = np.sort(used[np.argsort(-z[used], kind="stable")[:most]])
    column = np.full(DIMENSIONS, -1)
    column[used] = np.arange(len(used))
    n = len(used)
    x = np.zeros((len(rows), n), np.uint8)  # no text has a feature as often as this type ends
    for i in range(0, len(rows), BLOCK):
        of, at = block(i)
        at = column[at]
        count = np.zeros((min(BLOCK, len(rows) - i), n), np.int32)
        np.add.at(count, (of[at >= 0], at[at >= 0]), 1)
        x[i : i + BLOCK] = np.minimum(count, 255)
    above = grade[:, None] >= np.arange(1, levels + 1)
    weight = np.where(bad, min(HEAVIER, max(1.0, ng / nb)), 1.0)
    penalty = np.r_[ridge * TELLING / z[used], np.full(levels, 1e-6)]  # the surer the difference, the smaller
    w = np.r_[np.zeros(len(used)), np.linspace(1.0, 3.0, levels)]  # the thresholds stand behind the weights

    def step(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, curve = 0.5 * (penalty * w**2).sum(), penalty * w, np.diag(penalty)
        for i in range(0, len(x), BLOCK):  # so that no copy of all rows is made
            part, heavy, over = x[i : i + BLOCK].astype(float), weight[i : i + BLOCK], above[i : i + BLOCK]
            score = (part @ w[:n])[:, None] - w[n:]
            p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
            pull, bend = heavy[:, None] * (p - over), heavy[:, None] * p * (1 - p)
            loss += (heavy[:, None] * (np.logaddexp(0, score) - over * score)).sum()
            slope += np.r_[part.T @ pull.sum(1), -pull.sum(0)]
            cross = part.T @ bend
            curve[:n, :n] += part.T @ (part * bend.sum(1)[:, None])
            curve[:n, n:] -= cross
            curve[n:, :n] -= cross.T
            curve[n:, n:] += np.diag(bend.sum(0))
        return loss, slope, curve

    loss, slope, curve = step(w)
    own = np.arange(len(w)) < len(used)
    for _ in range(rounds):
        free = ~own | (w > 0) | (slope < 0)  # weights speak for toxicity or not at all
        move = np.zeros(len(w))
        move[free] = np.linalg.solve(curve[np.ix_(free, free)] + 1e-6 * np.eye(free.sum()), slope[free])
        scale = 1.0
        while scale > 1e-4:
            new = w - scale * move
            new[own] = np.maximum(new[own], 0)
            tried = step(new)
            if tried[0] < loss:
                break
            scale /= 2
        if tried[0] >= loss:
            break
        done = loss - tried[0] < 1e-6 * abs(loss)
        w, (loss, slope, curve) = new, tried
        if done:
            break
    w, theta = w[: len(used)], np.maximum.accumulate(w[len(used) :])
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return Ordinal(weights, theta)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct word numbers, features and labels of at most sample labelled rows (those with the smallest key hashes).

    Words are numbered by 64-bit hashes on the executors, so the driver holds arrays and no texts.
    """
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most sample rows of two numbers

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(distinct_words(t)) for t in batch.column(1).to_pylist()]
            words = [b"".join([blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in f]) for f in found]
            features = [np.array([x for w in f for x in word_features(w)], "<u4").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.binary()), pa.array(features, pa.binary())], names=["doc_id", "toxic", "words", "features"])

    rows = joined.select("doc_id", "text", "toxic").mapInArrow(numbers, "doc_id long, toxic int, words binary, features binary")
    got = sorted((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in rows.collect())
    return [np.frombuffer(w, "<u8") for _, _, w, _ in got], [np.frombuffer(f, "<u4") for *_, f in got], np.array([t for _, t, _, _ in got], np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    words, rows, toxic = labelled_sample(docs, labels, sample)
    return fit(rows, grades(words, toxic))


def grade_toxicity(df: DataFrame, model: Ordinal, text: str = "text", reject: float = REJECT) -> DataFrame:
    """df's rows and columns, and severity (expected grade), p_toxic, grade (the most likely) and rejected.

    Null and empty texts have no features and are never rejected by the thresholds of a fitted model. Texts are read whole;
    rows that repeat are graded each. Columns of df with these names are replaced. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    new = ["severity", "p_toxic", "grade", "rejected"]
    df = df.drop(*new)
    names, where = df.columns, df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as its weights that are not zero
    kinds = (T.DoubleType(), T.DoubleType(), T.IntegerType(), T.BooleanType())
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in zip(new, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in freed(batches):
            p = own.chances(np.array([own.margin(t) for t in batch.column(where).to_pylist()], float))
            level = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            more = [pa.array(np.round(p.sum(1), 6)), pa.array(np.round(p[:, 0], 6)), pa.array(level.argmax(1), pa.int32()), pa.array(p[:, 0] > reject)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *new])

    return df.mapInArrow(run, schema)
