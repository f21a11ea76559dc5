"""Secrets in text: fixed patterns, and formats learned from labelled credentials by grammar inference.

Learning (ALERGIA): the labelled credentials form a prefix tree whose states count how often they are passed, left by
each symbol and ended in. States are merged where their frequencies (and those of all that follow) differ by no more than
Hoeffding's bound allows: first those of equal depth, from the root on, so that each state has counts enough to be told
from others; then those of different depths, which makes loops of runs whose length varies and leaves fixed lengths
apart, as their ends differ. The result is a probabilistic automaton. The first characters of a credential are symbols of their own as long as
many credentials share them, as formats have fixed beginnings; later ones stand for their class.

Scoring: in every run of credential characters the automaton reads from each start, that is the run's own and each
place behind a character that is no letter or digit (a name, path or host may stand before a credential). Of the words
that end before such a character or with the run, the longest is reported whose probability under the automaton, for
each character, exceeds that under a background model by a margin. All starts advance together, so the work is in
proportion to the run.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkveil.session import ship

#: Fixed patterns, in the order in which kinds of the same start are listed (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "learned")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A run: characters that credentials consist of, so many of them at least; and where a word may start in it.
SHORTEST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
START = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9+/_.=-]")
#: The most characters that are symbols of their own, and the share of credentials with the same beginning that must go on with one.
LITERAL, SHARED = 8, 0.1
ALPHA, MARGIN = 0.02, 0.35
CLASSES = ((string.ascii_uppercase, "upper"), ("abcdef", "hex"), (string.ascii_lowercase, "lower"), (string.digits, "digit"), ("-_", "mark"))
_CLASS = {c: k for letters, k in reversed(CLASSES) for c in letters}
#: How likely ordinary text has each class at a place of a long run; any other character has the rest.
BACKGROUND = {"upper": 0.06, "hex": 0.25, "lower": 0.55, "digit": 0.06}
_PLAIN, _OTHER = {c: math.log(BACKGROUND[k]) for c, k in _CLASS.items() if k in BACKGROUND}, math.log(0.08)


def labelled_credentials(each: int = 160, seed: int = 11) -> list[str]:
    """Credentials of well-known public formats, made by rule: so many of each format, the same for the same seed."""
    r = random.Random(seed)
    upper, alnum, hexes = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda letters, n: "".join(r.choices(letters, k=n))
    formats = (
        lambda: "AKIA" + some(upper, 16),
        lambda: "ghp_" + some(alnum, 36),
        lambda: "sk_live_" + some(alnum, 24),
        lambda: f"xoxb-{some(string.digits, 12)}-{some(string.digits, 12)}-{some(alnum, 24)}",
        lambda: "AIza" + some(alnum + "-_", 35),
        lambda: "glpat-" + some(alnum + "-_", 20),
        lambda: some(hexes, 32),
        lambda: some(hexes, 40),
        lambda: some(hexes, 64),
        lambda: "sk-" + some(alnum, r.randint(32, 56)),
        lambda: "pypi-" + some(alnum + "-_", r.randint(90, 130)),
    )
    return [f() for f in formats for _ in range(each)]


def shared_beginnings(words: list[str]) -> set[str]:
    """Beginnings that many words share: each goes on from a shared one, with a character that enough of its words have."""
    words = [w for w in words if not _all_hex(w)]
    out, level = {""}, {"": words}
    for size in range(1, LITERAL + 1):
        further: dict[str, list[str]] = {}
        for before in level.values():
            longer: dict[str, list[str]] = {}
            for w in before:
                if len(w) >= size:
                    longer.setdefault(w[:size], []).append(w)
            further |= {p: ws for p, ws in longer.items() if len(ws) >= max(2, SHARED * len(before))}
        out |= further.keys()
        level = further
    return out


def _all_hex(word: str) -> bool:
    return all(c in "0123456789abcdef" for c in word)


def symbols(word: str, beginnings: set[str]) -> list[str]:
    """Symbols of a word: the characters of its shared beginning, and the classes of the others. Words of hex digits only have classes."""
    literal = 0
    while not _all_hex(word) and literal < len(word) and word[: literal + 1] in beginnings:
        literal += 1
    return [c if i < literal else _CLASS.get(c, c) for i, c in enumerate(word)]


class Automaton:
    """A probabilistic automaton inferred from words."""

    def __init__(self, words: list[str], alpha: float = ALPHA) -> None:
        self.beginnings = shared_beginnings(words)
        self.count, self.ends, self.next = [0], [0], [{}]
        for w in words:
            state = 0
            self.count[0] += 1
            for s in symbols(w, self.beginnings):
                if s not in self.next[state]:
                    self.next[state][s] = [len(self.count), 0]
                    self.count.append(0)
                    self.ends.append(0)
                    self.next.append({})
                self.next[state][s][1] += 1
                state = self.next[state][s][0]
                self.count[state] += 1
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.states = sorted(self._reached())
        place = {q: k for k, q in enumerate(self.states)}
        self.step = [{s: (place[to], math.log(n / self.count[q])) for s, (to, n) in self.next[q].items()} for q in self.states]
        self.end = [math.log(self.ends[q] / self.count[q]) if self.ends[q] else None for q in self.states]
        del self.next, self.became

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether two states agree in their ends, their symbols and all that follows."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if self._differ(self.count[a], self.ends[a], self.count[b], self.ends[b]):
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(s), self.next[b].get(s)
                if self._differ(self.count[a], x[1] if x else 0, self.count[b], y[1] if y else 0):
                    return False
                if x and y:
                    todo.append((self._now(x[0]), self._now(y[0])))
        return True

    def _now(self, state: int) -> int:
        """The state that a state has become."""
        while self.became[state] != state:
            self.became[state] = self.became[self.became[state]]
            state = self.became[state]
        return state

    def _join(self, a: int, b: int) -> None:
        """Make one of two states, and of those they lead to by the same symbol."""
        todo = [(a, b)]
        while todo:
            a, b = (self._now(x) for x in todo.pop())
            if a == b:
                continue
            self.became[b] = a
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            for s, (to, n) in self.next[b].items():
                if s in self.next[a]:
                    self.next[a][s][1] += n
                    todo.append((self.next[a][s][0], to))
                else:
                    self.next[a][s] = [to, n]

    def _reached(self) -> dict[int, int]:
        """The states in order of their least depth, with it."""
        depth, todo = {0: 0}, [0]
        for q in todo:
            for s in sorted(self.next[q]):
                to = self._now(self.next[q][s][0])
                if to not in depth:
                    depth[to] = depth[q] + 1
                    todo.append(to)
        return depth

    def _merge_all(self) -> None:
        self.became = list(range(len(self.count)))
        for any_depth in (False, True):
            kept: list[int] = []
            todo, level = [0], {0: 0}
            while todo:
                state = self._now(todo.pop(0))
                if state in kept:
                    continue
                depth = level.get(state, 0)
                mate = next((q for q in kept if (any_depth or level[q] == depth) and self._compatible(q, state)), None)
                if mate is None:
                    kept.append(state)
                    level[state] = depth
                else:
                    self._join(mate, state)
                    kept = list(dict.fromkeys(map(self._now, kept)))
                    state = self._now(mate)
                for s in sorted(self.next[state]):
                    to = self._now(self.next[state][s][0])
                    level.setdefault(to, level[state] + 1)
                    if to not in kept:
                        todo.append(to)
        for q in self._reached():
            for edge in self.next[q].values():
                edge[0] = self._now(edge[0])

    def score(self, word: str) -> float:
        """Log-likelihood ratio against the background, for each character; minus infinity if the automaton has no such word."""
        state, total = 0, 0.0
        for s in symbols(word, self.beginnings):
            got = self.step[state].get(s)
            if got is None:
                return -math.inf
            state, p = got
            total += p
        if self.end[state] is None:
            return -math.inf
        plain = sum(_PLAIN.get(c, _OTHER) for c in word)
        return (total + self.end[state] - plain) / len(word)

    def words(self, text: str, a: int, b: int, margin: float) -> list[tuple[int, int]]:
        """(start, end) of the words in a run that score above the margin, without overlaps: the first start, its longest end.

        The run is read once. All starts advance together; where two come to the same state, the one that scores better
        goes on (what follows adds the same to both). Words end with the run or before a character that is no letter or digit.
        """
        starts = {m.start() for m in START.finditer(text, a, b)}
        # (state, still in its shared beginning, hex digits only so far, read as hex) -> (score above the margin, start)
        active: dict[tuple, tuple[float, int]] = {}
        found: dict[int, int] = {}
        for i in range(a, b):
            c = text[i]
            hexes, kind, cost = c in "0123456789abcdef", _CLASS.get(c, c), _PLAIN.get(c, _OTHER) + margin
            if i in starts:
                active[0, True, True, False] = active[0, False, True, True] = (0.0, i)
            further: dict[tuple, tuple[float, int]] = {}
            for (state, literal, only, as_hex), (score, start) in active.items():
                if as_hex and not hexes:
                    continue
                literal = literal and text[start : i + 1] in self.beginnings
                got = self.step[state].get(c if literal else kind)
                if got is None:
                    continue
                key, score = (got[0], literal, only and hexes, as_hex), score + got[1] - cost
                if key not in further or score > further[key][0]:
                    further[key] = (score, start)
            active = further
            if active and (i + 1 == b or not text[i + 1].isalnum()):
                for (state, _, only, as_hex), (score, start) in active.items():
                    if i + 1 - start >= SHORTEST and only == as_hex and self.end[state] is not None and score + self.end[state] > 0:
                        found[start] = i + 1
        out: list[tuple[int, int]] = []
        for start in sorted(found):
            if not out or start >= out[-1][1]:
                out.append((start, found[start]))
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, as indexes into KINDS and code points."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out


def all_spans(text: str, model: Automaton | None, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """All spans by start, then kind. What was learned is reported where no fixed pattern has a span."""
    out = base_spans(text)
    runs = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]  # long hex runs lie within them
    for a, b in runs:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST["hex"]]
    if model is not None:
        fixed = [(s, e) for s, _, e in out]
        for a, b in runs:
            out += [(s, 3, e) for s, e in model.words(text, a, b, margin) if not any(x < e and s < y for x, y in fixed)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id", credentials: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per row of df: key, n_assign, n_access, n_hex, n_learned, base_sha256, spans (array), spans_text.

    Spans are (kind, start, end) in code points, the end exclusive; those of the fixed patterns are all kept, learned
    ones are added. credentials (labelled, by default of well-known formats) are what is learned from, on the driver.
    Null and empty texts have no spans; texts are read whole, rows that repeat each give a row. Other columns of df are left
    out, so none can clash. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    model = Automaton(labelled_credentials() if credentials is None else credentials)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", model, margin) for t in batch.column(1).to_pylist()]
            counts = [[sum(k == n for _, k, _ in f) for f in found] for n in range(4)]
            base = [hashlib.sha256(joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found]
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base), pa.array(spans, kind), pa.array([joined(f) for f in found])]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_assign", "n_access", "n_hex", "n_learned", "base_sha256", "spans", "spans_text"])

    rows = df.selectExpr(f"cast(`{key}` as long) as key", f"cast(`{text}` as string) as text")
    schema = "key long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans array<struct<kind:string,start:int,end:int>>, spans_text string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
