"""Secret scans by grammar inference.

Three plain patterns find credentials that say what they are: an assignment to
a telling name, a key with a known prefix, a long hexadecimal run. These
labelled credentials teach the formats: per kind, a prefix tree of a bounded
sample of them is folded, state by state, wherever two states' next symbols and
endings are statistically compatible (Hoeffding bounds, all the way down). What
is left is a probabilistic automaton of the kind's format. Every other run of
credential characters in the corpus is a candidate; its score is the mean
number of bits per symbol by which the best automaton explains it better than
a Markov model of all runs, however short, in all texts. Candidates that score
like held-out labelled credentials become spans too.

Texts are read once; a written table keeps the spans found, the labelled
values and the candidates of each document, and a tally of neighbouring
symbols per slice of texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructType

from meterkit.llm import words as W
from meterkit.llm.scratch import free_name, write_scratch

# The patterns of the three kinds, in the order spans are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex")
#: Characters of a value, a key and a run at least.
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: What a text with a match of a pattern certainly holds (looked up by Arrow's own matcher).
ASSIGN_HINT = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS_HINT = "AKIA[A-Z0-9]{14}"

#: Characters of a candidate at least.
LEAST = 16
#: Distinct labelled credentials per kind that an automaton is fitted on, at
#: most (those with the smallest hashes), at least, and their longest.
FITTED, FEWEST, LONGEST = 2_000, 20, 200
#: Chance at which two states with one format are taken for different ones.
ALPHA = 0.05
#: A candidate has to reach this share of the median score of held-out labelled credentials.
SHARE = 0.5

_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_RUN = np.zeros(256, dtype=bool)
_RUN[[*b"+/_.-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
#: Symbols of candidates and values, and for smoothing their number with the end.
SYMBOLS = "+/_.=-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
END = ""
#: Number of each byte's symbol; 0 for whatever is outside a run.
_CODE = np.zeros(256, dtype=np.int64)
_CODE[[*SYMBOLS.encode()]] = np.arange(1, len(SYMBOLS) + 1)
_CODES = len(SYMBOLS) + 1
SPAN = StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType())
SCORED = StructType([*SPAN.fields]).add("score", DoubleType())


# -- the automaton -------------------------------------------------------------


class State:
    """A state's visits, endings and next states, with visits by symbol."""

    __slots__ = ("visits", "ends", "next", "by")

    def __init__(self):
        self.visits, self.ends = 0, 0
        self.next: dict[str, State] = {}
        self.by: Counter = Counter()


def prefix_tree(values: list[str]) -> State:
    root = State()
    for value in values:
        state = root
        for symbol in value:
            state.visits += 1
            state.by[symbol] += 1
            state = state.next.setdefault(symbol, State())
        state.visits += 1
        state.ends += 1
    return root


def compatible(red: State, blue: State, alpha: float) -> bool:
    """Whether no frequency of an ending or a next symbol differs between the
    two, nor below them, by more than chance."""
    scale = math.sqrt(0.5 * math.log(2 / alpha))
    stack = [(red, blue)]
    while stack:
        a, b = stack.pop()
        most = scale * (a.visits ** -0.5 + b.visits ** -0.5)
        if most >= 1:
            continue  # too few visits to tell, and fewer below
        if abs(a.ends / a.visits - b.ends / b.visits) > most:
            return False
        for symbol in a.by.keys() | b.by.keys():
            if abs(a.by[symbol] / a.visits - b.by[symbol] / b.visits) > most:
                return False
        stack += [(a.next[s], n) for s, n in b.next.items() if s in a.next]
    return True


def fold(red: State, blue: State) -> None:
    """Adds the tree at ``blue`` to ``red``."""
    stack = [(red, blue)]
    while stack:
        a, b = stack.pop()
        a.visits += b.visits
        a.ends += b.ends
        a.by.update(b.by)
        for symbol, state in b.next.items():
            if symbol in a.next:
                stack.append((a.next[symbol], state))
            else:
                a.next[symbol] = state


def infer(values: list[str], alpha: float = ALPHA) -> list[State]:
    """The automaton of ``values``: states, the first one at the start.

    States are settled one by one. Of the unsettled ones that a settled state
    leads to, the most visited comes next: it is folded into the first settled
    state compatible with it, or is settled as a new one."""
    settled = [prefix_tree(values)]
    while True:
        known = {id(s) for s in settled}
        open_ = [(n.visits, s, symbol, n) for s in settled for symbol, n in s.next.items() if id(n) not in known]
        if not open_:
            return settled
        _, parent, symbol, state = max(open_, key=lambda x: (x[0], x[2]))
        match = next((s for s in settled if compatible(s, state, alpha)), None)
        if match is None:
            settled.append(state)
        else:
            parent.next[symbol] = match
            fold(match, state)


@dataclass
class Format:
    """A kind's automaton as tables: per state, the bits of each known symbol
    with the next state, of any other symbol, and of the end."""

    moves: list[dict[str, tuple[float, int]]]
    other: list[float]
    end: list[float]
    threshold: float = 0.0

    @classmethod
    def of(cls, states: list[State], smooth: float = 0.02) -> Format:
        number = {id(s): i for i, s in enumerate(states)}
        moves, other, end = [], [], []
        for s in states:
            whole = math.log2(s.visits + smooth * (len(SYMBOLS) + 1))
            moves.append({c: (math.log2(s.by[c] + smooth) - whole, number[id(n)]) for c, n in s.next.items()})
            other.append(math.log2(smooth) - whole)
            end.append(math.log2(s.ends + smooth) - whole)
        return cls(moves, other, end)

    def bits(self, value: str) -> float:
        """log2 of the format's probability of ``value``; a symbol unknown to a state leaves it there."""
        at, total = 0, 0.0
        for symbol in value:
            move = self.moves[at].get(symbol)
            if move is None:
                total += self.other[at]
            else:
                total += move[0]
                at = move[1]
        return total + self.end[at]


@dataclass
class Background:
    """log2 of how likely a symbol (or the end) follows another (or the start), by number."""

    table: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Background:
        counts = counts.copy()
        counts[0, 0] = 0  # outside of runs
        return cls(np.log2((counts + 1) / (counts.sum(axis=1, keepdims=True) + _CODES)))

    def bits(self, value: str) -> float:
        codes = _CODE[np.frombuffer(b" %b " % value.encode(), dtype=np.uint8)]
        return float(self.table[codes[:-1], codes[1:]].sum())


@dataclass
class Scorer:
    formats: dict[str, Format]
    background: Background

    def score(self, value: str, kind: str) -> float:
        return (self.formats[kind].bits(value) - self.background.bits(value)) / (len(value) + 1)

    def judge(self, value: str) -> tuple[str, float] | None:
        """The kind whose format explains ``value`` best, and the score, if it
        reaches the kind's threshold."""
        passed = [(s, k) for k in self.formats if (s := self.score(value, k)) >= self.formats[k].threshold]
        return max(passed)[::-1] if passed else None


def fit(labelled: dict[str, list[str]], background: Background, alpha: float = ALPHA) -> Scorer:
    """The automata of ``labelled`` (values per kind, in a fixed order). Every
    fourth value is held out; the median of their scores, if over 0, sets the
    kind's threshold. Kinds with fewer than FEWEST values teach nothing."""
    scorer = Scorer({}, background)
    for kind, values in labelled.items():
        if len(values) < FEWEST:
            continue
        scorer.formats[kind] = Format.of(infer([v for i, v in enumerate(values) if i % 4], alpha))
        held = sorted(scorer.score(v, kind) for v in values[::4])
        scorer.formats[kind].threshold = max(SHARE * held[len(held) // 2], 0.0)
    return scorer


# -- the corpus ----------------------------------------------------------------


def plain_spans(text: str, assign: bool = True, access: bool = True) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of assignments and access keys in ``text``."""
    found = []
    if assign:
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if access:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LEAST]
    return found


def _runs(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end byte of the runs of ``least`` bytes or more."""
    starts, ends, first = W.spans(data, offsets, of)
    long_ones = np.flatnonzero(ends - starts >= least)
    return W.owner(first)[long_ones], starts[long_ones], ends[long_ones]


def read_slice(part: pa.RecordBatch, text_col: str, least: int) -> tuple[list, list, list, list]:
    """Per text of ``part``: spans, labelled values and candidates; and, in the
    first place, how often each symbol stands before each other one."""
    data, offsets = W.text_bytes(part.column(text_col))
    column = part.column(text_col)
    # characters before each byte, and before each text
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    base = before[offsets]
    spans: list[list] = [[] for _ in range(part.num_rows)]
    values: list[list] = [[] for _ in range(part.num_rows)]
    candidates: list[list] = [[] for _ in range(part.num_rows)]

    def add(d: int, kind: str, start: int, end: int, value: str) -> None:
        spans[d].append({"kind": kind, "start": start, "end": end})
        values[d].append({"kind": kind, "value": value})

    hints = [pc.fill_null(pc.match_substring_regex(column, h), False).to_numpy(zero_copy_only=False) for h in (ASSIGN_HINT, ACCESS_HINT)]
    for d in np.flatnonzero(hints[0] | hints[1]):
        for found in plain_spans(column[d].as_py(), hints[0][d], hints[1][d]):
            add(d, *found)
    for d, a, b in zip(*_runs(data, offsets, _HEX, HEX_LEAST), strict=True):
        add(d, "hex", int(before[a] - base[d]), int(before[b] - base[d]), data[a:b].tobytes().decode())
    for own in spans:
        own.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
    starts = [[s["start"] for s in own] for own in spans]
    reach = [list(accumulate((s["end"] for s in own), max)) for own in spans]
    for d, a, b in zip(*_runs(data, offsets, _RUN, least), strict=True):
        while b > a and data[b - 1] in b".-":  # marks after a word
            b -= 1
        while b < offsets[d + 1] and data[b] == 0x3D:  # padding
            b += 1
        start, end = int(before[a] - base[d]), int(before[b] - base[d])
        earlier = bisect_left(starts[d], end)  # spans that begin before the candidate ends
        if end - start >= least and not (earlier and reach[d][earlier - 1] > start):
            candidates[d].append({"start": start, "end": end, "value": data[a:b].tobytes().decode()})
    code = _CODE[data]
    ahead = np.concatenate(([0], code))
    ahead[offsets[:-1]] = 0  # a text's first symbol follows nothing of the text before
    pairs = np.bincount(ahead[:-1] * _CODES + code, minlength=_CODES ** 2)
    # runs that end with their text
    last = code[offsets[1:][np.diff(offsets) > 0] - 1]
    pairs[:_CODES ** 2:_CODES] += np.bincount(last, minlength=_CODES)
    return spans, values, candidates, [pairs.tobytes(), *[None] * (part.num_rows - 1)]


def read_texts(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """``docs`` without texts and with ``base``, ``labelled``, ``candidates`` and ``pairs``."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    labelled = StructType().add("kind", StringType()).add("value", StringType())
    candidate = StructType().add("start", LongType()).add("end", LongType()).add("value", StringType())
    out = StructType([*kept]).add("base", ArrayType(SPAN)).add("labelled", ArrayType(labelled)).add("candidates", ArrayType(candidate)).add("pairs", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, at, value = ("kind", pa.string()), [("start", pa.int64()), ("end", pa.int64())], ("value", pa.string())
        types = [*(pa.list_(pa.struct(t)) for t in ([kind, *at], [kind, value], [*at, value])), pa.binary()]
        for batch in batches:
            for part in W.slices(batch, text_col):
                found = read_slice(part, text_col, least)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), *(pa.array(x, t) for x, t in zip(found, types, strict=True))],
                    names=out.names)

    return docs.mapInArrow(run, out)


def labelled_sample(read: DataFrame, n: int) -> dict[str, list[str]]:
    """Up to ``n`` distinct labelled values per kind, by the smallest hashes."""
    values = (read.select(F.explode("labelled").alias("x")).select("x.kind", "x.value")
              .where(F.length("value") <= LONGEST).distinct())
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    rows = values.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n).orderBy("kind", "i").collect()
    return {k: [r.value for r in rows if r.kind == k] for k in KINDS}


def background(read: DataFrame) -> Background:
    """From all texts of the corpus; a row per pair of symbols comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_CODES ** 2, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts += np.frombuffer(raw, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CODES ** 2)), pa.array(counts)], names=["pair", "n"])

    counts = np.zeros(_CODES ** 2, dtype=np.int64)
    rows = read.select("pairs").where("pairs is not null").mapInArrow(run, "pair long, n long")
    for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    return Background.of(counts.reshape(_CODES, _CODES))


def judge_candidates(read: DataFrame, scorer: Scorer) -> DataFrame:
    """``read`` with ``found``, the spans of candidates that pass, in place of
    labelled values, candidates and tallies."""
    shared = read.sparkSession.sparkContext.broadcast(scorer)
    kept = [f for f in read.schema.fields if f.name not in ("labelled", "candidates", "pairs")]
    out = StructType([*kept]).add("found", ArrayType(SCORED))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for candidates in batch.column("candidates").to_pylist():
                judged = [(c, shared.value.judge(c["value"])) for c in candidates]
                found.append([{"kind": f"like_{j[0]}", "start": c["start"], "end": c["end"], "score": j[1]} for c, j in judged if j])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, span)], names=out.names)

    return read.mapInArrow(run, out)


def find_secrets(docs: DataFrame, text_col: str = "text", least: int = LEAST, fitted: int = FITTED, alpha: float = ALPHA) -> DataFrame:
    """``docs`` without ``text_col`` and with ``base`` (the spans of the plain
    patterns: kind, start and end in characters) and ``found`` (spans that the
    learnt formats add, with their score; kinds ``like_assign``, ``like_access``,
    ``like_hex``), each by start.

    A null or empty text has no spans. Rows are read one by one; repeated rows
    and ties change nothing (the automata are fitted on distinct values), and
    null columns pass through. A kind with fewer than FEWEST distinct labelled
    values, or an empty table, teaches nothing, so nothing is added. Where a
    result's name is taken, the new column has ``_1`` appended. One text is
    held whole with some 40 bytes for each of its own: up to 20 MB fit an
    executor of 3 GB.
    """
    # columns travel under plain numbers: no name of the caller's can clash
    own = {f"c{i}": c for i, c in enumerate(docs.columns)}
    text = next(k for k, c in own.items() if c == text_col)
    read = write_scratch(read_texts(docs.toDF(*own), text, least), "secrets")
    scorer = fit(labelled_sample(read, fitted), background(read), alpha)
    judged = judge_candidates(read, scorer)
    return judged.select(*(F.col(k).alias(c) for k, c in own.items() if k != text),
                         *(F.col(c).alias(free_name(docs.columns, c)) for c in ("base", "found")))
