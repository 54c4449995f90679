"""Phrase collocation mining by best-first branch-and-bound growth.

Phrases grow word by word from the left. A phrase's score is that of its worst
cut, so the cut after its first word alone bounds it: with a prefix of count
``f`` whose first word occurs ``c`` times, no phrase that begins with the prefix
scores more than SCALE * f / (c + f). The bound only falls along a branch.

Growth is best-first in rounds. A round takes a language's frontier down to
some bound, counts what its prefixes grow into, and what may lie around the
phrases that score so much (a longer phrase that occurs nearly as often drops
them). A language is settled once as many phrases as wanted survive at or over
the bound: nothing left on the frontier can reach, or tie with, the last of them.
Otherwise the next round reaches four times as far.

Counts are exact: tasks number the words of a slice and count tuples of such
numbers, and phrases meet as texts in one aggregation. Which n-grams a scan
counts is told by broadcast bit sets of hashes, of bounded size whatever the
corpus; a false bit only counts an n-gram that nobody asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from meterkit.llm import words as W
from meterkit.llm.scratch import write_scratch

#: Rows of the report per language, and how often a candidate occurs at least.
TOP = 2000
LEAST = 30
LONGEST = 4
#: A phrase drops when a longer one occurs at least so many per cent as often.
COVERED = 80
SCALE = 2_000_000
#: The first round's reach: two-word phrases per language, as a multiple of TOP.
REACH = 3
#: Bits per entry of a bit set, and the bits of the largest (16 MB).
SPARSE, MOST_BITS = 16, 1 << 27
#: Text bytes and texts of one slice (a language and a word are one number under 2^31).
SLICE, ROWS = 1 << 19, 1 << 10
#: Counted phrases that a task holds before it hands them on.
HELD = 150_000

#: Bytes that end a piece, and bytes of words.
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False

COUNTED = StructType().add("lang", StringType()).add("phrase", StringType()).add("f", LongType())
KEY = ["lang", "phrase"]


def _lang_hash(langs: list[str]) -> np.ndarray:
    return W.mix64(np.array([zlib.crc32(x.encode()) for x in langs], dtype=W.U64) + W.U64(1))


@dataclass
class BitSet:
    """A set of (language, n-gram) hashes; may hold more than was put in."""

    bits: np.ndarray  # bytes, a power of two of them

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & W.U64(8 * len(self.bits) - 1)
        return (self.bits[(at >> W.U64(3)).astype(np.int64)] >> (at & W.U64(7)).astype(np.uint8)) & np.uint8(1) == 1


def bit_set(phrases: DataFrame, n: int) -> Broadcast:
    """The broadcast BitSet of (lang, phrase) rows, all of ``n`` words. Tasks
    set bits, Spark unites them; 16 MB at most reach the driver."""
    rows = phrases.count()
    size = 1 << 16
    while size < min(SPARSE * rows, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size // 64, dtype=W.U64)
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("phrase"))
            starts, ends, first = W.spans(data, offsets, _WORD)
            hashes = W.window_hashes(W.word_hashes(data, starts, ends), n)[first[:-1]]
            code = batch.column("lang").dictionary_encode()
            hashes = W.mix64(hashes ^ _lang_hash(code.dictionary.to_pylist())[code.indices.to_numpy()])
            at = hashes & W.U64(size - 1)
            np.bitwise_or.at(cells, (at >> W.U64(6)).astype(np.int64), W.U64(1) << (at & W.U64(63)))
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used].view(np.int64))], names=["cell", "bits"])

    cells = phrases.select(*KEY).mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(size // 64, dtype=W.U64)
    whole[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(W.U64)
    return phrases.sparkSession.sparkContext.broadcast(BitSet(whole.view(np.uint8)))


@dataclass
class Wanted:
    """Which n-grams a scan counts: those whose every (n-1)-gram of ``parts``'
    length is in ``parts``, and which, if any of these is given, have their
    first n-1 words in ``prefix``, their last in ``suffix``, or are in ``whole``."""

    parts: tuple[int, Broadcast] | None = None
    prefix: Broadcast | None = None
    suffix: Broadcast | None = None
    whole: Broadcast | None = None


class Reader:
    """Words of a slice of documents: numbers, hashes and pieces."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = W.text_bytes(part.column("text"))
        data = W.LOWER[data]
        starts, ends, first = W.spans(data, offsets, _WORD)
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        doc = W.owner(first)
        fresh = np.ones(len(starts), dtype=np.int32)
        fresh[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
        self.piece = np.cumsum(fresh, dtype=np.int32)
        self.hashed = W.word_hashes(data, starts, ends)
        # the bytes of words, end to end, are the words' texts
        bounds = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
        texts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[_WORD[data]].tobytes()))
        code = texts.dictionary_encode()
        self.number, self.word = code.indices.to_numpy().astype(np.int64), code.dictionary
        code = part.column("lang").dictionary_encode()
        self.langs = code.dictionary
        own = code.indices.to_numpy().astype(np.int64)
        self.salt = _lang_hash(self.langs.to_pylist())[own][doc] if len(doc) else np.zeros(0, W.U64)
        # language and word in one number: few languages or few words, so under 2^31
        self.first = own[doc] * len(self.word) + self.number

    def whole(self, n: int) -> np.ndarray:
        """Whether n words from each place on lie in one piece."""
        return self.piece[n - 1:] == self.piece[:len(self.piece) - n + 1]

    def inside(self, n: int, known: Broadcast) -> np.ndarray:
        count = max(len(self.number) - n + 1, 0)
        return known.value.has(W.mix64(W.window_hashes(self.hashed, n) ^ self.salt[:count]))

    def places(self, n: int, wanted: Wanted) -> np.ndarray:
        """Where the n-grams to count begin."""
        count = len(self.number) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64)
        ok = self.whole(n)
        if wanted.parts:
            size, known = wanted.parts
            part = self.inside(size, known)
            for k in range(n - size + 1):
                ok = ok & part[k:k + count]
        some = [self.inside(n - 1, wanted.prefix)[:count]] if wanted.prefix else []
        some += [self.inside(n - 1, wanted.suffix)[1:count + 1]] if wanted.suffix else []
        some += [self.inside(n, wanted.whole)] if wanted.whole else []
        return np.flatnonzero(ok & np.any(some, axis=0) if some else ok)

    def counts(self, n: int, at: np.ndarray) -> pa.Table:
        """COUNTED rows of the n-grams at ``at``; tuples of numbers are equal
        exactly when the words are."""
        low = np.int64((1 << 32) - 1)
        if n == 1:
            key, f = np.unique(self.first[at], return_counts=True)
            heads, tail = key, []
        else:
            pair = (self.first[:-1] << 32) | self.number[1:]
            if n == 2:
                key, f = np.unique(pair[at], return_counts=True)
                heads, tail = key >> 32, [key & low]
            elif n == 3:
                pairs, own = np.unique(pair[at], return_inverse=True)
                key, f = np.unique((own << 32) | self.number[at + 2], return_counts=True)
                heads, tail = pairs[key >> 32] >> 32, [pairs[key >> 32] & low, key & low]
            else:
                pairs, own = np.unique(np.concatenate((pair[at], pair[at + 2])), return_inverse=True)
                key, f = np.unique((own[:len(at)] << 32) | own[len(at):], return_counts=True)
                left, right = pairs[key >> 32], pairs[key & low]
                heads, tail = left >> 32, [left & low, (right >> 32) % max(len(self.word), 1), right & low]
        size = max(len(self.word), 1)
        columns = [self.word.take(pa.array(x)) for x in (heads % size, *tail)]
        phrase = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))
        return pa.table({"lang": self.langs.take(pa.array(heads // size)), "phrase": phrase.cast(pa.string()), "f": pa.array(f)})

    def totals(self) -> pa.Table:
        """A row without phrase per language: all its words."""
        f = np.bincount(self.first // max(len(self.word), 1), minlength=len(self.langs))
        return pa.table({"lang": self.langs, "phrase": pa.nulls(len(self.langs), pa.string()), "f": pa.array(f.astype(np.int64))})


def count_phrases(docs: DataFrame, n: int, wanted: Wanted = Wanted()) -> DataFrame:
    """COUNTED rows of the wanted n-grams of (lang, text) ``docs``; for ``n`` = 1
    also, with a null phrase, each language's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for part in W.slices(batch, "text", SLICE, ROWS):
                read = Reader(part)
                held.append(read.counts(n, read.places(n, wanted)))
                rows += len(held[-1])
                if n == 1:
                    held.append(read.totals())
                if rows > HELD:
                    yield from merged(held)
                    rows = 0
        yield from merged(held)

    def merged(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            sums = pa.concat_tables(held).group_by(KEY).aggregate([("f", "sum")])
            held.clear()
            yield from sums.rename_columns({"f_sum": "f"}).select(COUNTED.names).to_batches(max_chunksize=1 << 14)
            del sums
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, COUNTED).groupBy(*KEY).agg(F.sum("f").alias("f"))


def _words(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` (from 1) of ``phrase``, joined."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def _div(a: Column, both: Column) -> Column:
    """floor(SCALE * a / both), in decimals: the product may pass 64 bits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(20,0)"), both.cast("decimal(20,0)"))


def _with_count(rows: DataFrame, counts: DataFrame, phrase: Column, name: str, how: str = "inner") -> DataFrame:
    """``rows`` with the count of ``phrase`` as ``name``."""
    found = counts.select("lang", F.col("phrase").alias("__part"), F.col("f").alias(name))
    return rows.withColumn("__part", phrase).join(found, ["lang", "__part"], how).drop("__part")


def cut_scores(rows: DataFrame, n: int, counts: dict[int, DataFrame], cuts: range) -> DataFrame:
    """Counted ``rows`` of ``n`` words with ``bound`` (no longer phrase that
    begins with them scores more) and ``cut``: score, number of words, count of
    the first part and of the rest, for the worst of ``cuts``."""
    options = []
    for k in cuts:
        rows = _with_count(rows, counts[k], _words(1, k), f"l{k}")
        rows = _with_count(rows, counts[n - k], _words(k + 1, n), f"r{k}")
        l, r = F.col(f"l{k}"), F.col(f"r{k}")
        options.append(F.struct(_div(F.col("f"), l + r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    rows = rows.withColumn("cut", F.array_min(F.array(*options)))
    if "l1" in rows.columns:
        rows = rows.withColumn("bound", _div(F.col("f"), F.col("l1") + F.col("f")))
    return rows.drop(*(f"{x}{k}" for x in "lr" for k in cuts))


def reach_down(pairs: DataFrame, phrases: int) -> DataFrame:
    """(lang, down_to): the score of each language's ``phrases``-th two-word
    phrase, 0 where there are fewer. Scores are whole numbers up to SCALE / 2,
    so a language's tally is short."""
    tally = pairs.groupBy("lang", F.col("cut.score").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"))
    return (tally.withColumn("all", F.sum("n").over(w)).groupBy("lang")
            .agg(F.coalesce(F.max(F.when(F.col("all") >= phrases, F.col("score"))), F.lit(0)).alias("down_to")))


def drop_covered(rows: DataFrame, n: int, longer: DataFrame) -> DataFrame:
    """``rows`` of ``n`` words without those inside a phrase of one word more
    that occurs COVERED per cent as often. (A phrase within a still longer one
    is within one of these too, which occurs at least as often.)"""
    around = longer.select("lang", "f", F.explode(F.array(_words(1, n), _words(2, n + 1))).alias("phrase"))
    most = around.groupBy(*KEY).agg(F.max("f").alias("most"))
    joined = rows.join(most, KEY, "left").where(F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < COVERED * F.col("f").cast("decimal(20,0)")))
    return joined.drop("most")


def grow(docs: DataFrame, singles: DataFrame, pairs: DataFrame, known: Broadcast, down_to: DataFrame, least: int) -> DataFrame:
    """All surviving phrases that score ``down_to`` or more, for the languages
    of ``down_to``: lang, phrase, f, cut, down_to."""
    def frontier(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        return rows.where("bound >= down_to"), rows.where("cut.score >= down_to")

    def counted(n: int, wanted: Wanted, name: str) -> DataFrame:
        return write_scratch(count_phrases(docs, n, wanted).where(F.col("f") >= least), name)

    open2, good2 = frontier(pairs.join(down_to, "lang"))
    triples = counted(3, Wanted((2, known), bit_set(open2, 2), bit_set(good2, 2)), "triples")
    counts = {1: singles, 2: pairs.select(*KEY, "f"), 3: triples}
    scored3 = write_scratch(cut_scores(triples, 3, counts, range(1, 3)).join(down_to, "lang"), "scored3")
    open3, good3 = frontier(scored3)
    quads = counted(4, Wanted((2, known), bit_set(open3, 3), bit_set(good3, 3)), "quads")
    # the first cut needs counts of last three words, which may not be on the frontier
    hopeful = write_scratch(cut_scores(quads, 4, counts, range(2, 4)).join(down_to, "lang").where("cut.score >= down_to").select(*KEY, "f", "down_to"), "hopeful")
    rest = hopeful.select("lang", _words(2, 4).alias("phrase")).distinct().join(triples, KEY, "left_anti")
    rest = write_scratch(rest, "rest")
    if not rest.isEmpty():
        counts[3] = triples.unionByName(counted(3, Wanted(whole=bit_set(rest, 3)), "more").join(triples, KEY, "left_anti"))
    good4 = cut_scores(hopeful, 4, counts, range(1, 4)).where("cut.score >= down_to")
    out = [drop_covered(good2, 2, triples), drop_covered(good3, 3, quads), good4]
    columns = [*KEY, "f", "cut", "down_to"]
    whole = out[0].select(*columns)
    for more in out[1:]:
        whole = whole.unionByName(more.select(*columns))
    return write_scratch(whole, "grown")


def mine(df: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang``, ``rank`` (from 1),
    ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of the two parts at
    its worst cut), ``n`` (all words of the language) and ``score``; by score
    and ``a``, falling, then by the phrase's bytes.

    Texts are lower-cased (A-Z) and cut into pieces at marks and line ends; a
    null text has no words, a null language is ``und``. Repeated rows count
    again, ties at the last place are settled by the order above. An empty table, or one
    where nothing occurs often enough, gives an empty result. Columns other
    than the two are not looked at. One text is one slice of numpy arrays, with
    some 60 bytes for each of its bytes: texts of up to 10 MB fit an executor of 3 GB.
    """
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    every = write_scratch(count_phrases(docs, 1).where((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    singles = every.where((F.col("f") >= least) & F.col("phrase").isNotNull())
    words = every.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    frequent = bit_set(singles, 1)
    pairs = count_phrases(docs, 2, Wanted((1, frequent))).where(F.col("f") >= least)
    pairs = write_scratch(cut_scores(pairs, 2, {1: singles}, range(1, 2)), "pairs")
    known, settled, phrases = bit_set(pairs, 2), [], reach * top
    left = pairs.select("lang").distinct()
    while True:
        down_to = write_scratch(reach_down(pairs.join(left, "lang", "left_semi"), phrases), "reach")
        found = grow(docs, singles, pairs, known, down_to, least)
        enough = write_scratch(
            down_to.join(found.groupBy("lang").count(), "lang", "left")
            .select("lang", (F.col("down_to").eqNullSafe(0) | (F.coalesce("count", F.lit(0)) >= top)).alias("done")), "settled")
        settled.append(found.join(enough.where("done"), "lang", "left_semi"))
        left = enough.where("not done").select("lang")
        if left.isEmpty():
            break
        phrases *= 4
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(words, "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"),
                    F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("bigint").alias("score")))
