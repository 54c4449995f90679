"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are parsed against reference blocks. A factor is the longest stretch
of words, greedily taken, that also stands earlier (in a document with a smaller
id, or earlier in the same one); factors of at least ``window`` words become
duplicate spans, and the words in them are removed.

* A map task takes its documents in blocks of bounded size and parses a block
  against itself: an index of hashed windows proposes factors, which count once
  their words, from border to border, are the same as the source's. What is
  settled there does not move: a passage that a third of all documents share
  leaves a block once, however often the block holds it.
* To parse a block against every other block, without comparing all blocks
  with each other, the reference is spread over the cluster by content. The key of
  a window is its anchor: the smallest hash among its short word runs. Equal
  windows have equal anchors, and neighbouring windows mostly share theirs, so a
  stretch of words moves as one row under its anchor. A stretch whose anchor
  occurs once in the corpus has no factor elsewhere and does not move (a
  broadcast bit set, of bounded size, tells; a false bit only moves a row).
* The task that holds an anchor's rows, in document order, keeps them as its
  reference: an index of their windows' words. A row is parsed greedily: the
  longest source found at a word is followed word by word to the factor's border,
  and parsing goes on behind it; windows that start no factor join the index.
* A frequent short phrase with ever new words around it gives its anchor new
  windows without end. So windows are counted by anchor first, and windows of
  the most frequent anchors move one by one, keyed by anchor and window: equal
  ones still meet, and the anchor is spread over all tasks.
* Factors go back to their documents by id and are cut out. Documents without a
  factor are not moved (a bit set again).

Hashes only route rows and propose sources: whether words are the same is
always decided by the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from meterkit.llm import words as W
from meterkit.llm.collocations import MOST_BITS, SPARSE, BitSet
from meterkit.llm.scratch import write_scratch

WINDOW = 20
#: Words of the runs that anchors are taken from.
ANCHOR = 6
#: Text bytes of a reference block.
BLOCK_BYTES = 2 << 20
#: Parts into which the anchors are dealt to be counted.
PARTS = 64
#: An anchor with fewer windows stays whole in one task.
LEAST = 4096
#: Anchors that are spread, at most; the others hold under a share of 1 in so
#: many of all windows each.
SPREAD = 1 << 18
#: An anchor with fewer windows in a block is counted in one block of so many,
#: at that weight.
RARE = 16


#: A stretch of ``length`` windows of one document, with its words joined by
#: spaces, or, without words, one that is settled as a factor.
ROWS = pa.schema([
    ("anchor", pa.int64()), ("id", pa.int64()), ("check", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("words", pa.binary())])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    have = 1
    out = x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs(flags: np.ndarray, broken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch of true ``flags``; a stretch also
    ends where ``broken`` says that an element starts something new."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | broken[1:]
    first = np.flatnonzero(begin)
    number = np.cumsum(begin)[flags]
    return first, np.bincount(number, minlength=len(first) + 1)[1:]


def anchor_counts(part: pa.RecordBatch, window: int, anchor: int) -> pa.RecordBatch | None:
    """(anchor, n): windows of one block by anchor. Counts only say which
    anchors are spread, so those of rare anchors are drawn."""
    data, offsets = W.text_bytes(part.column("text"))
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    n = len(starts) - window + 1
    if n <= 0:
        return None
    hashed = W.word_hashes(data, starts, ends)
    doc = W.owner(first)
    anchors = sliding_min(W.window_hashes(hashed, anchor), window - anchor + 1)[doc[:n] == doc[window - 1:]]
    if not len(anchors):
        return None
    begin = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    found, which = np.unique(anchors[begin], return_inverse=True)
    count = np.bincount(which, weights=np.diff(np.append(begin, len(anchors)))).astype(np.int64)
    rare = count < RARE
    drawn = W.mix64(found + W.mix64(hashed.sum(keepdims=True))) % np.uint64(RARE) == 0
    count[rare] *= RARE
    keep = ~rare | drawn
    return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(count[keep])], names=["anchor", "n"])


def frequent_anchors(docs: DataFrame, window: int, anchor: int) -> np.ndarray:
    """The anchors to spread, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", BLOCK_BYTES, 1 << 30):
                counted = anchor_counts(part, window, anchor)
                if counted is not None:
                    yield counted

    counts = docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    most = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "anchor").limit(SPREAD).select("anchor").toArrow()
    return np.sort(most.column("anchor").to_numpy().view(W.U64))


def block_anchors(part: pa.RecordBatch, window: int, anchor: int) -> np.ndarray:
    """The high halves of the anchors of a block, sorted: twice if the anchor
    has two stretches or more."""
    data, offsets = W.text_bytes(part.column("text"))
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    n = len(starts) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    doc = W.owner(first)
    at = np.flatnonzero(doc[:n] == doc[window - 1:])
    anchors = sliding_min(W.window_hashes(W.word_hashes(data, starts, ends), anchor), window - anchor + 1)[at]
    begin = np.ones(len(at), dtype=bool)
    begin[1:] = (anchors[1:] != anchors[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    found, times = np.unique((anchors[begin] >> W.U64(32)).astype(np.uint32), return_counts=True)
    return np.repeat(found, np.minimum(times, 2))


def repeated_anchors(docs: DataFrame, window: int, anchor: int) -> Broadcast:
    """The bit set of anchors (their high halves) with two stretches or more.
    Blocks send four bytes an anchor, dealt by value; every part is counted in
    one task, and at most MOST_BITS / 8 bytes reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", BLOCK_BYTES, 1 << 30):
                found = block_anchors(part, window, anchor)
                cuts = np.searchsorted(found, np.arange(PARTS + 1, dtype=np.uint64) * ((1 << 32) // PARTS))
                raw = [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(raw, pa.binary())], names=["part", "found"])

    size = MOST_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; of a part a bit per value seen is kept."""
        width = (1 << 32) // PARTS
        open_part, once = -1, np.zeros(0, dtype=np.uint8)
        twice: list[np.ndarray] = []

        def cells() -> pa.RecordBatch:
            at = np.unique(np.concatenate(twice)) if twice else np.zeros(0, np.int64)
            bits = np.unique(at & (size - 1))
            cell, begin = np.unique(bits >> 6, return_index=True)
            masks = W.U64(1) << (bits & 63).astype(W.U64)
            whole = np.bitwise_or.reduceat(masks, begin) if len(begin) else masks
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(whole.view(np.int64))], names=["cell", "bits"])

        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("found").to_pylist(), strict=True):
                if part != open_part:
                    if twice:
                        yield cells()
                    open_part, once, twice = part, np.zeros(width // 8, dtype=np.uint8), []
                values = np.frombuffer(raw, dtype=np.uint32)
                if not len(values):
                    continue
                own = (values - np.uint32(part * width)).astype(np.int64)
                again = np.zeros(len(own), dtype=bool)
                again[1:] = own[1:] == own[:-1]
                again |= (once[own >> 3] >> (own & 7).astype(np.uint8)) & 1 == 1
                twice.append(values[again].astype(np.int64))
                np.bitwise_or.at(once, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
                if len(twice) > 256:
                    twice = [np.unique(np.concatenate(twice))]
        if twice:
            yield cells()

    sent = docs.select("text").mapInArrow(run, "part int, found binary").repartition(PARTS, "part").sortWithinPartitions("part")
    return _bit_set(sent.mapInArrow(count, "cell long, bits long"), size)


def _bit_set(cells: DataFrame, size: int) -> Broadcast:
    """The broadcast BitSet of (cell, bits) rows, 64 bits each."""
    rows = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(size // 64, dtype=W.U64)
    whole[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().view(W.U64)
    return cells.sparkSession.sparkContext.broadcast(BitSet(whole.view(np.uint8)))


def stretches(part: pa.RecordBatch, window: int, anchor: int, spread: np.ndarray, moves: BitSet | None = None) -> list[pa.RecordBatch]:
    """Rows of one block (id, check, text): stretches of windows seen first in
    the block, cut where the anchor changes, with their words, if the anchor
    ``moves``; and factors settled in the block. Windows of the anchors in
    ``spread`` are rows of their own, whose key stands for anchor and window."""
    part = part.take(pa.array(np.lexsort((part.column("check").to_numpy(), part.column("id").to_numpy()))))
    data, offsets = W.text_bytes(part.column("text"))
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    n = len(starts) - window + 1
    if n <= 0:
        return []
    hashed = W.word_hashes(data, starts, ends)
    # all words, each with a space behind it
    sizes = ends - starts + 1
    to = np.concatenate(([0], np.cumsum(sizes)))
    joined = np.full(to[-1], 0x20, dtype=np.uint8)
    inside = np.ones(to[-1], dtype=bool)
    inside[to[1:] - 1] = False
    joined[inside] = data[W.NOT_SPACE[data]]
    said = joined.tobytes()
    doc = W.owner(first)
    at = np.flatnonzero(doc[:n] == doc[window - 1:])  # windows within one document
    numbers = W.window_hashes(hashed, window)[at]
    anchors = sliding_min(W.window_hashes(hashed, anchor), window - anchor + 1)[at]
    owner = doc[at]
    place = at - first[owner]
    ids, checks = part.column("id").to_numpy(), part.column("check").to_numpy()
    _, earliest, which = np.unique(numbers, return_index=True, return_inverse=True)
    earliest = earliest[which]
    # a repeated row is the same document: its windows are no earlier ones
    same = (ids[owner] == ids[owner[earliest]]) & (checks[owner] == checks[owner[earliest]]) & (place == place[earliest])
    settled = ~same
    new_doc = np.ones(len(at), dtype=bool)
    new_doc[1:] = (owner[1:] != owner[:-1])
    # a proposed factor goes on while its source does; then its words are compared
    new_source = new_doc.copy()
    new_source[1:] |= at[earliest[1:]] != at[earliest[:-1]] + 1
    begin, length = runs(settled, new_source)
    for b, k in zip(begin.tolist(), length.tolist(), strict=True):
        a, source = int(at[b]), int(at[earliest[b]])
        if said[to[a]:to[a + k + window - 1]] != said[to[source]:to[source + k + window - 1]]:
            settled[b:b + k] = False  # equal hashes of different words: the words decide elsewhere
    new_anchor = new_doc.copy()
    new_anchor[1:] |= anchors[1:] != anchors[:-1]
    goes = ~settled if moves is None else ~settled & moves.has(anchors >> W.U64(32))
    if len(spread):
        alone = spread[np.minimum(np.searchsorted(spread, anchors), len(spread) - 1)] == anchors
        new_anchor |= alone
        anchors = np.where(alone, W.mix64(numbers + W.mix64(anchors)), anchors)
    out = []
    for flags, broken in ((goes, new_anchor), (settled, new_doc)):
        begin, length = runs(flags, broken)
        if flags is settled:
            # spread by place; they only pass through
            key, words = W.mix64(ids[owner[begin]].view(W.U64) + place[begin].astype(W.U64)), pa.nulls(len(begin), pa.binary())
        else:
            key = anchors[begin]
            words = pa.array([said[x:y - 1] for x, y in zip(to[at[begin]].tolist(), to[at[begin] + length + window - 1].tolist(), strict=True)], pa.binary())
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(ids[owner[begin]]), pa.array(checks[owner[begin]]),
             pa.array(place[begin].astype(np.int32)), pa.array(length.astype(np.int32)), words], schema=ROWS))
    return pa.Table.from_batches(out).combine_chunks().to_batches()


def parse_blocks(docs: DataFrame, window: int, anchor: int, spread: np.ndarray, moves: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", BLOCK_BYTES, 1 << 30):
                yield from stretches(part, window, anchor, spread, moves.value)

    return docs.mapInArrow(run, "anchor long, id long, check long, start int, length int, words binary")


class Reference:
    """The stretches of one anchor so far, indexed by the words of windows that
    started no factor."""

    def __init__(self, window: int):
        self.window = window
        self.index: dict[bytes, tuple[list[bytes], int, tuple[int, int, int]]] = {}

    def parse(self, place: tuple[int, int, int], said: bytes) -> list[tuple[int, int]]:
        """Greedy factors of a stretch that stands at ``place`` (id, check,
        word): number of the first window, and windows. The rest is indexed."""
        k, words = self.window, said.split(b" ")
        ident, check, begin = place
        to = [0, *accumulate(len(w) + 1 for w in words)]
        found, i, n = [], 0, len(words) - k + 1
        while i < n:
            key = said[to[i]:to[i + k] - 1]
            source = self.index.get(key)
            if source is None:
                self.index[key] = (words, i, (ident, check, begin + i))
                i += 1
            elif source[2] == (ident, check, begin + i):
                i += 1  # the same document, in a row that repeats it
            else:
                # from the window on, word by word to the factor's border
                of, at, _ = source
                size, most = k, min(len(words) - i, len(of) - at)
                while size < most and words[i + size] == of[at + size]:
                    size += 1
                found.append((i, size - k + 1))
                i += size - k + 1
        return found


def settle(rows: DataFrame, window: int) -> DataFrame:
    """(id, check, start, length): factors, as stretches of windows. ``rows``
    are dealt by anchor and sorted by anchor and place; an anchor's reference
    lasts until the next anchor."""
    schema = pa.schema([("id", pa.int64()), ("check", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_anchor, reference = None, Reference(window)
        for batch in batches:
            done = batch.filter(batch.column("words").is_null())
            if done.num_rows:
                yield done.select(["id", "check", "start", "length"])
            batch = batch.filter(batch.column("words").is_valid())
            found = []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "id", "check", "start", "words"))
            for anchor, ident, check, start, said in zip(*columns, strict=True):
                if anchor != open_anchor:
                    open_anchor, reference = anchor, Reference(window)
                found += [(ident, check, start + i, n) for i, n in reference.parse((ident, check, start), said)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "id long, check long, start int, length int")


def touched(found: DataFrame) -> Broadcast:
    """The bit set of documents (id, check) that have a row in ``found``."""
    size = 1 << 16
    while size < min(SPARSE * found.count(), MOST_BITS):
        size *= 2
    at = F.xxhash64("id", "check").bitwiseAND(size - 1)
    return _bit_set(found.select(F.shiftright(at, 6).alias("cell"), F.expr("shiftleft(1L, cast(xxhash64(id, check) & 63 as int))").alias("bits")), size)


def cut_out(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """Joined documents (``text_col``, ``spans``) with ``n_words``,
    ``n_removed`` and ``kept_text``, without ``text_col`` and ``spans``."""
    added = StructType().add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", StringType())
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                data, offsets = W.text_bytes(part.column(text_col))
                starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
                gone = np.zeros(len(starts) + 1, dtype=np.int64)
                spans = part.column("spans")
                owner = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = spans.flatten()
                if len(flat):
                    at = first[owner] + flat.field("start").to_numpy()
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + flat.field("length").to_numpy() + window - 1, -1)
                stays = np.cumsum(gone[:-1]) == 0
                # bytes of words that stay, and the byte after each as its space
                edge = np.zeros(len(data) + 1, dtype=np.int8)
                edge[starts[stays]] += 1
                edge[ends[stays]] -= 1
                keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
                after = ends[stays]
                doc = W.owner(first)[stays]
                after = after[after < offsets[doc + 1]]
                keep[after] = True
                out = data.copy()
                out[after] = 0x20
                total = np.concatenate(([0], np.cumsum(keep)))[offsets]
                out = out[keep].tobytes()
                texts = [out[a:b].removesuffix(b" ").decode() for a, b in zip(total[:-1], total[1:], strict=True)]
                n = np.diff(first)
                kept = np.bincount(doc, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in rest), pa.array(n, pa.int64()), pa.array(n - kept, pa.int64()), pa.array(texts, pa.string())],
                    names=[*(f.name for f in rest), *added.names])

    return docs.mapInArrow(run, StructType([*rest, *added.fields]))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text), one row per input row: words that
    lie in a repeated window of ``window`` words are removed, the rest joined
    by single spaces.

    Words are runs without white space, unchanged. Windows are judged on the
    input. ``id_col`` is an integer; a null id sorts before all others. Rows
    that share an id but not their text are documents in the order of the
    texts' checksums; a row repeated whole is the same document, and both
    copies lose the same words. A null text has no words. An empty table gives
    an empty result; other columns are not looked at.
    """
    if window < ANCHOR + 1:
        raise ValueError(f"window must be over {ANCHOR} words")
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
                     F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("check"), F.col(text_col).alias("text"))
    spread = frequent_anchors(docs, window, ANCHOR)
    moves = repeated_anchors(docs, window, ANCHOR)
    rows = parse_blocks(docs, window, ANCHOR, spread, moves).repartition("anchor").sortWithinPartitions("anchor", "id", "check", "start")
    found = write_scratch(settle(rows, window).groupBy("id", "check").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "factors")
    some = touched(found)

    @F.pandas_udf("boolean")
    def has_factor(hashes: pd.Series) -> pd.Series:
        return pd.Series(some.value.has(hashes.to_numpy().view(W.U64)))

    marked = docs.withColumn("some", has_factor(F.xxhash64("id", "check")))
    joined = marked.where("some").drop("some").join(found.hint("shuffle_hash"), ["id", "check"], "left")
    whole = marked.where("not some").drop("some").withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
    out = cut_out(joined.unionByName(whole).drop("check"), "text", window)
    return out.withColumn("id", F.when(F.col("id") != -(1 << 63), F.col("id")))
