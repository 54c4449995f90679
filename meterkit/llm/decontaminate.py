"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark items are normalised and cut into word windows. A set of them (at
most ``BLOCK_BYTES`` of item text, checked) is broadcast; tasks hash every
window of every document's words, look it up, and verify each hit word by word.
A larger benchmark is handled in several such blocks, one scan each, and the
covered words of the scans are united per document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from meterkit.llm import words as W
from meterkit.llm.scratch import free_name, write_scratch

WINDOW = 13
#: Item text of one broadcast set, in bytes (about 20 times that in memory).
BLOCK_BYTES = 8 << 20
FLAG_BITS = 20

Grams = dict[int, tuple[np.ndarray, np.ndarray, list[tuple[bytes, list[str]]]]]


def benchmark_grams(items: list[tuple[str, str | None]], window: int = WINDOW) -> Grams:
    """For each window length: a flag table over the hashes' high bits, the
    sorted hashes, and for each hash its windows as (words, item ids). An item
    with fewer words than ``window``, but not none, is one window."""
    found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        data = W.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
        starts, ends, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
        own = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        if own:
            k = min(window, len(own))
            for i in range(len(own) - k + 1):
                found[k][b" ".join(own[i:i + k])].add(item)
    grams: Grams = {}
    for k, texts in found.items():
        data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        starts, ends, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
        hashes = W.window_hashes(W.word_hashes(data, starts, ends), k)[::k]
        order = np.argsort(hashes, kind="stable")
        flags = np.zeros(1 << FLAG_BITS, dtype=bool)
        flags[(hashes >> W.U64(64 - FLAG_BITS)).astype(np.int64)] = True
        listed = [(t, sorted(ids)) for t, ids in texts.items()]
        grams[k] = (flags, hashes[order], [listed[i] for i in order])
    return grams


def hits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
         grams: Grams) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words lie in an occurrence of a window, and per text the items
    whose windows occur. ``data`` is lower case."""
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    doc = W.owner(first)
    hashed = W.word_hashes(data, starts, ends)
    for k, (flags, hashes, listed) in grams.items():
        own = W.window_hashes(hashed, k)
        maybe = np.flatnonzero(flags[(own >> W.U64(64 - FLAG_BITS)).astype(np.int64)])
        maybe = maybe[doc[maybe] == doc[maybe + k - 1]]
        lo = np.searchsorted(hashes, own[maybe], side="left")
        hi = np.searchsorted(hashes, own[maybe], side="right")
        for i, a, b in zip(maybe[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
            said = b" ".join(data[starts[j]:ends[j]].tobytes() for j in range(i, i + k))
            for text, ids in listed[a:b]:
                if text == said:
                    change[i] += 1
                    change[i + k] -= 1
                    items[int(doc[i])].update(ids)
    return np.cumsum(change[:-1]) > 0, items


SCAN = (StructType().add("n_words", LongType())
        .add("hit_spans", ArrayType(StructType().add("first", IntegerType()).add("last", IntegerType())))
        .add("items", ArrayType(StringType()))).fields


def scan(docs: DataFrame, text_col: str, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """``docs`` with the columns of SCAN: word count, runs of hit words (first
    and last index) and the items found, sorted as strings."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_grams(items, window))
    added = [f.name for f in SCAN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                data, offsets = W.text_bytes(part.column(text_col))
                data = W.LOWER[data]
                starts, ends, first = W.spans(data, offsets, W.ALNUM)
                hit, found = hits(data, starts, ends, first, shared.value)
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                if hit.any():
                    doc = W.owner(first)
                    edge = np.ones(len(hit), dtype=bool)  # a run ends with its document
                    edge[1:] = ~hit[:-1] | (doc[1:] != doc[:-1])
                    begins = np.flatnonzero(hit & edge)
                    stop = np.ones(len(hit), dtype=bool)
                    stop[:-1] = ~hit[1:] | (doc[1:] != doc[:-1])
                    for a, b in zip(begins, np.flatnonzero(hit & stop), strict=True):
                        d = doc[a]
                        spans[d].append({"first": int(a - first[d]), "last": int(b - first[d])})
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(first), pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                     pa.array([sorted(found.get(d, ())) for d in range(part.num_rows)], pa.list_(pa.string()))],
                    names=[*part.schema.names, *added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *SCAN]))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items, in lists of at most ``limit`` bytes of text (a
    longer item alone); one list is on the driver at a time."""
    block, size = [], 0
    # identical rows say nothing new; items without text have no window
    rows = benchmark.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).distinct()
    for row in rows.toLocalIterator():
        if block and size + len(row.t.encode()) > limit:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t.encode())
    yield block


RESULTS = ("n_words", "n_hit", "hit_spans", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` (runs of hit words,
    as first and last word index) and ``items`` (ids of items found, as sorted
    strings). ``settings`` are those of ``find``.

    Words are runs of letters and digits after lower-casing A-Z; a window is
    ``window`` consecutive words of an item. Nulls: a null text has no words, a
    null item id counts as the empty string. Rows that repeat an id are judged
    separately. An empty benchmark hits nothing. Where a result's name is
    taken, the new column has ``_1`` appended.
    """
    plain, text = _numbered(docs, text_col)
    found = find(plain, benchmark, text, **settings)
    return found.select(*(F.col(a).alias(b) for a, b in zip(plain.columns, docs.columns, strict=True)),
                        *(F.col(r).alias(free_name(docs.columns, r)) for r in RESULTS))


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The results for ``docs`` whose columns do not clash with them."""
    blocks = item_blocks(benchmark, item_col, item_text, block_bytes)
    out = scan(docs, text_col, next(blocks), window)
    for block in blocks:
        more = write_scratch(out, "contamination").withColumnsRenamed(
            {"n_words": "__words", "hit_spans": "__spans", "items": "__items"})
        out = (scan(more, text_col, block, window)
               .withColumn("hit_spans", F.concat("__spans", "hit_spans"))
               .withColumn("items", F.array_sort(F.array_union("__items", "items"))).drop("__words", "__spans", "__items"))
    # spans of several blocks may overlap: unite them in order
    united = F.expr(
        "aggregate(array_sort(hit_spans), cast(array() as array<struct<first:int,last:int>>), (a, s) ->"
        " if(size(a) > 0 and s.first <= element_at(a, -1).last + 1, concat(slice(a, 1, size(a) - 1),"
        " array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, s.last)))),"
        " concat(a, array(s))))")
    out = out.withColumn("hit_spans", united)
    return out.withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (a, s) -> a + s.last - s.first + 1)"))


def contaminated(found: DataFrame, per_cent: int = 5):
    """Whether hit words are at least ``per_cent`` of a document's words."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= per_cent * F.col("n_words"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, per_cent: int = 5, text_col: str = "text", **names) -> DataFrame:
    """``docs`` without contaminated documents."""
    plain, text = _numbered(docs, text_col)
    found = find(plain, benchmark, text, **names)
    return found.where(~contaminated(found, per_cent)).select(*plain.columns).toDF(*docs.columns)


def drop_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` with each hit word cut from its text, the rest untouched (a
    null text stays null)."""
    plain, text = _numbered(docs, text_col)
    found = find(plain, benchmark, text, **names)
    name = "clean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text):
                data, offsets = W.text_bytes(part.column(text))
                starts, ends, first = W.spans(W.LOWER[data], offsets, W.ALNUM)
                gone = np.zeros(len(data) + 1, dtype=np.int64)
                for d, runs in enumerate(part.column("hit_spans").to_pylist()):
                    for s in runs or ():
                        for w in range(first[d] + s["first"], first[d] + s["last"] + 1):
                            gone[starts[w]] += 1
                            gone[ends[w]] -= 1
                stays = np.cumsum(gone[:-1]) <= 0
                texts = [data[a:b][stays[a:b]].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                valid = part.column(text).is_valid().to_pylist()
                clean = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, clean], names=[*part.schema.names, name])

    cleaned = found.mapInArrow(run, StructType([*found.schema.fields]).add(name, StringType()))
    return cleaned.select(*(F.col(name if c == text else c).alias(c) for c in plain.columns)).toDF(*docs.columns)


def _numbered(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with columns named by number, so that no name can clash, and the text's."""
    names = [f"own{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(text_col)]
