"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``chunk`` characters is counted in one go. A longer one is
cut into chunks that overlap; chunks are encoded on their own, in parallel,
with the positions at which pieces (the tokenizer's first split) start. What a
tokenizer makes of a text from a piece start onwards depends only on the text
from there, so a position at which both neighbours start a piece is a proven
common boundary: left of it the left chunk holds, right of it the right one.
Positions so near a chunk's right end that text beyond it could move them are
not used. Texts without a common boundary in some overlap are cut again with
wider overlaps, until a chunk holds the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from meterkit.llm import pretokens
from meterkit.llm import words as W
from meterkit.llm.scratch import free_name, write_scratch

#: Characters of a chunk and of the overlap at first.
CHUNK = 1 << 15
OVERLAP = 1 << 8
#: Growth of the overlap when alignment fails.
WIDEN = 16
#: Piece counts a Python worker remembers at most (some 150 bytes each).
REMEMBERED = 400_000


class PieceCounts(dict):
    """Tokens per piece, asked from the tokenizer once per new piece."""

    def __init__(self, tables: pretokens.ByteBpe):
        self.tables = tables

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = len(self.tables.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            self[piece] = n
        return n


_counters: dict[str, PieceCounts] = {}


def counter(content: str) -> PieceCounts:
    """This worker's counter for a tokenizer file."""
    if content not in _counters:
        _counters.clear()
        _counters[content] = PieceCounts(pretokens.load(content))
    return _counters[content]


def _with_counts(df: DataFrame, text_col: str, out: str, content) -> DataFrame:
    """``df`` with the token count of each text, one text at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(content.value)
        for batch in batches:
            for part in W.slices(batch, text_col):
                n = [sum(map(counts.__getitem__, counts.tables.pieces(text or ""))) for text in part.column(text_col).to_pylist()]
                rest = [c for c in part.schema.names if c != text_col]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(n, pa.int64())], names=[*rest, out])

    kept = [f for f in df.schema.fields if f.name != text_col]
    return df.mapInArrow(run, StructType([*kept]).add(out, LongType()))


def cut(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(rid, part, last, piece) of (rid, text): chunks with their overlaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rid, text = batch.column("rid")[i].as_py(), batch.column("text")[i].as_py()
                for part, at in enumerate(range(0, len(text), chunk)):
                    # a rest that the overlap covers anyway needs no chunk
                    last = at + chunk + overlap >= len(text)
                    yield pa.RecordBatch.from_pydict(
                        {"rid": [rid], "part": [part], "last": [last], "piece": [text[at:at + chunk + overlap]]}, schema=schema)
                    if last:
                        break

    schema = pa.schema([("rid", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("piece", pa.string())])
    return huge.select("rid", "text").mapInArrow(run, "rid long, part long, last boolean, piece string")


PART = "rid long, part long, last boolean, total long, head array<struct<p:long,n:long>>, tail array<struct<p:long,n:long>>"


def encode_parts(parts: DataFrame, chunk: int, overlap: int, content) -> DataFrame:
    """PART of each chunk: all its tokens, and for piece starts in the overlap
    with the chunk before (``head``) and after (``tail``) the position within
    the overlap and the chunk's tokens before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(content.value)
        # what stands within a special string's length (and some) of the end may change with what follows
        margin = max([16, *map(len, counts.tables.special)]) * 2
        for batch in batches:
            for row in batch.to_pylist():
                pieces = counts.tables.pieces(row["piece"])
                starts = [0, *accumulate(map(len, pieces))]
                before = [0, *accumulate(map(counts.__getitem__, pieces))]
                sure = len(row["piece"]) - margin
                yield pa.RecordBatch.from_pydict({
                    "rid": [row["rid"]], "part": [row["part"]], "last": [row["last"]], "total": [before[-1]],
                    "head": [[{"p": p, "n": n} for p, n in zip(starts, before, strict=True) if 0 < p < overlap] if row["part"] else []],
                    "tail": [[{"p": p - chunk, "n": n} for p, n in zip(starts, before, strict=True) if chunk < p < sure] if not row["last"] else []],
                }, schema=schema)

    pair = pa.list_(pa.struct([("p", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("rid", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("total", pa.int64()), ("head", pair), ("tail", pair)])
    return parts.mapInArrow(run, PART)


def splice(encoded: DataFrame) -> DataFrame:
    """(rid, n_tokens): null where some pair of neighbours has no common
    boundary. Neighbours are joined by number; nothing is gathered per text
    but sums."""
    right = encoded.where("part > 0").select("rid", (F.col("part") - 1).alias("part"), F.col("head").alias("next"))
    joined = encoded.join(right, ["rid", "part"], "left")
    at = F.array_min(F.array_intersect(F.col("tail.p"), F.col("next.p")))
    joined = joined.withColumn("at", at)
    n_left = F.expr("if(last, total, try_element_at(filter(tail, x -> x.p = at), 1).n)")
    n_right = F.expr("if(last, 0L, try_element_at(filter(next, x -> x.p = at), 1).n)")
    return (joined.withColumn("n", n_left - n_right).groupBy("rid")
            .agg(F.sum("n").alias("n"), F.count("n").alias("known"), F.count(F.lit(1)).alias("parts"))
            .select("rid", F.when(F.col("known") == F.col("parts"), F.col("n")).alias("n_tokens")))


def count_tokens(df: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "n_tokens",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` without ``text_col`` and with ``out``: the tokens of each whole
    text by the tokenizer file, no special tokens added, special strings inside
    texts read as special tokens.

    A null or empty text has none. Rows are independent: repeated ids, ties
    and null columns pass through; an empty table gives an empty result. Where
    ``out`` is taken, the new column is ``out`` with ``_1`` appended.
    """
    # columns travel under plain numbers: no name of the caller's can clash
    own = {f"c{i}": c for i, c in enumerate(df.columns)}
    text = next(k for k, c in own.items() if c == text_col)
    counted = _count(df.toDF(*own), tokenizer_path, text, chunk, overlap)
    return counted.select(*(F.col(k).alias(c) for k, c in own.items() if k != text), F.col("n_tokens").alias(free_name(df.columns, out)))


def _count(df: DataFrame, tokenizer_path: str, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """The counts for columns whose names do not clash."""
    out = "n_tokens"
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    long_text = F.coalesce(F.length(text_col), F.lit(0)) > chunk
    short = _with_counts(df.where(~long_text), text_col, out, content)
    rest = [c for c in df.columns if c != text_col]
    # whole rows of huge texts are numbered once, in a written table
    huge = write_scratch(
        df.where(long_text).select(F.struct(*rest, F.lit(0).alias("none")).alias("row"), F.col(text_col).alias("text"))
        .withColumn("rid", F.monotonically_increasing_id()), "huge")
    counted, left = None, huge
    while True:
        longest = left.agg(F.max(F.length("text"))).first()[0]
        if longest is None:
            break
        parts = cut(left, chunk, overlap).repartition("rid", "part")
        done = write_scratch(splice(encode_parts(parts, chunk, overlap, content)), "spliced")
        known = done.where("n_tokens is not null")
        counted = known if counted is None else counted.unionByName(known)
        if longest <= chunk + overlap:
            break
        left = left.join(done.where("n_tokens is null").select("rid"), "rid", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, 2 * overlap)
    if counted is None:
        return short
    of_huge = huge.select("rid", "row").join(counted, "rid").select(
        *(F.col("row").getField(c).alias(c) for c in rest), F.col("n_tokens").alias(out))
    return short.unionByName(of_huge)
