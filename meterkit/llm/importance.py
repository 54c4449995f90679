"""Importance resampling towards a target distribution.

An untrained pre-tokeniser, a regex split over ASCII-lowered text, returns
words with their offsets. Windows of neighbouring offset pairs are the
features; each feature's CRC picks a bucket of a histogram. The histograms of
all documents and of all target texts give every bucket a gain, the scaled log
ratio of its two smoothed shares; a document's weight is the mean gain of its
features. Noise of the Gumbel law, drawn from a hash of the id, turns the
largest scores into a sample without replacement by weight.

Texts are read once: a written table keeps two bytes a feature (the buckets),
from which both the histogram and the weights follow. The drawn documents get
their ranks from a range partitioning and per-range counts, so that no task
sorts more than a range.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from meterkit.llm import words as W
from meterkit.llm.scratch import free_name, write_scratch

BUCKETS = 10_000
SEED = 2024
#: Characters handed to the pre-tokeniser at once (longer texts are cut between words).
CHUNK = 1 << 15
#: A word character once A-Z is lower case, and its opposite.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
RESULTS = ("n_features", "weight", "score", "rank")


class Features:
    """The buckets of a text's features: runs of ``shortest`` to ``longest`` words."""

    def __init__(self, shortest: int, longest: int, buckets: int):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD + "+"), "removed", invert=True)
        self.sizes, self.buckets = range(shortest, longest + 1), buckets
        self.dtype = np.uint16 if buckets <= 1 << 16 else np.uint32

    def offsets(self, lowered: str) -> tuple[list[str], list[tuple[int, int]]]:
        """Words and their (start, end), in order."""
        words, pairs, at = [], [], 0
        while at < len(lowered):
            to = at + CHUNK
            if to < len(lowered):
                gap = BETWEEN.search(lowered, to)
                to = gap.start() if gap else len(lowered)
            for word, (a, b) in self.split.pre_tokenize_str(lowered[at:to]):
                words.append(word)
                pairs.append((a + at, b + at))
            at = to
        return words, pairs

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """How many words ``text`` has, and the bucket of each feature."""
        # bytes.lower() touches A-Z only
        lowered = (text or "").encode().lower().decode()
        words, pairs = self.offsets(lowered)
        found = []
        for n in self.sizes:
            if n == 1:
                runs = words
            else:
                runs = (" ".join(lowered[a:b] for a, b in pairs[i:i + n]) for i in range(len(pairs) - n + 1))
            found.extend([zlib.crc32(r.encode()) for r in runs])
        return len(words), (np.array(found, dtype=np.uint32) % self.buckets).astype(self.dtype)


def read_features(docs: DataFrame, text_col: str, names: tuple[str, str], shortest: int, longest: int, buckets: int) -> DataFrame:
    """``docs`` with the columns ``names``: number of words, and the buckets of
    all features as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shortest, longest, buckets)
        for batch in batches:
            for part in W.slices(batch, text_col):
                read = [features.of(t) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([n for n, _ in read], pa.int64()), pa.array([b.tobytes() for _, b in read], pa.binary())],
                    names=[*part.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(names[0], LongType()).add(names[1], BinaryType()))


def histogram(read: DataFrame, column: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs: one partial histogram per task, summed in
    Spark; at most ``buckets`` rows reach the driver."""
    dtype = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            data, _ = W.text_bytes(batch.column(0))
            count += np.bincount(np.frombuffer(data.tobytes(), dtype=dtype), minlength=buckets)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], names=["bucket", "n"])

    rows = (read.select(F.col(f"`{column}`").alias("b")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, dtype=np.int64)
    for row in rows:
        out[row.bucket] = row.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: 1000 times the log ratio of its smoothed shares, floored."""
    buckets, s_all, t_all = len(documents), int(documents.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + buckets) / ((float(s) + 1) * (float(t_all) + buckets))))
                     for s, t in zip(documents.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def add_weights(read: DataFrame, column: str, out: tuple[str, str], gain: np.ndarray) -> DataFrame:
    """``read`` with ``out``: number of features, and their floored mean gain
    (none: 0) in place of ``column``."""
    dtype = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    shared = read.sparkSession.sparkContext.broadcast(gain)
    kept = [f for f in read.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, mean = [], []
            for raw in batch.column(column).to_pylist():
                own = np.frombuffer(raw, dtype=dtype)
                size.append(len(own))
                mean.append(int(shared.value[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(size, pa.int64()), pa.array(mean, pa.int64())],
                names=[*(f.name for f in kept), *out])

    return read.mapInArrow(run, StructType([*kept]).add(out[0], LongType()).add(out[1], LongType()))


def noise(id_col: Column, seed: int) -> Column:
    """1000 times a draw of the Gumbel law, floored, from the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def rank_first(scored: DataFrame, score: str, ties: str, eligible: Column, count: int, out: str) -> DataFrame:
    """``scored`` (a written table) with ``out``: 1 to ``count`` for the
    eligible rows with the largest ``score``, ties to the smaller ``ties``
    (nulls first, then any order); null for the rest.

    A count per score (scores are whole thousandths of logarithms, so there are
    few tens of thousands) gives the score of the last drawn row; only rows
    from there on are range-partitioned and sorted, and a row's rank is its
    place in its range plus the sizes of the ranges before.
    """
    if count <= 0:
        return scored.withColumn(out, F.lit(None).cast("bigint"))
    tally = scored.where(eligible).groupBy(score).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(score)).collect()
    reached, last = 0, None
    for row in tally:
        reached, last = reached + row.n, row[score]
        if reached >= count:
            break
    chosen = F.coalesce(eligible, F.lit(False)) & (F.col(score) >= last)
    place = free_name(scored.columns, "__place")
    order = [F.desc(score), F.asc_nulls_first(ties)]
    # the place is the range's number in the high bits and the row's number in it
    ranged = write_scratch(scored.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order)
                           .withColumn(place, F.monotonically_increasing_id()), "ranged")
    part, sizes = F.shiftright(place, 33), {}
    for row in ranged.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row per range
        sizes[row.p] = row["count"]
    before, offsets = 0, []
    for p, n in sizes.items():
        offsets.append((p, before))
        before += n
    offset = scored.sparkSession.createDataFrame(offsets, "__range bigint, __before bigint")
    rank = F.col("__before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1
    ranked = (ranged.join(F.broadcast(offset), part == F.col("__range"))
              .select(*(f"`{c}`" for c in scored.columns), F.when(rank <= count, rank).alias(out)))
    return ranked.unionByName(scored.where(~chosen).withColumn(out, F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = 20, per_cent: int = 10, keep_text: bool = False) -> DataFrame:
    """``docs`` (without ``text_col``, unless ``keep_text``) with ``n_features``,
    ``weight``, ``score`` and ``rank``: 1, 2, ... for the ``per_cent`` per cent
    of the documents of ``least_words`` words or more with the largest scores,
    ties to the smaller id; null for all others.

    Nulls: a null text has no words; a null id draws its noise as an empty
    text and comes first among ties. Rows that repeat an id are documents of
    their own; if all else is equal, either may come first. An empty table gives an empty
    result; an empty target leaves each bucket its smoothing. Where a result's
    name is taken, the new column has ``_1`` appended. One text is held whole
    by its task, with some 100 bytes per word: texts of up to 50 MB fit an
    executor of 3 GB with two tasks.
    """
    if not 1 <= shortest <= longest:
        raise ValueError("1 <= shortest <= longest is needed")
    out = {r: free_name(docs.columns, r) for r in RESULTS}
    # columns travel under plain numbers: no name of the caller's can clash
    own = {f"c{i}": c for i, c in enumerate(docs.columns)}
    back = {c: k for k, c in own.items()}
    text, ident = back[text_col], back[id_col]
    plain = docs.toDF(*own)
    read = read_features(plain, text, ("n_words", "buckets"), shortest, longest, buckets)
    if not keep_text:
        read = read.drop(text)
        own = {k: c for k, c in own.items() if k != text}
    read = write_scratch(read, "features")
    aim = read_features(target.select(F.col(f"`{target_text}`").alias("t")), "t", ("n_words", "buckets"), shortest, longest, buckets)
    gain = gains(histogram(read, "buckets", buckets), histogram(aim, "buckets", buckets))
    weighed = add_weights(read, "buckets", ("n_features", "weight"), gain)
    scored = write_scratch(weighed.withColumn("score", F.col("weight") + noise(F.col(ident), seed)), "scored")
    eligible = F.col("n_words") >= least_words
    count = per_cent * scored.where(eligible).count() // 100
    ranked = rank_first(scored, "score", ident, eligible, count, "rank")
    return ranked.select(*(F.col(k).alias(c) for k, c in own.items()), *(F.col(r).alias(name) for r, name in out.items()))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents of ``docs`` with all their columns, best rank first
    by no promise of order. ``settings`` are those of ``resample``."""
    ranked = resample(docs, target, keep_text=True, **settings)
    rank = ranked.columns[-1]
    return ranked.where(F.col(f"`{rank}`").isNotNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
