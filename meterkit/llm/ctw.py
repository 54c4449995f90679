"""Language-model scoring by context-tree weighting.

The text is read as bytes, each byte as eight binary decisions. A decision's
node in the byte's binary decomposition has a context tree of its own: its
contexts are the last 0 to ``DEPTH`` bytes. Every tree node holds how often the
decision went either way there; a Krichevsky-Trofimov estimate turns counts
into a probability, and each node mixes its own estimate with its children's
by the weights that the training text gives them:

    P_w = KT                             at full depth
    P_w = KT / 2 + (product of P_w of the children) / 2   elsewhere

so all depths take part, and a byte's probability is the product of its eight
decisions' mixed predictions. Counts are frozen after training.

On the cluster: tasks count grams (context and byte) and words, sums meet in
one aggregation. Trees are worked out where a context's grams meet, dealt by
the three latest context bytes; the levels above are small tables summed
level by level. The result is one number per gram. Grams and words frequent
enough to be among the first ``HOT`` of their kind are broadcast; documents
leave a row for each of their other grams and words, which join the rest.
Words count as equal by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from meterkit.llm import words as W
from meterkit.llm.scratch import write_scratch

#: Context bytes. A gram is a context and a byte in one 64-bit number.
DEPTH = 5
#: Latest context bytes by which trees are dealt over tasks.
SPLIT = 3
#: Entries of one kind that are broadcast at most (16 bytes each).
HOT = 1 << 20
#: Grams or words that a counting task holds before it merges or hands on.
HELD = 1_200_000
#: Rows of one table of whole trees.
TREES = 400_000
SLICE = 1 << 19
WORD, GRAM = 0, 1
END = 0x0A
#: Stands for the end of a text among word hashes.
END_KEY = np.uint64(0x454E44)


def normalise(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (A-Z lower-cased) joined by single spaces and an end byte, texts
    end to end; where each text begins; hashes of its tokens (words, then the
    end); and where each text's tokens begin. ``text`` ends with a line end."""
    data, offsets = W.text_bytes(part.column(text))
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    last = np.zeros(len(starts), dtype=bool)
    has = np.diff(first) > 0
    last[first[1:][has] - 1] = True
    keep[ends[~last]] = True
    keep[offsets[1:] - 1] = True
    out = data.copy()
    out[ends[~last]] = 0x20
    out[offsets[1:] - 1] = END
    total = np.concatenate(([0], np.cumsum(keep)))[offsets]
    hashed = W.word_hashes(data, starts, ends)
    tokens = np.insert(hashed, first[1:], END_KEY)
    return out[keep], total, tokens, first + np.arange(len(first))


def grams(stream: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each byte the number c1 c2 ... byte, c1 being the byte before it; a
    text is preceded by end bytes."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.full(len(stream) + depth * (len(offsets) - 1), END, dtype=W.U64)
    at = np.arange(len(stream)) + depth * (doc + 1)
    padded[at] = stream
    n = len(padded) - depth
    key = padded[depth:].copy()
    for back in range(1, depth + 1):
        key |= padded[depth - back:depth - back + n] << W.U64(8 * (depth + 1 - back))
    return key[at - depth]


# log of the gamma function: a table for small arguments, Stirling's series beyond
_SMALL = 64
_LGAMMA_HALF = np.array([math.lgamma(i + 0.5) for i in range(_SMALL)])
_LGAMMA_ONE = np.array([math.lgamma(i + 1) for i in range(_SMALL)])


def _lgamma(n: np.ndarray, add: float, table: np.ndarray) -> np.ndarray:
    x = n + add
    inverse = 1 / np.maximum(x, 1)
    far = (x - 0.5) * np.log(np.maximum(x, 1)) - x + 0.5 * math.log(2 * math.pi) + inverse / 12 - inverse ** 3 / 360 + inverse ** 5 / 1260
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1)], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of counts."""
    return (_lgamma(zeros, 0.5, _LGAMMA_HALF) + _lgamma(ones, 0.5, _LGAMMA_HALF) - 2 * _LGAMMA_HALF[0]
            - _lgamma(zeros + ones, 1.0, _LGAMMA_ONE))


def mixed(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    """log P_w of inner nodes."""
    return np.logaddexp(kt, children) - math.log(2)


def levels(key: np.ndarray, count: np.ndarray, depth: int, down_to: int) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    """Tree nodes of sorted grams, from ``depth`` up to ``down_to`` context
    bytes. Per depth and decision (0 to 7): ``key`` (context, then the bits
    before), ``ones``, ``zeros``, ``kt``, ``pw``, and ``up`` (the index of each
    node's parent one context byte shorter)."""
    out: dict[tuple[int, int], dict[str, np.ndarray]] = {}
    for d in range(depth, down_to - 1, -1):
        if d < depth:
            # the oldest context byte goes
            key = (key >> W.U64(16) << W.U64(8)) | (key & W.U64(255))
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            key, count = key[starts], np.add.reduceat(count, starts)
        for b in range(8):
            prefix = key >> W.U64(8 - b)
            starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            bit = (key >> W.U64(7 - b)) & W.U64(1)
            every, ones = np.add.reduceat(count, starts), np.add.reduceat(count * bit.astype(np.int64), starts)
            node = {"key": prefix[starts], "ones": ones, "zeros": every - ones, "kt": log_kt(every - ones, ones)}
            if d == depth:
                node["pw"] = node["kt"]
            else:
                child = out[d + 1, b]
                low = child["key"] & W.U64((1 << b) - 1)
                child["up"] = np.searchsorted(node["key"], (child["key"] >> W.U64(8 + b) << W.U64(b)) | low)
                node["pw"] = mixed(node["kt"], np.bincount(child["up"], child["pw"], len(starts)))
            out[d, b] = node
    return out


def count_all(docs: DataFrame, depth: int) -> DataFrame:
    """(kind, key, train, every): how often each gram and token occurs in
    training texts, and in all, of (text, train)."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("train", pa.int64()), ("every", pa.int64())])

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[starts], np.add.reduceat(counts, starts)

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray, train: bool) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            k, c = keys[i:i + 100_000].view(np.int64), counts[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c * train), pa.array(c)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {(k, t): [] for k in (WORD, GRAM) for t in (False, True)}
        for batch in batches:
            for train in (True, False):
                own = batch.column("train")
                of = batch.filter(own if train else pc.invert(own))
                for part in W.slices(of, "text", SLICE):
                    stream, offsets, tokens, _ = normalise(part, "text")
                    for kind, keys in ((WORD, tokens), (GRAM, grams(stream, offsets, depth))):
                        mine = held[kind, train]
                        mine.append(np.unique(keys, return_counts=True))
                        if sum(len(k) for k, _ in mine) > HELD:
                            mine[:] = [merged(mine)]
                            if len(mine[0][0]) > 0.7 * HELD:
                                yield from rows(kind, *mine.pop(), train)
        for (kind, train), mine in held.items():
            if mine:
                yield from rows(kind, *merged(mine), train)

    found = docs.select("text", "train").mapInArrow(run, "kind int, key long, train long, every long")
    return found.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


def _tops(counted: DataFrame, depth: int) -> DataFrame:
    """Nodes of SPLIT context bytes: (at, b, zeros, ones, pw); ``at`` is the
    context, then the bits before decision ``b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in W.whole_groups(batches, "part", TREES):
            tree = levels(whole.column("key").to_numpy().view(W.U64), whole.column("train").to_numpy(), depth, SPLIT)
            for b in range(8):
                n = tree[SPLIT, b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n["key"].view(np.int64)), pa.array(np.full(len(n["key"]), b, np.int32)), pa.array(n["zeros"]),
                     pa.array(n["ones"]), pa.array(n["pw"])], names=["at", "b", "zeros", "ones", "pw"])

    return _dealt(counted, depth).mapInArrow(run, "at long, b int, zeros long, ones long, pw double")


def _dealt(rows: DataFrame, depth: int) -> DataFrame:
    part = F.shiftright("key", 8 * (depth + 1 - SPLIT))
    return rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", "key")


def _weighed(level: DataFrame) -> DataFrame:
    """Summed nodes (at, b, zeros, ones, children) with ``pw`` and ``w``, the
    weight of the node's own estimate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kt = log_kt(batch.column("zeros").to_numpy(), batch.column("ones").to_numpy())
            pw = mixed(kt, batch.column("children").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pw), pa.array(np.exp(kt - pw) / 2)], names=[*batch.schema.names, "pw", "w"])

    return level.mapInArrow(run, StructType([*level.schema.fields]).add("pw", DoubleType()).add("w", DoubleType()))


def upper_levels(tops: DataFrame) -> DataFrame:
    """For each node of SPLIT context bytes, (at, b, a, rest): what the shorter
    contexts predict for a one, and the weight they leave to this node."""
    shorter = lambda c: F.expr(f"((shiftright({c}, b + 8) << b) | ({c} & ((1L << b) - 1)))")
    level, kept = tops, []
    for _ in range(SPLIT):
        summed = level.groupBy(shorter("at").alias("at"), "b").agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("children"))
        level = write_scratch(_weighed(summed), "level")
        kept.append(level)
    own = "(ones + 0.5D) / (zeros + ones + 1)"
    above = kept[-1].select("at", "b", F.expr(f"w * {own}").alias("a"), F.expr("1 - w").alias("rest"))
    for level in kept[-2::-1]:
        parent = above.select(F.col("at").alias("up"), "b", F.col("a").alias("a0"), F.col("rest").alias("r0"))
        above = (level.withColumn("up", shorter("at")).join(parent, ["up", "b"])
                 .select("at", "b", F.expr(f"a0 + r0 * w * {own}").alias("a"), F.expr("r0 * (1 - w)").alias("rest")))
    parent = above.select(F.col("at").alias("up"), "b", "a", "rest")
    return tops.select("at", "b").withColumn("up", shorter("at")).join(parent, ["up", "b"]).select("at", "b", "a", "rest")


def gram_scores(counted: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """(key, value, every): log10 of the mixed probability of each gram's byte
    in its context."""
    bits = 8 * (depth + 1 - SPLIT)
    # rows of the levels above travel with the grams of their context
    both = counted.select("key", "train", "every", F.lit(-1).alias("b"), F.lit(0.0).alias("a"), F.lit(0.0).alias("rest"),
                          F.shiftright("key", bits).alias("part")).unionByName(
        above.select(F.col("at").alias("key"), F.lit(0).cast("long").alias("train"), F.lit(0).cast("long").alias("every"), "b", "a", "rest",
                     F.expr("shiftright(at, b)").alias("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in W.whole_groups(batches, "part", TREES):
            which = whole.column("b").to_numpy()
            number, train = whole.column("key").to_numpy().view(W.U64), whole.column("train").to_numpy()
            key = number[which < 0]
            order = np.argsort(key)
            key = key[order]
            tree = levels(key, train[which < 0][order], depth, SPLIT)
            a_all, rest_all = whole.column("a").to_numpy(), whole.column("rest").to_numpy()
            value = np.zeros(len(key))
            for b in range(8):
                mine = which == b
                by = np.argsort(number[mine])
                a, rest = a_all[mine][by], rest_all[mine][by]
                for d in range(SPLIT, depth + 1):
                    n = tree[d, b]
                    if d > SPLIT:
                        a, rest = a[n["up"]], rest[n["up"]]
                    own = (n["ones"] + 0.5) / (n["ones"] + n["zeros"] + 1)
                    w = np.exp(n["kt"] - n["pw"]) / 2 if d < depth else 1.0
                    a, rest = a + rest * w * own, rest * (1 - w)
                at = np.searchsorted(tree[depth, b]["key"], key >> W.U64(8 - b))
                bit = ((key >> W.U64(7 - b)) & W.U64(1)).astype(bool)
                value += np.log10(np.where(bit, a[at], 1 - a[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(value), pa.array(whole.column("every").to_numpy()[which < 0][order])], names=["key", "value", "every"])

    dealt = both.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "key long, value double, every long")


class Table:
    """Numbers by 64-bit key, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, len(keys).bit_length())
        h = self._slot(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(h, minlength=1 << self.bits)))).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * W.U64(0x9E3779B97F4A7C15)) >> W.U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing) and whether each key is there."""
        slot = self._slot(keys)
        at, end = self.first[slot], self.first[slot + 1]
        value, found = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        open_ = np.flatnonzero(at < end)
        at = at[open_]
        while len(open_):
            hit = self.keys[at] == keys[open_]
            value[open_[hit]] = self.values[at[hit]]
            found[open_[hit]] = True
            at, open_ = at[~hit] + 1, open_[~hit]
            more = at < end[open_]
            at, open_ = at[more], open_[more]
        return value, found


def hot_bounds(values: DataFrame, limit: int) -> dict[int, int]:
    """For each kind, the smallest power of two so that at most ``limit``
    entries occur that often (a histogram of some 64 rows a kind decides)."""
    rows = values.groupBy("kind", F.floor(F.log2("every")).cast("int").alias("size")).count().collect()
    out = {}
    for kind in (WORD, GRAM):
        sizes = {r["size"]: r["count"] for r in rows if r["kind"] == kind}
        total, bound = 0, max(sizes, default=0) + 1
        while bound > 0 and total + sizes.get(bound - 1, 0) <= limit:
            bound -= 1
            total += sizes.get(bound, 0)
        out[kind] = 1 << bound
    return out


def read_texts(docs: DataFrame, tables, known_from: float, depth: int) -> DataFrame:
    """Rows of (rid, id, train, text): one with kind -1 per text (``n`` tokens,
    its bytes as key, sums over broadcast entries), and one for each other entry
    of a text, with how often it occurs there."""
    head = docs.select("rid", "id", "train").schema
    names = [*head.names, "kind", "key", "n", "n_known", "base_score", "score"]
    def sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        # every text has at least its end
        return np.add.reduceat(x, offsets[:-1]) if len(x) else np.zeros(0, x.dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE):
                rid = part.column("rid").to_numpy()
                stream, offsets, tokens, at = normalise(part, "text")
                result, rest = [], []
                for kind, keys, begin in ((WORD, tokens, at), (GRAM, grams(stream, offsets, depth), offsets)):
                    value, found = tables.value[kind].find(keys)
                    result.append(sums(value, begin))
                    if kind == WORD:
                        known = sums((found & (value > known_from)).astype(np.int64), begin)
                    if not found.all():
                        lost = np.flatnonzero(~found)
                        doc = np.searchsorted(begin, lost, side="right") - 1
                        order = np.lexsort((keys[lost], doc))
                        doc, left = doc[order], keys[lost][order]
                        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (left[1:] != left[:-1]))))
                        rest.append((kind, rid[doc[new]], left[new].view(np.int64), np.diff(np.append(new, len(left)))))
                size = part.num_rows
                own = [part.column("rid"), part.column("id"), part.column("train")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.full(size, -1)), pa.array(np.diff(offsets)), pa.array(np.diff(at)), pa.array(known),
                     pa.array(result[WORD]), pa.array(result[GRAM])], names=names)
                for kind, r, k, n in rest:
                    none = pa.nulls(len(r), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r), pa.nulls(len(r), own[1].type), pa.nulls(len(r), own[2].type), pa.array(np.full(len(r), kind)),
                         pa.array(k), pa.array(n), pa.nulls(len(r), pa.int64()), none, none], names=names)

    out = StructType([StructField(f.name, f.dataType) for f in head])
    for name in names[3:]:
        out = out.add(name, DoubleType() if name.endswith("score") else LongType())
    return docs.select("rid", "id", "train", "text").mapInArrow(run, out)


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """One row per input row: ``id``, ``trained`` (whether ``train`` holds),
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (word unigrams
    with half a count added), ``score``: log10 of the probability of the text by
    context-tree weighting, learnt from the rows where ``train`` holds, and
    ``bits_per_byte``: the code length that this means, per byte of the text.

    The text scored is its tokens: words (runs without white space, A-Z
    lower-cased) parted by one space, then one end byte. Null and empty texts
    have the end only. Rows are told apart by place, so repeated or null ids
    are rows of their own; a null ``train`` counts as false. An empty table
    gives an empty result; other columns are not looked at.
    """
    if not SPLIT < depth <= 6:
        raise ValueError(f"depth must be over {SPLIT} and at most 6")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                     F.concat(F.coalesce(text_col, F.lit("")), F.lit("\n")).alias("text"))
    counted = write_scratch(count_all(docs, depth), "counts")
    tokens = counted.where(f"kind = {WORD}")
    total, distinct = tokens.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1))).first()
    whole = total + 0.5 * (distinct + 1)
    of_grams = counted.where(f"kind = {GRAM}").drop("kind")
    tops = write_scratch(_tops(of_grams, depth), "tops")
    scored = gram_scores(of_grams, upper_levels(tops), depth)
    values = write_scratch(scored.select(F.lit(GRAM).alias("kind"), "key", "value", "every").unionByName(
        tokens.select("kind", "key", F.log10((F.col("train") + 0.5) / F.lit(whole)).alias("value"), "every")), "values")
    bounds = hot_bounds(values, hot)
    tables = []
    for kind in (WORD, GRAM):
        rows = values.where((F.col("kind") == kind) & (F.col("every") >= bounds[kind])).select("key", "value").toArrow()
        tables.append(Table(rows.column("key").to_numpy().view(W.U64), rows.column("value").to_numpy()))
    # a token without training occurrence has half a count, a known one at least 1.5
    known_from = math.log10(1 / whole)
    numbered = docs.withColumn("rid", F.monotonically_increasing_id())
    read = write_scratch(read_texts(numbered, spark.sparkContext.broadcast(tables), known_from, depth), "read")
    rare = values.where(F.col("every") < F.when(F.col("kind") == WORD, bounds[WORD]).otherwise(bounds[GRAM]))
    more = (read.where("kind >= 0").select("rid", "kind", "key", "n").join(rare.select("kind", "key", "value"), ["kind", "key"])
            .groupBy("rid").agg(F.sum(F.when(F.col("kind") == WORD, F.col("n") * F.col("value"))).alias("base_more"),
                                F.sum(F.when(F.col("kind") == GRAM, F.col("n") * F.col("value"))).alias("score_more"),
                                F.sum(F.when((F.col("kind") == WORD) & (F.col("value") > known_from), F.col("n"))).alias("known_more")))
    zero = F.lit(0)
    score = F.col("score") + F.coalesce("score_more", zero)
    return read.where("kind = -1").join(more, "rid", "left").select(
        "id", F.col("train").alias("trained"), F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("known_more", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base_more", zero)).alias("base_score"),
        score.alias("score"), (-score * math.log2(10) / F.col("key")).alias("bits_per_byte"))
