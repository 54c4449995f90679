"""MinHash near-deduplication with SuperMinHash signatures.

1. A document's set of word shingles becomes a SuperMinHash signature: every
   element visits the signature's places in the order of its own random
   permutation, with a random number plus its rank as value; the smallest
   value stays in each place. A visit of rank r can't win once all places hold
   less than r, so the walk stops early.
2. Documents with equal sets are one class from here on (exact, by digest).
3. Signatures are cut into bands; classes with an equal band share a bucket.
4. Each bucket has a leader, the member with the most bucket company. Members
   are compared with their leaders on the full sets, one pair a member, and
   links are united by union-find.
5. What a bucket's leader did not connect, its rest, is compared with the
   bucket in blocks of bounded size: tasks multiply the incidence matrices of a
   rest block and a member block and hand on only links that unite something.
   Jaccard distance is a metric, so members whose distances to the leader
   differ by more than the linking distance are never linked; buckets are cut
   by that first. So a large group of near copies costs one comparison a member
   for most, and no link between two members of a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from meterkit.llm import words as W
from meterkit.llm.scratch import without_ids, write_scratch
from meterkit.llm.unionfind import components

SHINGLE = 5
THRESHOLD = 80
#: Set elements of a member block and of a rest block on average (8 bytes each),
#: and elements and cells (4 bytes each) of the matrices multiplied at once.
BLOCK = 400_000
REST_BLOCK = 30_000
ELEMENTS = 15_000
CELLS = 4_000_000
#: Class ids up to which the filter for their texts is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def bands_for(threshold: int) -> tuple[int, int]:
    """(bands, rows per band) so that a pair right at ``threshold`` per cent
    shares no band with a probability under 1e-6."""
    rows = 5
    share = (threshold / 100) ** rows
    return int(np.ceil(-6 * np.log(10) / np.log1p(-share))), rows


def super_minhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (``n_docs`` by ``m``; infinite for empty sets) of the sets of
    64-bit ``elements``, each owned by document ``doc``."""
    h = np.full(n_docs * m, np.inf)
    order = None  # the elements' permutations so far
    for rank in range(m):
        if rank:
            # a document goes on while one of its places holds rank or more
            going = (h.reshape(n_docs, m) >= rank).any(axis=1)[doc]
            if not going.any():
                break
            if order is None:
                elements, doc, at = elements[going], doc[going], at[going]
                order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                order[np.arange(len(at)), at] = 0
                order[:, 0] = at
            elif not going.all():
                elements, doc, order = elements[going], doc[going], order[going]
        x = W.mix64(elements + W.U64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = (x >> W.U64(11)) * 2.0 ** -53 + rank
        pick = rank + (((W.mix64(x ^ W.U64(0xA0761D6478BD642F)) >> W.U64(32)) * W.U64(m - rank)) >> W.U64(32)).astype(np.int64)
        if order is None:
            at = pick
        else:
            row = np.arange(len(elements))
            at = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, rank]
            order[:, rank] = at
        np.minimum.at(h, doc * m + at, value)
    return h.reshape(n_docs, m)


def shingle_sets(part: pa.RecordBatch, text: str, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: ``k`` words, or the
    whole sequence of a text with fewer words; none for a text without words."""
    data, offsets = W.text_bytes(part.column(text))
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    hashed = W.word_hashes(data, starts, ends)
    windows = W.window_hashes(hashed, k)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        sets.append(np.unique(windows[a:b - k + 1]) if b - a >= k else W.window_hashes(hashed[a:b], int(b - a)) if b > a else hashed[:0])
    return sets


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, buckets) of (id, text): set size, set digest, and one
    bucket number per band (none for an empty set)."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                sets = shingle_sets(part, "text", k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                h = super_minhash(np.concatenate([np.zeros(0, dtype=W.U64), *sets]), np.repeat(np.arange(len(sets)), n), len(sets), m)
                places = W.mix64(h.view(W.U64) + np.arange(m, dtype=W.U64)).reshape(len(sets), bands, rows)
                bucket = np.zeros((len(sets), bands), dtype=W.U64)
                for r in range(rows):
                    bucket = W.mix64(bucket * W.U64(0x9FB21C651E98DF25) + places[:, :, r])
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n), pa.array([digest(s) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket[n > 0].ravel().view(np.int64)))],
                    names=["id", "n", "digest", "buckets"])

    schema = (StructType([df.schema["id"]]).add("n", LongType()).add("digest", BinaryType()).add("buckets", ArrayType(LongType())))
    return df.select("id", "text").mapInArrow(run, schema)


def sets_of(df: DataFrame, k: int) -> DataFrame:
    """(digest, elements) of (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                sets = shingle_sets(part, "text", k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(s) for s in sets], pa.binary()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "elements"])

    return df.select("text").mapInArrow(run, "digest binary, elements array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with the sizes of their sets' intersection and union."""
    joined = (pairs.join(sets.select(F.col("node").alias("v"), F.col("elements").alias("b")), "v")
              .join(sets.select(F.col("node").alias("u"), F.col("elements").alias("a")), "u"))
    joined = joined.withColumn("both", F.size(F.array_intersect("a", "b")))
    return joined.select("u", "v", "both", (F.size("a") + F.size("b") - F.col("both")).alias("either"))


def block_links(rows: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) between components within blocks: ``rows`` (block, is_rest,
    node, comp, elements) are dealt and sorted by block, and a block's rest is
    compared with all of its members. Only links that unite two trees of the
    block are handed on."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(nodes: np.ndarray, comps: np.ndarray, rest: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        mine, others = np.flatnonzero(rest), np.flatnonzero(~rest)
        if not len(mine) or not len(others):
            return []
        out = []
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        for some in np.split(mine, _cuts(sizes[mine])):
            universe = np.unique(np.concatenate([sets[i] for i in some]))
            left = _incidence([sets[i] for i in some], universe)
            rows = max(1, CELLS // len(universe))
            for at in range(0, len(others), rows):
                part = others[at:at + rows]
                both = (left @ _incidence([sets[i] for i in part], universe).T).astype(np.int64)
                either = sizes[some][:, None] + sizes[part][None, :] - both
                for x, y in zip(*np.nonzero((100 * both >= threshold * either) & (comps[some][:, None] != comps[part][None, :])), strict=True):
                    a, b = root(int(comps[some[x]])), root(int(comps[part[y]]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in W.whole_groups(batches, "block", 2000):
            block = whole.column("block").to_numpy()
            comps, nodes = whole.column("comp").to_numpy(), whole.column("node").to_numpy()
            rest = whole.column("is_rest").to_numpy()
            elements = whole.column("elements").combine_chunks()
            flat, ends = elements.flatten().to_numpy(), np.concatenate(([0], np.cumsum(elements.value_lengths().to_numpy())))
            edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                found = links(nodes[a:b], comps[a:b], rest[a:b], [flat[ends[i]:ends[i + 1]] for i in range(a, b)])
                if found:
                    yield pa.RecordBatch.from_pydict({"u": [u for u, _ in found], "v": [v for _, v in found]}, schema=schema)

    return rows.select("block", "is_rest", "node", "comp", "elements").mapInArrow(run, "u long, v long")


def _cuts(sizes: np.ndarray) -> np.ndarray:
    """Where to cut rows so that a part has about ELEMENTS elements (a longer
    set is a part of its own) and few enough rows for CELLS cells."""
    part, row = np.cumsum(sizes) // ELEMENTS, np.arange(len(sizes)) // (CELLS // ELEMENTS)
    return np.flatnonzero((part[1:] != part[:-1]) | (row[1:] != row[:-1])) + 1


def _incidence(sets: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    """Which element of ``universe`` is in which set, as 0 and 1."""
    out = np.zeros((len(sets), len(universe)), dtype=np.float32)
    flat = np.concatenate(sets)
    at = np.searchsorted(universe, flat)
    at[at == len(universe)] = 0
    there = universe[at] == flat
    out[np.repeat(np.arange(len(sets)), [len(x) for x in sets])[there], at[there]] = 1
    return out


def united(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, comp) after uniting the components that links (u, v) name."""
    merged = components(links).toDF("comp", "new")
    return write_scratch(label.join(merged, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels")


def link_classes(sets: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """(node, comp) of the nodes in ``members`` (bucket, node, n, company):
    steps 4 and 5."""
    leaders = members.groupBy("bucket").agg(F.max(F.struct("company", "node", "n")).alias("l"))
    led = write_scratch(members.join(leaders, "bucket").where("node <> l.node").select(
        "bucket", "node", "n", F.col("l.node").alias("leader"), F.col("l.n").alias("n_leader")), "led")
    pairs = led.select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    known = write_scratch(similar(pairs, sets), "known")
    links = known.where(F.col("both") * 100 >= threshold * F.col("either")).select("u", "v")
    nodes = members.select("node").distinct().withColumn("comp", F.col("node"))
    label = united(nodes, links)

    # the rest: members that their bucket's leader did not connect
    of_leader = label.select(F.col("node").alias("leader"), F.col("comp").alias("c_leader"))
    rows = (led.join(known.withColumnsRenamed({"u": "leader", "v": "node"}), ["leader", "node"])
            .join(label, "node").join(of_leader, "leader")
            .withColumn("is_rest", F.col("comp") != F.col("c_leader")))
    # cells as wide as the linking distance (and a little, for rounding), each member in its own and the next
    width = 100 - threshold
    cell = F.floor((F.col("either") - F.col("both")) * 100 / (F.col("either") * max(width, 1) * 1.001)).cast("int")
    rows = rows.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    rows = write_scratch(rows.select("bucket", "cell", "node", "comp", "n", "is_rest"), "cells")
    sizes = rows.groupBy("bucket", "cell").agg(
        F.min("comp").alias("a"), F.max("comp").alias("z"), F.sum("n").alias("every"),
        F.sum(F.when(F.col("is_rest"), F.col("n")).otherwise(0)).alias("some")).where("a <> z")
    sizes = sizes.select("bucket", "cell", F.ceil(F.col("every") / BLOCK).cast("int").alias("parts"),
                         F.ceil(F.col("some") / REST_BLOCK).cast("int").alias("rests"))
    rows = rows.join(sizes, ["bucket", "cell"])
    spot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    block = lambda r, s: F.xxhash64("bucket", "cell", r, s)
    all_side = rows.select(F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("r"), spot("parts", 1).alias("s"), "*").select(
        block("r", "s").alias("block"), F.lit(False).alias("is_rest"), "node", "comp")
    rest_side = rows.where("is_rest").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"), spot("rests", 2).alias("r"), "*").select(
        block("r", "s").alias("block"), F.lit(True).alias("is_rest"), "node", "comp")
    placed = all_side.unionByName(rest_side).join(sets, "node").repartition("block").sortWithinPartitions("block")
    return united(label, write_scratch(block_links(placed, threshold), "links"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text: Column | None = None, shingle: int = SHINGLE,
                threshold: int = THRESHOLD, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs without white space after lower-casing A-Z. Documents whose
    shingle sets have a Jaccard similarity of ``threshold`` per cent or more
    are linked; ``component_id`` is the smallest id reachable over links, and
    of the rows with that id in a component one is kept. A text without words
    (or null) is linked with nothing, not even with its like, and kept. A null
    id sorts before all others. Rows that repeat id and text are one class. An
    empty table gives an empty result; other columns are not looked at.
    """
    if bands is None or rows is None:
        bands, rows = bands_for(threshold)
    source = df.select(F.col(id_col).alias("id"), (F.col("text") if text is None else text).alias("text"))
    # rid tells rows apart; writing the table fixes it
    signed = write_scratch(signatures(source, shingle, bands, rows).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    classes = (signed.where("n > 0").groupBy("digest")
               .agg(F.min(F.struct("id", "rid")).alias("first"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
               .withColumn("node", F.monotonically_increasing_id()))
    classes = write_scratch(classes, "classes")
    placed = classes.select("node", "n", F.explode("buckets").alias("bucket"))
    company = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = write_scratch(placed.join(company, "bucket"), "members")
    degree = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = write_scratch(members.join(degree, "node").select("bucket", "node", "n", "company"), "members")
    wanted = write_scratch(members.select("node").distinct().join(
        classes.select("node", "digest", F.col("first.id").alias("id")), "node"), "wanted")
    ids = wanted.select(F.col("id").alias("__id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    texts = source.join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sets = write_scratch(sets_of(texts, shingle).join(wanted.select("node", "digest"), "digest")
                         .groupBy("node").agg(F.first("elements").alias("elements")), "sets")
    label = link_classes(sets, members, threshold)
    named = (classes.select("node", "digest", "first").join(label, "node", "left")
             .withColumn("comp", F.coalesce("comp", "node")))
    least = named.groupBy("comp").agg(F.min("first").alias("least"))
    named = named.join(least, "comp").select("digest", "least")
    out = signed.where("n > 0").join(named, "digest").select(
        "id", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("kept"))
    alone = signed.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one per group of
    near copies (see ``near_groups``; rows that repeat an id stay or go
    together). Ids decide; texts stay where they are (``without_ids``)."""
    by_id = near_groups(df, id_col, F.col(text_col), **settings).groupBy("id").agg(F.bool_or("kept").alias("some"))
    return without_ids(df, id_col, write_scratch(by_id.where("not some").select("id"), "leaving"))
