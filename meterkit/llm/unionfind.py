"""Connected components of a link table, on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterkit.llm.scratch import write_scratch

#: Nodes that one task's union-find holds before it hands on its forest.
FOREST_NODES = 500_000


def local_forests(links: DataFrame) -> DataFrame:
    """Links (u, v) thinned by union-find within each partition: every node
    with the smallest node of its tree. What is connected stays connected."""
    def forest(parent: dict[int, int]) -> pa.RecordBatch:
        pairs = [(x, root(parent, x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_pydict({"u": [x for x, _ in pairs], "v": [r for _, r in pairs]}, schema=schema)

    def root(parent: dict[int, int], x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = root(parent, u), root(parent, v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > FOREST_NODES:
                yield forest(parent)
                parent = {}
        yield forest(parent)

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (u, v): ``comp`` is the
    smallest node it can reach.

    Trees are united over the cluster by alternating large and small stars:
    every node links its larger neighbours, then its smaller ones, to the
    smallest node it knows, until nothing changes. Rounds grow with the
    logarithm of the longest path; each is written to the shared folder.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = local_forests(links).distinct()
    seen = None
    while True:
        links = write_scratch(links, "links")
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        seen = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
