"""Uniform shuffle into shards of exact sizes by a communication matrix.

1. Every input partition permutes its rows locally (sort by a seeded hash).
2. The matrix of how many rows go from each partition to each shard is drawn
   from its exact law: given the shard sizes, the counts of a uniform shuffle
   are multivariate hypergeometric. The draw goes down a binary tree of the
   partitions, so all nodes of a level are drawn side by side; each node
   splits its shard counts among its halves.
3. Row ``r`` of a partition goes to the shard whose stretch of the partition's
   matrix row holds ``r``.
4. Every shard permutes what it received. A shard is cut into buckets by the
   high bits of a second hash, so no task sorts a whole shard.

All steps are DataFrame expressions; random numbers are hashes of (seed,
place), so a lost task draws the same numbers again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterkit.llm.scratch import free_name, write_scratch

#: Rows that one sorting task of the last permutation gets on average.
BUCKET_ROWS = 50_000
#: Half-width, in standard deviations, of the summed range of a draw. What
#: lies outside is under 1e-40, far below a double's resolution.
SIGMAS = 14
#: Partitions up to which the matrix (16 shards: 150 bytes a row) is broadcast.
BROADCAST_ROWS = 100_000


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for one hypergeometric draw by inversion: how many of ``drawn``
    items, taken from ``total`` of which ``good`` are good, are good, given a
    uniform number ``u``. The weights are built from the mode outwards by
    their ratios, so no factorials are needed; inversion runs over the same
    order (mode, then upwards, then downwards)."""
    low, high = f"greatest(0L, {drawn} - ({total} - {good}))", f"least({drawn}, {good})"
    mode = f"least({high}, greatest({low}, cast(floor((cast({drawn} as double) + 1) * ({good} + 1) / ({total} + 2)) as bigint)))"
    width = (f"cast(10 + {SIGMAS} * sqrt(greatest(0D, cast({drawn} as double) * {good} / greatest({total}, 1L)"
             f" * (1 - cast({good} as double) / greatest({total}, 1L)))) as bigint)")
    # w: weight of the value before; s: sum so far; at: the value found
    up = f"w * (cast({good} - k + 1 as double) * ({drawn} - k + 1)) / (cast(k as double) * ({total} - {good} - {drawn} + k))"
    down = f"w * (cast(k + 1 as double) * ({total} - {good} - {drawn} + k + 1)) / (cast({good} - k as double) * ({drawn} - k))"

    def walk(start: str, first: str, last: str, ratio: str, aim: str) -> str:
        step = ratio.replace("w *", "a.w *", 1)
        span = f"if({first} {'<=' if ratio is up else '>='} {last}, sequence({first}, {last}), array())"
        return (f"aggregate({span}, {start}, (a, k) -> named_struct('w', {step}, 's', a.s + {step},"
                f" 'at', if(a.at is null and a.s + {step} >= {aim}, k, a.at)))")

    top, bottom = f"least({high}, m + {width})", f"greatest({low}, m - {width})"
    start = "named_struct('w', 1D, 's', 1D, 'at', cast(null as bigint))"
    ups = walk(start, "m + 1", top, up, "1e300")
    downs = walk(start, "m - 1", bottom, down, "1e300")
    # v.g: u times the sum of all weights
    found_up = walk("named_struct('w', 1D, 's', 1D, 'at', if(v.g <= 1D, v.m, cast(null as bigint)))", "v.m + 1", top.replace("m +", "v.m +"), up, "v.g")
    found_down = walk("named_struct('w', 1D, 's', v.up, 'at', cast(null as bigint))", "v.m - 1", bottom.replace("m -", "v.m -"), down, "v.g")
    one = (f"transform(array({mode}), m -> named_struct('m', m, 'up', {ups}.s, 'down', {downs}.s))")
    goal = f"transform({one}, v -> named_struct('m', v.m, 'up', v.up, 'g', {u} * (v.up + v.down - 1D)))"
    return (f"transform({goal}, v -> coalesce(if(v.g <= v.up, ({found_up}).at, ({found_down}).at),"
            f" if(v.g <= v.up, {top.replace('m +', 'v.m +')}, {bottom.replace('m -', 'v.m -')})))[0]")


def uniform(*parts: str) -> str:
    """SQL for a uniform number in (0, 1) that depends on ``parts`` only."""
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) / 9007199254740992D)"


def split_node(seed: int, level: int, shards: int) -> str:
    """SQL for the shard counts of a node's left half: ``caps`` (array) of the
    node, ``n`` its rows, ``n_left`` the left half's rows, ``node`` its place.
    One hypergeometric draw per shard, each given those before it."""
    draw = hypergeometric("st.total", "x.cap", "st.need", uniform(str(seed), f"{level}", "node", "x.s"))
    return (f"aggregate(transform(caps, (cap, s) -> named_struct('cap', cap, 's', s)),"
            f" named_struct('total', n, 'need', n_left, 'out', cast(array() as array<bigint>)),"
            f" (st, x) -> transform(array({draw}), d -> named_struct('total', st.total - x.cap, 'need', st.need - d,"
            f" 'out', concat(st.out, array(d))))[0], st -> st.out)")


def matrix(sizes: DataFrame, total: int, partitions: int, shards: int, seed: int) -> DataFrame:
    """``p`` and ``starts``: for each partition of ``sizes`` (columns ``p`` =
    0, 1, ... and ``n`` rows) where each shard's stretch begins (and the end)."""
    levels = max(0, math.ceil(math.log2(max(1, partitions))))
    base, over = divmod(total, shards)
    # one row of leaf sizes for each node of a level, summed from the leaves
    caps = [f"{base + (s < over)}L" for s in range(shards)]
    spark = sizes.sparkSession
    nodes = spark.sql(f"select 0L as node, {total}L as n, array({', '.join(caps)}) as caps")
    for level in range(levels):
        below = levels - level - 1
        left = (sizes.withColumn("at", F.shiftright("p", below)).where("at % 2 = 0")
                .groupBy((F.col("at") / 2).cast("bigint").alias("node")).agg(F.sum("n").alias("n_left")))
        nodes = (nodes.join(left, "node", "left").withColumn("n_left", F.coalesce("n_left", F.lit(0)))
                 .withColumn("left", F.expr(split_node(seed, level, shards)))
                 .select(F.explode(F.expr(
                     "array(named_struct('node', node * 2, 'n', n_left, 'caps', left), named_struct('node', node * 2 + 1,"
                     " 'n', n - n_left, 'caps', zip_with(caps, left, (a, b) -> a - b)))")).alias("c"))
                 .select("c.*").where("n > 0"))
        if level % 6 == 5:
            nodes = write_scratch(nodes, "matrix")  # keeps the plan short
    return nodes.select(
        F.col("node").alias("p"),
        F.expr("aggregate(caps, array(0L), (a, x) -> concat(a, array(a[size(a) - 1] + x)))").alias("starts"))


def uniform_shards(df: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS,
                   columns: dict[str, Column] | None = None) -> DataFrame:
    """A uniform shuffle: ``columns`` (all of ``df`` by default) with ``shard``
    (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard).

    Shard sizes differ by one at most, the first ``rows % shards`` shards
    being the larger ones. Rows are told apart by place alone, so nulls,
    repeated rows, ties and texts of any length need no care. An empty table
    gives an empty result. Columns already named shard or slot make the new
    ones shard_1 or slot_1.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    chosen = columns or {c: F.col(f"`{c}`") for c in df.columns}
    names = list(chosen)
    own = {x: free_name(names, x) for x in ("shard", "slot", "__place", "__r", "__p", "__b", "__k", "__starts", "__begin", "__raw")}
    place, r, b, k, starts, begin, raw = (own[x] for x in ("__place", "__r", "__b", "__k", "__starts", "__begin", "__raw"))
    # first local permutation: a sort within each partition, then places in order
    rows = df.select(*(c.alias(n) for n, c in chosen.items())).withColumn(place, F.monotonically_increasing_id())
    rows = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), F.lit("first"), F.col(place)), place)
    rows = rows.withColumn(place, F.monotonically_increasing_id())
    rows = write_scratch(rows.withColumn(r, F.col(place).bitwiseAND((1 << 33) - 1)).withColumn(raw, F.shiftright(place, 33)), "permuted")
    counts = rows.groupBy(raw).agg(F.count(F.lit(1)).alias("n"))
    # partitions numbered without gaps; there is one row per partition here
    sizes = write_scratch(counts.withColumn("p", F.row_number().over(Window.orderBy(raw)).cast("bigint") - 1), "sizes")
    total, partitions = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    plan = matrix(sizes.select("p", "n"), total, partitions, shards, seed).join(sizes.select("p", raw), "p")
    plan = write_scratch(plan.select(raw, F.col("starts").alias(starts)), "starts")
    if partitions <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    # the shard is the number of stretches that begin at or before the row, less one
    buckets = max(1, total // shards // bucket_rows)
    dealt = (rows.join(plan, raw)
             .withColumn(own["shard"], F.expr(f"size(filter(slice(`{starts}`, 2, {shards}), x -> x <= `{r}`))"))
             .withColumn(k, F.xxhash64(F.lit(seed), F.lit("second"), F.col(place)))
             .withColumn(b, F.pmod(k, F.lit(buckets))).drop(starts, r, raw))
    inside = Window.partitionBy(own["shard"], b).orderBy(k, place)
    # where each bucket begins in its shard: counts are map-side combined
    begins = (dealt.groupBy(own["shard"], b).agg(F.count(F.lit(1)).alias("n"))
              .withColumn(begin, F.sum("n").over(Window.partitionBy(own["shard"]).orderBy(b)) - F.col("n")).drop("n"))
    ranked = dealt.withColumn(own["slot"], F.row_number().over(inside).cast("bigint") - 1)
    return (ranked.join(begins, [own["shard"], b])
            .withColumn(own["slot"], F.col(own["slot"]) + F.col(begin))
            .select(*(f"`{c}`" for c in names), own["shard"], own["slot"]))


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Write ``df`` in uniformly shuffled shards, one folder ``shard=N`` each,
    rows in slot order within files that hold consecutive slots."""
    out = uniform_shards(df, shards, seed)
    shard, slot = out.columns[-2:]
    out.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
