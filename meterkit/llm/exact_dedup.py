"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters (the frequent-items sketch behind ``approx_top_k``) name
the digests that may be frequent. Their exact counts and winners are computed
from the whole table by a map-side combined aggregation, are few by
construction, and are broadcast: rows of frequent digests are decided where
they lie. All other digests are shuffled as usual; by the counters' guarantee
none of their groups holds more than a small share of the rows. Every step is
a DataFrame expression, and only ids and digests move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterkit.llm.scratch import free_name, without_ids, write_scratch

#: Frequent digests that are broadcast at most (a row of them is about 100 bytes).
HEAVY = 1000
#: Misra-Gries counters per task and after merging. A digest with more than
#: about 3.5 / COUNTERS of all rows is always among them.
COUNTERS = 8192


def digest_rows(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``rid`` (a number for the row, fixed by writing the table), ``id`` and
    the binary SHA-256 ``digest`` of ``text`` (null counts as empty)."""
    return write_scratch(
        df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("digest"))
        .withColumn("rid", F.monotonically_increasing_id()), "digests")


def frequent(rows: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """Candidate digests by Misra-Gries, at most ``heavy`` rows. A candidate
    seen once or twice is dropped: it needs no broadcast."""
    top = rows.select(F.hex("digest").alias("d")).select(F.expr(f"approx_top_k(d, {heavy}, {counters})").alias("top"))
    return (top.select(F.explode("top").alias("t"))
            .where("t.item is not null and t.count > 2")
            .select(F.unhex("t.item").alias("digest")))


def winners(rows: DataFrame) -> DataFrame:
    """Per digest: the group's size and the row that stays (largest id; among
    rows with that id, the one written first)."""
    return rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct(F.col("id").alias("id"), (-F.col("rid")).alias("order"))).alias("best"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: Column | None = None,
                 heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    Of equal texts the row with the largest id stays. Nulls: a null text is
    the empty text; a null id loses against any other id, and a group of
    nothing but null ids keeps one of its rows. Rows that repeat id and text
    are separate rows of one group, of which one at most stays. An empty table
    gives an empty result. Other columns of ``df`` are not looked at, so their
    names can't clash.
    """
    rows = digest_rows(df, id_col, F.col("text") if text is None else text)
    candidates = F.broadcast(frequent(rows, heavy, counters))
    heavy_groups = write_scratch(winners(rows.join(candidates, "digest", "left_semi")), "heavy")
    small = F.broadcast(heavy_groups)  # at most ``heavy`` rows
    of_heavy = rows.join(small, "digest")
    rest = rows.join(small, "digest", "left_anti")
    group = Window.partitionBy("digest")
    of_rest = (rest.withColumn("group_size", F.count(F.lit(1)).over(group))
               .withColumn("best", F.max(F.struct(F.col("id").alias("id"), (-F.col("rid")).alias("order"))).over(group)))
    out = of_heavy.unionByName(of_rest)
    return out.select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == -F.col("best.order")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one per group of
    equal texts (see ``exact_groups``).

    Ids decide, and texts stay where they are (``without_ids``). Only rows of
    an id that several rows have, of which some stay and some go, are told
    apart by their digests.
    """
    groups = exact_groups(df, id_col, F.col(text_col), heavy, counters)
    by_id = groups.groupBy("id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every"))
    decided = write_scratch(by_id.where("not every").select("id", "some"), "leaving")
    stay = without_ids(df, id_col, decided.select("id"))
    mixed = decided.where("some").select("id")
    if mixed.isEmpty():
        return stay

    def key(ident: str, digest: Column) -> Column:
        # one value for (id, digest), so that a null id joins too
        return F.sha2(F.concat_ws(":", digest, F.col(ident).cast("string")), 256)

    name, ident = free_name(df.columns, "__copy_key"), free_name(df.columns, "__mixed_id")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    kept = groups.where("kept").select(key("id", F.col("text_sha256")).alias(name))
    rows = df.join(mixed.toDF(ident), F.col(id_col).eqNullSafe(F.col(ident)), "left_semi").withColumn(name, key(id_col, digest))
    # the merge join sorts by the key, which is the order dropDuplicates needs
    return stay.union(rows.join(kept.hint("merge"), name, "left_semi").dropDuplicates([name]).drop(name))
