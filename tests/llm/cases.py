"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

#: Columns that clash with names the operators use inside or return.
CLASHING = ["score", "n_words", "kept", "digest", "node", "shard", "bucket", "a.b", "__raw", "__place", "__none", "__words", "__spans",
            "__items", "__clean", "hit_spans", "own0", "c0", "rid", "row", "none", "spans", "check", "id"]


def words(n: int, seed: int, vocabulary: int = 60) -> list[str]:
    r = random.Random(seed)
    return [f"{r.choice('abcdexyzéß')}{r.randrange(vocabulary)}" for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty and white texts, ties, repeated rows, copies,
    near copies, shared passages, special strings, a very long text."""
    base = words(60, 1)
    near = [*base[:30], "changed", *base[31:]]
    far = [w if i % 3 else w + "q" for i, w in enumerate(base)]
    passage = " ".join(words(30, 2))
    long_one = " ".join(words(30_000, 3, 9999))
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One two"),
        (7, " ".join(base)), (8, " ".join(near)), (9, "\n".join(base).upper()), (10, " ".join(far)),
        (11, passage), (12, "start " + passage + " middle " + passage), (13, passage + " end"),
        (14, "it's 12 o'clock<|endoftext|> ok  \n\n  fine 　漢字 ½ ² \U0001f600\x00\x1c"),
        (15, "same " * 50), (16, long_one), (17, "x" * 70_000), (18, "one"), (18, "one"), (19, None), (None, "no id"), (None, None),
        (20, " ".join(words(25, 4))), (21, "prefix " + " ".join(words(25, 4))),
    ]
    rows += [(100 + i, " ".join([*base[:i], *base[i + 1:]])) for i in range(0, 60, 2)]
    rows += [(200 + i, "copy " + passage) for i in range(25)]
    return rows


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def documents(spark, rows=None, partitions: int = 3):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


def key(value):
    return (value is not None, value)
