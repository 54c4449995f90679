"""Exact dedup and sharding."""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meterkit.llm import exact_dedup, scratch, shard

from . import cases


def _groups(rows):
    by = defaultdict(list)
    for doc_id, text in rows:
        by[text or ""].append(doc_id)
    return by


@pytest.mark.parametrize("heavy", [1000, 1])
def test_exact_groups_match_brute_force(spark, heavy):
    rows = cases.texts()
    got = exact_dedup.exact_groups(cases.documents(spark, rows), heavy=heavy).collect()
    by = _groups(rows)
    want = Counter()
    for text, ids in by.items():
        keep = max(ids, key=cases.key)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for doc_id in sorted(ids, key=cases.key):
            stays = doc_id == keep and left
            left -= bool(stays)
            want[doc_id, keep, len(ids), bool(stays), digest] += 1
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_copies_are_dropped_with_all_columns(spark):
    rows = cases.texts()
    df = cases.with_clashes(cases.documents(spark, rows))
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    by = _groups(rows)
    want = Counter((max(ids, key=cases.key), text) for text, ids in by.items())
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want


@pytest.mark.parametrize("many", [False, True], ids=["broadcast", "joined"])
def test_copies_leave_by_id_and_texts_stay(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(scratch, "SMALL_IDS", 0)
    rows = [*dict(cases.texts()).items(), (900, "twice"), (901, "twice"), (902, None)]  # no id twice
    out = exact_dedup.drop_exact_copies(cases.with_clashes(cases.documents(spark, rows)))
    want = Counter((max(ids, key=cases.key), text) for text, ids in _groups(rows).items())
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" not in plan
    assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == (not many)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_groups(cases.documents(spark, [])).collect() == []
    assert exact_dedup.drop_exact_copies(cases.documents(spark, [])).collect() == []


def test_native_plans_have_no_python(spark):
    docs = cases.documents(spark)
    for df in (exact_dedup.exact_groups(docs), exact_dedup.drop_exact_copies(docs), shard.uniform_shards(docs, 4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("partitions,shards", [(1, 16), (7, 16), (5, 3), (3, 1)])
def test_shards_are_exact(spark, partitions, shards):
    rows = cases.texts()
    df = cases.with_clashes(cases.documents(spark, rows, partitions))
    out = shard.uniform_shards(df, shards, bucket_rows=5)
    assert out.columns == [*df.columns, "shard_1", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard_1].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in range(shards))


def test_sharding_nothing_and_few(spark):
    assert shard.uniform_shards(cases.documents(spark, []), 16).collect() == []
    got = shard.uniform_shards(cases.documents(spark, [(1, "a"), (2, None)], 2), 16).collect()
    assert sorted(r.shard for r in got) == [0, 1]
    with pytest.raises(ValueError):
        shard.uniform_shards(cases.documents(spark), 0)


def test_matrix_has_its_margins(spark):
    sizes = spark.createDataFrame([(0, 10), (1, 1), (2, 500), (3, 0), (4, 77)], "p long, n long")
    rows = shard.matrix(sizes, 588, 5, 16, 3).collect()
    counts = {r.p: [b - a for a, b in zip(r.starts, r.starts[1:])] for r in rows}
    assert {p: sum(c) for p, c in counts.items()} == {0: 10, 1: 1, 2: 500, 4: 77}
    assert all(x >= 0 for c in counts.values() for x in c)
    assert [sum(c[s] for c in counts.values()) for s in range(16)] == [37] * 12 + [36] * 4


@pytest.mark.parametrize("total,good,drawn", [(50, 20, 15), (10, 10, 4), (7, 0, 3), (9, 4, 9), (1000, 30, 500), (4, 3, 3)])
def test_draws_follow_the_hypergeometric_law(spark, total, good, drawn):
    n = 8000
    draw = shard.hypergeometric(f"{total}L", f"{good}L", f"{drawn}L", shard.uniform("5", "id"))
    got = {r.x: r["count"] for r in spark.range(n).select(F.expr(draw).alias("x")).groupBy("x").count().collect()}
    chi = 0.0
    for k in range(max(0, drawn - total + good), min(good, drawn) + 1):
        p = math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn)
        if n * p > 5:
            chi += (got.get(k, 0) - n * p) ** 2 / (n * p)
    assert set(got) <= set(range(max(0, drawn - total + good), min(good, drawn) + 1))
    assert chi < 70


def test_shuffle_is_uniform(spark):
    """Every row is as likely in every shard, whatever its partition."""
    hits = Counter()
    df = cases.documents(spark, [(i, "t") for i in range(12)], 1).repartitionByRange(4, "doc_id").cache()
    for seed in range(40):
        for r in shard.uniform_shards(df, 3, seed=seed, columns={"doc_id": F.col("doc_id")}).collect():
            hits[r.doc_id, r.shard] += 1
    chi = sum((hits[i, s] - 40 / 3) ** 2 / (40 / 3) for i in range(12) for s in range(3))
    assert chi < 55  # 24 degrees of freedom
    assert sys.getsizeof(hits)
