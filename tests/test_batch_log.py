"""The log of live batch folders: exact coverage, concurrent commits."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterkit.sources.batch_log import BatchLog, Cover, Entry, Overlap
from meterkit.sources.storage import create_if_absent, read_text

batches = st.sets(st.tuples(st.sampled_from(["", "a", "b"]), st.integers(0, 12)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(batches, batches)
def test_cover_is_a_set_of_batches(one, two):
    a, b = Cover.of(one), Cover.of(two)
    every = {(run, n) for run in ("", "a", "b") for n in range(-1, 14)}
    assert {x for x in every if a.has(*x)} == one
    assert a | b == Cover.of(one | two) and (a == b) == (one == two)
    assert a.holds(b) == (two <= one) and a.meets(b) == bool(one & two)


@settings(max_examples=25, deadline=None)
@given(st.lists(batches.filter(bool), max_size=6))
def test_live_folders_never_share_a_batch(spark_log, writes):
    spark, fresh = spark_log
    log, seen = BatchLog(spark, fresh()), set()
    for i, wanted in enumerate(writes):
        folder = log.attempt(str(i))
        try:
            log.add(Entry(str(i), folder, Cover.of(wanted)))
        except Overlap:
            continue
        seen |= wanted  # added, or among what a folder covers already
    entries = log.snapshot().entries
    assert not any(a.covers.meets(b.covers) for a in entries for b in entries if a is not b)
    assert log.snapshot().covers() == Cover.of(seen)


@pytest.fixture(scope="module")
def spark_log(spark):
    import tempfile
    root = tempfile.mkdtemp(prefix="meterkit-log-")
    count = iter(range(10**6))
    return spark, lambda: os.path.join(root, str(next(count)))


def test_writers_at_once(spark, scratch_dir):
    def write(n):
        log = BatchLog(spark, scratch_dir)
        return log.add(Entry(str(n), log.attempt(str(n)), Cover.of([("", n)])))

    with ThreadPoolExecutor(8) as pool:
        assert all(pool.map(write, range(40)))
    log = BatchLog(spark, scratch_dir)
    assert sorted(int(e.label) for e in log.snapshot().entries) == list(range(40))
    assert len([f for f in os.listdir(log.path) if f.endswith(".json")]) <= 21
    assert not [f for f in os.listdir(log.path) if f.startswith(".0") and not f.endswith(".crc")]


def test_a_taken_name_is_never_replaced(spark, scratch_dir):
    path = f"{scratch_dir}/log/1.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: create_if_absent(spark, path, f"{n}" * 1000), range(8)))
    assert sum(won) == 1 and read_text(spark, path) == f"{won.index(True)}" * 1000
    # one file: no checksum file beside it that another writer's may replace
    assert os.listdir(f"{scratch_dir}/log") == ["1.json"]
    assert not create_if_absent(spark, path, "later") and read_text(spark, path) == f"{won.index(True)}" * 1000


def test_json_reading(spark):
    from pyspark.sql import functions as F

    from meterkit.functions.json import is_empty_key, is_json_object, json_entries
    texts = {'{"a":1}': False, '{"a":1,"a":""}': True, '{"a":"","a":{"x":1,"x":2}}': False, '{"a":"[]"}': False, '{"a":[]}': True,
             '{"b":1}': True, "": True, "null": True, '{"b":{"x":1,"x":2},"a":null}': True}
    bad = ['{"a":1}x', '{"a":1} {"a":1}', "[1]", "5", "{bad", "{'a':1}", '{"a":NaN}', '{"a":1', '{"a":1},']
    df = spark.createDataFrame([(t,) for t in [*texts, *bad]], "t string")
    entries = json_entries(F.col("t"))
    got = {r.t: (r.ok, r.empty) for r in df.select("t", entries.isNotNull().alias("ok"), is_empty_key(entries, F.lit("a")).alias("empty")).collect()}
    assert {t: got[t] for t in texts} == {t: (True, e) for t, e in texts.items()}
    assert not any(got[t][0] for t in bad)
    assert [r[0] for r in df.where(is_json_object(F.col("t"))).collect()] == [t for t in texts if t.startswith("{")]
