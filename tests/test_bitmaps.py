"""Exact unique counts as bitmaps: the rows of the exact rollup, from bounded states."""

import datetime as dt

import pytest
from meterkit.operators import bitmaps as bm
from meterkit.operators.query import query_rollup
from meterkit.operators.rollup import minute_partials
from meterkit.plans.spec import MeterQuery, MeterSpec, MeterSpecError
from pyspark.sql import functions as F

T = dt.datetime
SPEC = MeterSpec("u", "visit", "unique_count", "session", ("page",))
DAY = (T(2024, 1, 1), T(2024, 1, 3))
QUERIES = (MeterQuery("day", *DAY), MeterQuery("hour", *DAY, group_by=("page", "organization")),
           MeterQuery("minute", *DAY, group_by=("user",), filters={"page": ["a"]}), MeterQuery(None, group_by=("page",)),
           MeterQuery(None), MeterQuery(None, T(2024, 1, 1, 3, 0, 30), T(2024, 1, 2, 5), group_by=("organization",)))


def visits(spark, lo, hi, per_minute):
    """``per_minute`` events a minute; a third of all sessions come back on the other page and in other minutes."""
    n = F.col("id")
    return spark.range(lo, hi).select(
        F.lit("visit").alias("type"), F.when(n % 3 > 0, F.lit("o1")).otherwise("o2").alias("organization"), F.lit("u").alias("user"),
        (F.lit(T(2024, 1, 1)) + F.make_dt_interval(mins=(n / per_minute).cast("int"))).alias("timestamp"),
        F.to_json(F.struct(F.when(n % 2 == 0, "a").otherwise("b").alias("page"),
                           F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), F.pmod(n * 7, F.lit(9001)))).alias("session"))).alias("properties"))


def values(events):
    return events.select(F.get_json_object("properties", "$.session").alias("uniq_v"))


def rows(df):
    return sorted(df.collect(), key=repr)


@pytest.fixture(params=[20, 9000], ids=["few values a minute", "many values a minute"])
def batches(request, spark, tmp_path):
    parts, states = [visits(spark, 0, 20_000, request.param), visits(spark, 15_000, 30_000, request.param)], []
    for part in parts:
        known = bm.add_values(values(part), str(tmp_path / "dictionary"))
        states.append(bm.bitmap_partials(part, SPEC, known).cache())
    return parts[0].unionByName(parts[1]), states[0].unionByName(states[1])


def test_answers_of_the_exact_rollup(batches):
    events, states = batches
    partials, merged = minute_partials(events, SPEC).cache(), bm.merge_bitmaps(states, SPEC).cache()
    for q in QUERIES:
        want = rows(query_rollup(partials, SPEC, q))
        assert rows(bm.query_bitmaps(states, SPEC, q)) == want and (want or q.from_ts), q
        assert rows(bm.query_bitmaps(merged, SPEC, q)) == want, q
    grain = ("windowstart", "organization", "user", "page", "bucket")
    assert merged.groupBy(*grain).count().where("count > 1").isEmpty()


def test_a_bucket_is_kept_the_cheaper_way(batches):
    _, states = batches
    assert states.where(F.size("positions") > bm.SPARSE).isEmpty()
    assert states.where(F.col("positions").isNull() == F.col("bitmap").isNull()).isEmpty()
    assert states.where((F.bitmap_count("bitmap") <= bm.SPARSE) | (F.length("bitmap") > 4096)).isEmpty()


def test_no_value_has_two_numbers_when_the_dictionary_grows(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    first = {r.uniq_v: r.number for r in bm.add_values(spark.createDataFrame([("a",), ("b",), ("a",), ("",), (None,)], "uniq_v string"), path).collect()}
    then = {r.uniq_v: r.number for r in bm.add_values(spark.createDataFrame([("b",), ("c",)], "uniq_v string"), path).collect()}
    assert set(first) == {"a", "b", ""} and set(then) == {"a", "b", "", "c"}
    assert first.items() <= then.items() and len(set(then.values())) == 4
    assert bm.add_values(spark.createDataFrame([], "uniq_v string"), path).count() == 4


def test_a_second_writer_looks_again(spark, tmp_path, monkeypatch):
    """Another writer's values become visible between the look-up and the commit."""
    path, commit, raced = str(tmp_path / "dictionary"), bm.BatchLog.commit, []

    def late(log, change, *args, **kwargs):
        if not raced:
            raced.append(True)
            bm.add_values(spark.createDataFrame([("x",), ("y",)], "uniq_v string"), path)
        return commit(log, change, *args, **kwargs)

    monkeypatch.setattr(bm.BatchLog, "commit", late)
    got = bm.add_values(spark.createDataFrame([("y",), ("z",)], "uniq_v string"), path).collect()
    assert sorted(r.uniq_v for r in got) == ["x", "y", "z"] and len({r.number for r in got}) == 3


def test_values_without_a_number_fail(spark, tmp_path):
    events = visits(spark, 0, 100, 3)
    known = bm.add_values(values(events.limit(10)), str(tmp_path / "dictionary"))
    with pytest.raises(Exception, match="value without a number"):
        bm.bitmap_partials(events, SPEC, known).collect()


def test_no_events_and_other_meters(spark, tmp_path):
    none = visits(spark, 0, 0, 1)
    states = bm.bitmap_partials(none, SPEC, bm.add_values(values(none), str(tmp_path / "dictionary")))
    assert rows(bm.query_bitmaps(states, SPEC, QUERIES[0])) == []
    assert rows(bm.query_bitmaps(states, SPEC, MeterQuery(None))) == rows(query_rollup(minute_partials(none, SPEC), SPEC, MeterQuery(None)))
    with pytest.raises(MeterSpecError):
        bm.bitmap_partials(none, MeterSpec("s", "visit", "sum", "session", ("page",)), states)


def test_states_are_smaller_than_rows(spark, tmp_path):
    """Many sessions a minute: bytes of the stored states against the exact rows."""
    events = visits(spark, 0, 40_000, 9000)
    known = bm.add_values(values(events), str(tmp_path / "dictionary"))
    minute_partials(events, SPEC).coalesce(1).write.parquet(str(tmp_path / "rows"))
    bm.bitmap_partials(events, SPEC, known).coalesce(1).write.parquet(str(tmp_path / "states"))
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).glob("*.parquet")) for k in ("rows", "states")}
    print(f"bytes an event: rows {size['rows'] / 40_000:.2f}, bitmaps {size['states'] / 40_000:.2f}")
    assert size["states"] * 2 < size["rows"]
