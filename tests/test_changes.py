"""Assignment change rules (C17-C19) after the reference's plan-management tests."""

import datetime as dt
import random

import pytest

from meterkit.operators import changes as chg


def ts(d):
    return dt.datetime(2024, 1, d)


CURRENT = [("a1", "p1", "o1", None, ts(10), ts(20), ts(1)), ("a2", "p1", None, "u1", ts(10), None, ts(1))]
CUR_SCHEMA = ("id string, plan_id string, organization_id string, user_id string, valid_from timestamp, "
              "valid_until timestamp, created_at timestamp")
CHG_SCHEMA = ("change_id string, seq long, action string, plan_id string, organization_id string, user_id string, "
              "valid_from timestamp, valid_until timestamp, clear_valid_until boolean, requested_at timestamp")


@pytest.fixture(scope="module")
def plans(spark):
    return spark.createDataFrame([("p1", None), ("p2", ts(1))], "id string, archived_at timestamp")


def run(spark, plans, changes):
    cur = spark.createDataFrame(CURRENT, CUR_SCHEMA)
    ch = spark.createDataFrame([(f"c{i}", i, *c, ts(2) + dt.timedelta(hours=i)) for i, c in enumerate(changes)],
                               CHG_SCHEMA)
    folded = chg.apply_changes(cur, ch, plans, num_partitions=4).cache()
    outcomes = [(r.change_id, r.outcome, r.reason) for r in chg.change_outcomes(folded).orderBy("change_id").collect()]
    final = {r.id: r for r in chg.final_assignments(folded).collect()}
    history = chg.history_rows(folded).orderBy("id").collect()
    return outcomes, final, history


@pytest.mark.parametrize("change,reason", [
    (("UPDATE", "p1", "o9", None, ts(11), None, False), "not_found"),
    (("UPDATE", "p1", "o1", None, ts(9), None, False), "valid_from_before_current"),
    (("UPDATE", "p1", "o1", None, ts(21), None, False), "valid_from_after_current_until"),
    (("UPDATE", "p1", "o1", None, None, ts(25), False), "valid_until_after_current"),
    (("CREATE", "p1", "o1", None, ts(1), None, False), "already_assigned"),
    (("CREATE", "p2", "o5", None, ts(1), None, False), "plan_archived"),
    (("CREATE", "p1", "o5", "u5", ts(1), None, False), "not_exactly_one_entity"),
    (("UPDATE", "p1", "o1", "u1", ts(11), None, False), "not_exactly_one_entity"),
    (("DELETE", "p1", None, None, None, None, False), "not_exactly_one_entity"),
    (("CREATE", "p1", "o5", None, ts(5), ts(4), False), "valid_from_after_valid_until"),
])
def test_rejections(spark, plans, change, reason):
    outcomes, final, history = run(spark, plans, [change])
    assert outcomes == [("c0", "rejected", reason)]
    assert set(final) == {"a1", "a2"} and history == []


def test_changes_without_an_id_are_rejected_and_lose_no_assignment(spark, plans):
    cur = spark.createDataFrame(CURRENT, CUR_SCHEMA)
    ch = spark.createDataFrame([
        (None, 0, "DELETE", "p1", "o1", None, None, None, False, ts(2)),          # the key's only change
        (None, 1, "UPDATE", "p1", None, "u1", ts(12), None, False, ts(3)),        # beside one with an id
        ("c2", 2, "UPDATE", "p1", None, "u1", ts(15), None, False, ts(4)),
        (None, 3, "CREATE", "p1", "o7", None, ts(5), None, False, ts(5)),
    ], CHG_SCHEMA)
    folded = chg.apply_changes(cur, ch, plans, num_partitions=4).cache()
    outcomes = [(r.change_id, r.action, r.outcome, r.reason) for r in chg.change_outcomes(folded).collect()]
    assert sorted(outcomes, key=str) == sorted([
        (None, "DELETE", "rejected", "missing_change_id"), (None, "UPDATE", "rejected", "missing_change_id"),
        (None, "CREATE", "rejected", "missing_change_id"), ("c2", "UPDATE", "applied", None)], key=str)
    final = [(r.id, r.valid_from) for r in chg.final_assignments(folded).collect()]
    assert sorted(final) == [("a1", ts(10)), ("a2", ts(15))]
    assert [h.id for h in chg.history_rows(folded).collect()] == ["h_c2"]


def test_sequence_applies_in_order(spark, plans):
    outcomes, final, history = run(spark, plans, [
        ("UPDATE", "p1", "o1", None, ts(12), ts(18), False),   # narrows a1
        ("UPDATE", "p1", "o1", None, ts(11), None, False),     # before the new start: rejected
        ("UPDATE", "p1", None, "u1", ts(15), ts(30), False),   # open end may be set to anything
        ("UPDATE", "p1", None, "u1", None, None, True),        # clear end: no date, no check
        ("DELETE", "p1", "o1", None, None, None, False),
        ("DELETE", "p1", "o1", None, None, None, False),       # nothing left: no-op
        ("CREATE", "p1", "o1", None, ts(3), None, False),      # key free again
    ])
    assert [o[1:] for o in outcomes] == [("applied", None), ("rejected", "valid_from_before_current"),
                                         ("applied", None), ("applied", None), ("applied", None),
                                         ("no_op", None), ("applied", None)]
    assert final["a2"].valid_from == ts(15) and final["a2"].valid_until is None
    assert final["asg_c6"].valid_from == ts(3) and "a1" not in final
    assert [(h.action, h.assignment_id, h.valid_from) for h in history] == [
        ("UPDATE", "a1", ts(12)), ("UPDATE", "a2", ts(15)), ("UPDATE", "a2", ts(15)),
        ("DELETE", "a1", ts(12)), ("CREATE", "asg_c6", ts(3))]


def test_materialized_fold_matches(spark, plans):
    cur = spark.createDataFrame(CURRENT, CUR_SCHEMA)
    ch = spark.createDataFrame([("c0", 0, "UPDATE", "p1", "o1", None, ts(12), None, False, ts(2))], CHG_SCHEMA)
    direct = sorted(chg.change_outcomes(chg.apply_changes(cur, ch, plans)).collect())
    stored = chg.apply_changes_materialized(cur, ch, plans, name="test_fold")
    assert sorted(chg.change_outcomes(stored).collect()) == direct
    assert "InMemoryFileIndex" in stored._jdf.queryExecution().executedPlan().toString()


def test_change_batches_persist_and_replay(spark, plans, scratch_dir):
    from meterkit.sources import assignments_store as st
    cur = spark.createDataFrame(CURRENT, CUR_SCHEMA)
    st.write_initial_state(cur, scratch_dir + "/state")
    batch1 = spark.createDataFrame([("c0", 0, "UPDATE", "p1", "o1", None, ts(12), None, False, ts(2)),
                                    ("c1", 1, "DELETE", "p1", None, "u1", None, None, False, ts(3))], CHG_SCHEMA)
    batch2 = spark.createDataFrame([("c2", 2, "CREATE", "p1", None, "u1", ts(5), None, False, ts(4)),
                                    ("c3", 3, "UPDATE", "p1", "o1", None, ts(11), None, False, ts(5))], CHG_SCHEMA)
    args = (scratch_dir + "/state", scratch_dir + "/history", scratch_dir + "/outcomes")
    st.apply_change_batch(spark, batch1, plans, *args, batch_id=1)
    st.apply_change_batch(spark, batch2, plans, *args, batch_id=2)
    st.apply_change_batch(spark, batch1, plans, *args, batch_id=1)   # replay of batch 1
    st.apply_change_batch(spark, batch2, plans, *args, batch_id=2)   # and of batch 2
    state = {r.id: r for r in st.read_state(spark, scratch_dir + "/state").collect()}
    assert set(state) == {"a1", "asg_c2"} and state["a1"].valid_from == ts(12)
    history = st.read_history(spark, scratch_dir + "/history").collect()
    assert sorted((h.id, h.action) for h in history) == [("h_c0", "UPDATE"), ("h_c1", "DELETE"), ("h_c2", "CREATE")]
    outcomes = {r.change_id: r.reason for r in spark.read.parquet(scratch_dir + "/outcomes").collect()}
    assert outcomes["c3"] == "valid_from_before_current"


def one_by_one(current, changes):
    """Brute force: the rules applied to one change after the other."""
    live, out = {}, {}
    for aid, plan, org, usr, start, end, _ in current:
        live[plan, org, usr] = [aid, start, end]
    for cid, _, action, plan, org, usr, start, end, clear, _ in changes:
        now, key = live.get((plan, org, usr)), (plan, org, usr)
        if action == "CREATE":
            out[cid] = "rejected" if now else "applied"
            live.setdefault(key, ["asg_" + cid, start, end])
        elif action == "DELETE":
            out[cid] = "applied" if live.pop(key, None) else "no_op"
        elif (now is None or (start and start < now[1]) or (start and now[2] and start > now[2])
              or (end and now[2] and end > now[2])):
            out[cid] = "rejected"
        else:
            out[cid] = "applied"
            live[key] = [now[0], start or now[1], end or (None if clear else now[2])]
    return out, {aid: (start, end) for aid, start, end in live.values()}


@pytest.mark.parametrize("actions,keys", [
    (("UPDATE",), 1),                                  # one key, nothing that empties it
    (("CREATE", "UPDATE", "UPDATE"), 1),
    (("CREATE", "UPDATE", "UPDATE", "UPDATE", "DELETE"), 1),
    (("CREATE", "UPDATE", "DELETE"), 9),               # borders of blocks fall within and between keys
])
@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_agree_with_one_change_after_the_other(spark, plans, actions, keys, seed):
    rnd = random.Random(seed)
    day = lambda chance: dt.datetime(2024, 1, 10) + dt.timedelta(hours=rnd.randrange(900)) if rnd.random() < chance else None
    current = [("a0", "p1", "o0", None, ts(10), None, ts(1)), ("a9", "p1", "o99", None, ts(10), ts(20), ts(1))]
    changes = []
    for i in range(300):
        action = rnd.choice(actions)
        start = day(1.0 if action == "CREATE" else 0.6)
        end = day(0.15)
        if action == "CREATE" and end and end < start:
            end = None
        changes.append((f"c{i:03d}", i, action, "p1", f"o{rnd.randrange(keys)}", None, start, end,
                        rnd.random() < 0.1, ts(2) + dt.timedelta(minutes=i // 3)))
    expected, live = one_by_one(current, changes)
    folded = chg.apply_changes(spark.createDataFrame(current, CUR_SCHEMA), spark.createDataFrame(changes, CHG_SCHEMA),
                               plans, num_partitions=6).collect()
    assert {r.change_id: r.outcome for r in folded if r.kind == "outcome"} == expected
    assert len([r for r in folded if r.kind == "outcome"]) == len(changes)
    finals = [r for r in folded if r.kind == "final"]
    assert {r.assignment_id: (r.valid_from, r.valid_until) for r in finals} == live and len(finals) == len(live)


def test_no_changes_leave_all_assignments(spark, plans):
    folded = chg.apply_changes(spark.createDataFrame(CURRENT, CUR_SCHEMA), spark.createDataFrame([], CHG_SCHEMA), plans)
    assert sorted((r.kind, r.assignment_id) for r in folded.collect()) == [("final", "a1"), ("final", "a2")]
