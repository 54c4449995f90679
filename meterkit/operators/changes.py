"""Assignment changes: checks, application and change history.

A batch of change requests (CREATE / UPDATE / DELETE of a plan assignment,
keyed by plan and organization-or-user) is applied to the current
assignments in request order per key. Whether a change is accepted depends on
the state left by the accepted changes before it (C19: an update may not move
``valid_from`` back or past the current end, nor extend a bounded end), so a
key's changes form a sequential fold.

Plan:

1. State-independent checks (C20 archived plan, C21 entity and range, unknown
   plan) are columns computed in Spark.
2. Assignments whose key no change names pass through; only those of changed
   keys are shuffled with the changes.
3. These rows are range-partitioned by (key, order), so a key may span several
   partitions ("blocks") whatever its size. Each block is folded on its own in one
   pass, whose rows are written once. What a block cannot decide is its first stretch: the changes of its
   first key, up to a DELETE that passes the checks, depend on the state in
   which earlier blocks left that key.
4. The states at the block borders are carried over from block to block (one
   row per block, none per change). A block that lies wholly in such a stretch maps
   its entry state to an exit state. That map is learnt in pieces: a probe folds
   the block from one entry state and notes for which entry states every
   decision is the same. All blocks are probed in parallel from guessed
   entries; a block whose true entry no piece covers is probed again. Each
   round settles at least one more block of every chain.
5. The open stretches are folded in parallel from their true entry states.

The result has one outcome row per change (with the history image when
applied) and one final row per live assignment. Keys are compared column by
column, nulls included.
"""

from __future__ import annotations

import sys
import uuid
from collections import namedtuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterkit.operators.joins import bounded_broadcast
from meterkit.session import materialize

# Change actions and outcome reasons.
ACTIONS = ("CREATE", "UPDATE", "DELETE")
REASON_ALREADY_ASSIGNED = "already_assigned"
REASON_NOT_FOUND = "not_found"
REASON_FROM_BEFORE = "valid_from_before_current"
REASON_FROM_AFTER_UNTIL = "valid_from_after_current_until"
REASON_UNTIL_AFTER = "valid_until_after_current"

FOLD_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("change_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("assignment_id", T.StringType()),
    T.StructField("plan_id", T.StringType()),
    T.StructField("organization_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("valid_from", T.TimestampType()),
    T.StructField("valid_until", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])


KEY = ("plan_id", "organization_id", "user_id")
IMAGE = ("assignment_id", *KEY, "valid_from", "valid_until", "created_at", "updated_at")


def precheck(changes: DataFrame, plans: DataFrame) -> DataFrame:
    """C20/C21, entity and unknown-plan rules: reasons that do not depend on state.
    A change without an id is rejected: it could not be named in the history."""
    p = plans.select(F.col("id").alias("__pid"), F.col("archived_at").alias("__archived"))
    df = changes.join(bounded_broadcast(p), changes["plan_id"] == p["__pid"], "left")
    create = F.col("action") == "CREATE"
    one_entity = F.col("organization_id").isNotNull() != F.col("user_id").isNotNull()
    # the API's order: dates of a create, then exactly one of organization /
    # user (every action), then the plan lookup
    reason = (F.when(F.col("change_id").isNull(), F.lit("missing_change_id"))
              .when(~F.col("action").isin(*ACTIONS), F.lit("unknown_action"))
              .when(create & F.col("valid_from").isNull(), F.lit("missing_valid_from"))
              .when(create & F.col("valid_until").isNotNull() & (F.col("valid_from") > F.col("valid_until")),
                    F.lit("valid_from_after_valid_until"))
              .when(~one_entity, F.lit("not_exactly_one_entity"))
              .when(create & F.col("__pid").isNull(), F.lit("unknown_plan"))
              .when(create & F.col("__archived").isNotNull(), F.lit("plan_archived")))
    return df.select(*changes.columns, reason.alias("pre_reason"))


# Rows of the fold. Times are microseconds (long), so Python compares integers.
KEY_FIELDS = "plan_id string, organization_id string, user_id string"
STATE_FIELDS = "assignment_id string, valid_from long, valid_until long, created_at long, updated_at long"
CHANGE_FIELDS = ("kind string, change_id string, action string, pre_reason string, clear_valid_until boolean, "
                 f"requested_at long, {KEY_FIELDS}, {STATE_FIELDS}")
# ``kind``: outcome, final; open (a change of an undecided stretch), entry and exit (the borders of a block)
BLOCK_SCHEMA = f"{CHANGE_FIELDS}, outcome string, reason string, block int, nth long"
PROBE_SCHEMA = (f"block int, {STATE_FIELDS}, after long, upto long, least long, below long, moved_from boolean, "
                "moved_until boolean, touched boolean")
TIMES = ("valid_from", "valid_until", "created_at", "updated_at")

State = namedtuple("State", "assignment_id valid_from valid_until created_at updated_at")


class Path:
    """The entry states for which a stretch is decided as for the probed one:
    start in ``(after, upto]`` and end in ``[least, below)`` (no end lies above
    all, no start below all), and what the stretch moved."""

    def __init__(self):
        self.after = self.upto = self.least = self.below = None
        self.moved_from = self.moved_until = self.touched = False

    def starts_after(self, state, x):
        later = state.valid_from is not None and x < state.valid_from
        if not self.moved_from:
            if later:
                self.after = x if self.after is None else max(self.after, x)
            else:
                self.upto = x if self.upto is None else min(self.upto, x)
        return later

    def ends_before(self, state, x):
        earlier = state.valid_until is not None and x > state.valid_until
        if not self.moved_until:
            if earlier:
                self.below = x if self.below is None else min(self.below, x)
            else:
                self.least = x if self.least is None else max(self.least, x)
        return earlier


def _covers(piece, entry) -> bool:
    """Whether a probed piece holds for the entry state (None: no assignment)."""
    if entry is None or piece["entry"] is None:
        return entry is piece["entry"]
    start, end = entry.valid_from, entry.valid_until
    return ((piece["after"] is None or (start is not None and start > piece["after"]))
            and (piece["upto"] is None or start is None or start <= piece["upto"])
            and (piece["below"] is None or (end is not None and end < piece["below"]))
            and (piece["least"] is None or end is None or end >= piece["least"]))


def _exit(piece, entry):
    """The exit state of a covered entry state."""
    if entry is None or not piece["touched"]:
        return piece["exit"] if entry is None else entry
    to = piece["exit"]
    return entry._replace(valid_from=to.valid_from if piece["moved_from"] else entry.valid_from,
                          valid_until=to.valid_until if piece["moved_until"] else entry.valid_until,
                          updated_at=to.updated_at)


def _guess(piece, entry):
    """A likely exit state where no piece covers the entry (it is only probed)."""
    if entry is None or piece["exit"] is None:
        return piece["exit"] if entry is None else entry
    to = _exit(piece, entry)
    starts = [t for t in (to.valid_from, entry.valid_from) if t is not None]
    return to._replace(valid_from=max(starts) if starts else None)


def _step(state, r, path):
    """One change: (state after it, reason of a refusal, image of what was applied)."""
    if r["pre_reason"] is not None:
        return state, r["pre_reason"], None
    vf, vu, at = r["valid_from"], r["valid_until"], r["requested_at"]
    if r["action"] == "CREATE":
        if state is not None:
            return state, REASON_ALREADY_ASSIGNED, None
        made = State("asg_" + r["change_id"], vf, vu, at, at)
        return made, None, made
    if r["action"] == "DELETE":
        return None, None, state and state._replace(updated_at=at)
    if state is None:
        return None, REASON_NOT_FOUND, None
    if vf is not None and path.starts_after(state, vf):
        return state, REASON_FROM_BEFORE, None
    if vf is not None and path.ends_before(state, vf):
        return state, REASON_FROM_AFTER_UNTIL, None
    if vu is not None and path.ends_before(state, vu):
        return state, REASON_UNTIL_AFTER, None
    path.touched = True
    path.moved_from |= vf is not None
    if vu is not None or r["clear_valid_until"]:
        path.moved_until = True
        state = state._replace(valid_until=vu)
    state = state._replace(valid_from=state.valid_from if vf is None else vf, updated_at=at)
    return state, None, state


def _empties(r) -> bool:
    return r["action"] == "DELETE" and r["pre_reason"] is None


def _said(r, reason, image):
    """The outcome row of a change."""
    what = "rejected" if reason is not None else "no_op" if image is None else "applied"
    return {**r, **(image or State(*[None] * 5))._asdict(), "kind": "outcome", "outcome": what, "reason": reason}


def _border(kind, key, state, block, action=None):
    return {"kind": kind, "action": action, "block": block, **dict(zip(KEY, key)),
            **(state or State(*[None] * 5))._asdict()}


def _batch(rows, schema):
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, types[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def _fold_block(batches):
    """One pass over a block's rows in (key, order). Decides all but the open
    first stretch, and reports the borders."""
    schema = _arrow(BLOCK_SCHEMA)
    key = block = state = None
    is_open = False
    nth, path = 0, Path()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own = (r["plan_id"], r["organization_id"], r["user_id"])
            if block is None:
                block, key = r["block"], own
                is_open = r["kind"] == "change"
                if is_open:
                    out.append(_border("entry", key, None, block))
            elif own != key:
                if state is not None:
                    out.append(_border("final", key, state, block))
                if is_open:  # the key ends here: its stretch says what stays
                    out.append({**_border("open", key, None, block, "END"), "nth": nth})
                key, state, is_open = own, None, False
            if r["kind"] == "state":
                if state is not None:  # an older assignment of the same key passes through
                    out.append(_border("final", key, state, block))
                state = State(*(r[f] for f in State._fields))
            elif is_open:
                out.append({**r, "kind": "open", "nth": nth})
                nth += 1
                is_open = not _empties(r)
            else:
                state, reason, image = _step(state, r, path)
                out.append(_said(r, reason, image))
        yield _batch(out, schema)
    if block is not None:
        yield _batch([_border("exit", key, state, block, "open" if is_open else "known")], schema)


def _entry(r):
    return None if r["e_assignment_id"] is None else State(*(r["e_" + f] for f in State._fields))


def _probe(batches):
    """Fold whole stretches from their candidate entry states: one piece each."""
    block = state = path = None

    def piece():
        return {"block": block, **(state or State(*[None] * 5))._asdict(), **vars(path)}

    schema = _arrow(PROBE_SCHEMA)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["block"] != block:
                if block is not None:
                    out.append(piece())
                block, state, path = r["block"], _entry(r), Path()
            state, _, _ = _step(state, r, path)
        yield _batch(out, schema)
    if block is not None:
        yield _batch([piece()], schema)


def _fold_open(batches):
    """Fold open stretches from their true entry states."""
    schema = _arrow(BLOCK_SCHEMA)
    block = state = None
    path = Path()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["block"] != block:
                block, state = r["block"], _entry(r)
            if r["action"] == "END":
                if state is not None:
                    out.append(_border("final", tuple(r[c] for c in KEY), state, block))
                continue
            r = {f: r.get(f) for f in schema.names}
            state, reason, image = _step(state, r, path)
            out.append(_said(r, reason, image))
        yield _batch(out, schema)


# The fold runs in Python workers; ship this module's code with the task so
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _from_entries(stretches: DataFrame, entries: dict, parts: int) -> DataFrame:
    """Open rows of the blocks in ``entries`` (block -> entry state or None), in
    order, one block per task, each with its entry state (at most one row per
    block is broadcast)."""
    rows = [(block, *(state or State(*[None] * 5))) for block, state in entries.items()]
    states = stretches.sparkSession.createDataFrame(
        rows, "block int, " + ", ".join("e_" + f.strip() for f in STATE_FIELDS.split(",")))
    return (stretches.join(F.broadcast(states), "block").repartition(parts, "block")
            .sortWithinPartitions("block", "nth"))


def _carry(borders: list, stretches: DataFrame, parts: int) -> tuple[dict, list]:
    """Carry states over block borders. ``borders`` has one exit and at most one
    entry row per block. Returns the entry state of every open stretch and the
    (key, state) pairs that are live where a key ends at a border."""
    exits = {r["block"]: r for r in borders if r["kind"] == "exit"}
    opened = {r["block"]: tuple(r[c] for c in KEY) for r in borders if r["kind"] == "entry"}
    pieces: dict = {}
    while True:
        entries, finals, wanted = {}, [], {}
        key = state = None
        sure = True
        for block in sorted(exits):
            end = exits[block]
            follows = opened.get(block) == key and key is not None
            if not follows and state is not None and sure:
                finals.append((key, state))
            if block in opened:
                if not follows:
                    state, sure = None, True
                entries[block] = state
            last = tuple(end[c] for c in KEY)
            if end["action"] == "open":
                known = pieces.get(block, [])
                fits = next((p for p in known if _covers(p, state)), None)
                if fits is None:
                    wanted[block], sure = state, False
                    state = _guess(known[-1], state) if known else state
                else:
                    state = _exit(fits, state)
            else:
                state = State(*(end[f] for f in State._fields)) if end["assignment_id"] is not None else None
                sure = True
            key = last
        if not wanted:
            if state is not None:
                finals.append((key, state))
            return entries, finals
        probed = _from_entries(stretches, wanted, parts).mapInArrow(_probe, PROBE_SCHEMA)
        for r in probed.collect():  # a row per block
            found = r.asDict()
            found["entry"] = wanted[r["block"]]
            found["exit"] = State(*(r[f] for f in State._fields)) if r["assignment_id"] is not None else None
            pieces.setdefault(r["block"], []).append(found)


def _fold_rows(rows: DataFrame) -> DataFrame:
    """Rows with times in microseconds as rows of FOLD_SCHEMA."""
    return rows.select(*(F.timestamp_micros(f.name).alias(f.name) if f.name in TIMES else F.col(f.name)
                         for f in FOLD_SCHEMA.fields))


def _final(live: DataFrame) -> DataFrame:
    """Live assignments (columns IMAGE) as rows of FOLD_SCHEMA."""
    none = [F.lit(None).cast("string").alias(c) for c in ("change_id", "action", "outcome", "reason")]
    return live.select(F.lit("final").alias("kind"), *none, *IMAGE)


def _on_key(left: DataFrame, right: DataFrame) -> F.Column:
    same = [left[c].eqNullSafe(right[f"__{c}"]) for c in KEY]
    return same[0] & same[1] & same[2]


def _ordered_rows(touched: DataFrame, checked: DataFrame) -> DataFrame:
    """States and changes with one set of columns and their place in a key:
    states first (the newest last), then changes by time, seq and id."""
    micros = {c: F.unix_micros(c).alias(c) for c in TIMES}
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    states = touched.select(
        F.lit("state").alias("kind"), *nothing("string", "change_id", "action", "pre_reason"),
        F.lit(False).alias("clear_valid_until"), F.unix_micros("created_at").alias("requested_at"), *KEY, "assignment_id",
        *micros.values(), F.lit(0).alias("prio"), F.lit(0).cast("long").alias("seq"))
    changes = checked.select(
        F.lit("change").alias("kind"), "change_id", "action", "pre_reason",
        F.coalesce("clear_valid_until", F.lit(False)).alias("clear_valid_until"),
        F.unix_micros("requested_at").alias("requested_at"), *KEY, *nothing("string", "assignment_id"),
        micros["valid_from"], micros["valid_until"], *nothing("long", "created_at", "updated_at"),
        F.lit(1).alias("prio"), F.col("seq").cast("long").alias("seq"))
    return states.unionByName(changes).withColumn("tie", F.coalesce("change_id", "assignment_id"))


def fold_blocks(current: DataFrame, changes: DataFrame, plans: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Steps 1 to 3: the rows of BLOCK_SCHEMA, written, and the untouched assignments."""
    named = bounded_broadcast(changes.select(*(F.col(c).alias(f"__{c}") for c in KEY)).distinct())
    state = current.select(F.col("id").alias("assignment_id"), *KEY, "valid_from", "valid_until", "created_at",
                           F.col("created_at").alias("updated_at"))
    untouched = state.join(named, _on_key(state, named), "left_anti")
    touched = state.join(named, _on_key(state, named), "left_semi")
    order = ("prio", "requested_at", "seq", "tie")  # a total order: a retried task folds the same rows
    blocks = (_ordered_rows(touched, precheck(changes, plans)).repartitionByRange(parts, *KEY, *order)
              .sortWithinPartitions(*KEY, *order).drop("prio", "seq", "tie")
              .withColumn("block", F.spark_partition_id()))
    return materialize(blocks.mapInArrow(_fold_block, BLOCK_SCHEMA), f"assignment_blocks_{uuid.uuid4().hex}"), untouched


def apply_changes(current: DataFrame, changes: DataFrame, plans: DataFrame,
                  num_partitions: int | None = None) -> DataFrame:
    """Fold ``changes`` into ``current`` assignments.

    Returns rows of ``FOLD_SCHEMA``: ``kind='outcome'`` per change (outcome
    applied / no_op / rejected, reason, image) and ``kind='final'`` per live
    assignment after the batch. Where several current rows share a key (a plain
    table cannot forbid it), changes apply to the newest (by created_at, id) and
    the others pass through. ``num_partitions``: blocks (default: the session's
    shuffle partitions). The driver sees two rows per block.
    """
    spark = changes.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, untouched = fold_blocks(current, changes, plans, parts)
    borders = [r.asDict() for r in blocks.where("kind in ('entry', 'exit')")
               .select("kind", "action", "block", *KEY, *State._fields).collect()]
    stretches = blocks.where("kind = 'open'")
    entries, finals = _carry(borders, stretches, parts)
    told = blocks.where("kind in ('outcome', 'final')")
    if entries:
        told = told.unionByName(_from_entries(stretches, entries, parts).mapInArrow(_fold_open, BLOCK_SCHEMA))
    if finals:
        rows = [("final", *key, *state) for key, state in finals]  # at most one per block
        ended = spark.createDataFrame(rows, f"kind string, {KEY_FIELDS}, {STATE_FIELDS}")
        told = told.unionByName(ended, allowMissingColumns=True)
    return _fold_rows(told).unionByName(_final(untouched))


def apply_changes_materialized(current: DataFrame, changes: DataFrame, plans: DataFrame,
                               name: str = "assignment_changes") -> DataFrame:
    """``apply_changes`` written once to the shared checkpoint folder, so
    outcomes, history and final state are read from it instead of each
    re-running the fold."""
    return materialize(apply_changes(current, changes, plans), name)


def change_outcomes(folded: DataFrame) -> DataFrame:
    """Per change, applied / no_op / rejected with the reason."""
    return folded.where(F.col("kind") == "outcome").select("change_id", "action", "outcome", "reason")


def history_rows(folded: DataFrame) -> DataFrame:
    """C17: the history images of applied changes (new image for CREATE and
    UPDATE, old image for DELETE), stamped with the request time."""
    return (folded.where((F.col("kind") == "outcome") & (F.col("outcome") == "applied"))
            .select(F.concat(F.lit("h_"), F.col("change_id")).alias("id"), "action", "assignment_id",
                    "plan_id", "organization_id", "user_id", "valid_from", "valid_until",
                    F.col("updated_at").alias("created_at")))


def final_assignments(folded: DataFrame) -> DataFrame:
    """Assignments after the batch."""
    return folded.where(F.col("kind") == "final").select(
        F.col("assignment_id").alias("id"), "plan_id", "organization_id", "user_id",
        "valid_from", "valid_until", "created_at", "updated_at")
