"""Chat formatting by minimum-cost role repair.

A conversation is legal if an optional system turn comes first, user and
assistant take turns from there, user first, and an assistant turn is last.
Dynamic programming over that automaton finds the cheapest way to make a
conversation legal: merging a turn into the one before it, relabelling a turn,
or inserting empty turns.  The repaired sequence is then rendered.

Costs along the automaton form a small matrix in the (min, +) semiring.  The
turns are range partitioned in the order of conversations and turns and cut
into stretches of a bounded number of rows, whatever their turn numbers, so no
task holds a whole conversation of unbounded length.  Each stretch gives one
matrix; chained from the front they give the costs before each stretch, and
chained from the back the state in which each stretch ends.  Every stretch is
then repaired on its own, just as one pass over the conversation would do it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

# The roles, in the order of the automaton's states after START.
ROLES = ["system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
# Legal successors of each state, and the states that may end.
NEXT = {START: [SYSTEM, USER], SYSTEM: [USER], USER: [ASSISTANT], ASSISTANT: [USER]}
FINAL = [ASSISTANT]

MERGE, RELABEL, INSERT = 1.0, 3.0, 2.0
#: Rows of a stretch.
STRETCH = 1000
INF = float("inf")


def _insertions() -> dict[tuple[int, int], list[int]]:
    """The fewest empty turns that lead from a state to one before which a turn of the other may stand."""
    found: dict[tuple[int, int], list[int]] = {}
    for s in NEXT:
        paths = [(s, [])]
        while paths:
            at, path = paths.pop(0)
            for t in NEXT[at]:
                if (s, t) not in found:
                    found[s, t] = path
                    paths.append((t, path + [t]))
    return found


PATHS = _insertions()


def step_costs(role: str | None) -> np.ndarray:
    """Cost of a turn between each two states: rows are states before it, columns the state after it."""
    out = np.full((4, 4), INF)
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            label = 0.0 if role == ROLES[t - 1] else RELABEL
            best = MERGE if s == t else INF
            if (s, t) in PATHS:
                best = min(best, INSERT * len(PATHS[s, t]))
            out[s, t] = label + best
    return out


_STEPS: dict[str | None, np.ndarray] = {r: step_costs(r) for r in (*ROLES, None)}
END = np.array([min((INSERT * (len(PATHS[s, f]) + 1) for f in FINAL if (s, f) in PATHS), default=INF) if s not in FINAL else 0.0 for s in range(4)])
END[START] = 0.0  # an empty conversation is left alone


def _step(role: str | None) -> np.ndarray:
    return _STEPS.get(role, _STEPS[None])


def stretch_matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost of a stretch between each two states."""
    m = np.full((4, 4), INF)
    np.fill_diagonal(m, 0.0)
    for r in roles:
        m = (m[:, :, None] + _step(r)[None, :, :]).min(axis=1)
    return m


def best_path(steps: list[np.ndarray], entry: np.ndarray, ends: np.ndarray) -> tuple[int, list[int]]:
    """The state before the first step and those after each on the cheapest path from the costs ``entry``; lower states win ties, from the back."""
    cost = entry
    back = []
    for m in steps:
        reach = cost[:, None] + m
        back.append(reach.argmin(axis=0))
        cost = reach.min(axis=0)
    at = int((cost + ends).argmin())
    path = []
    for b in reversed(back):
        path.append(at)
        at = int(b[at])
    return at, path[::-1]


def only(state: int) -> np.ndarray:
    """Costs that allow one state."""
    out = np.full(4, INF)
    out[state] = 0.0
    return out


def _head(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSE = "<|end|>\n"


def repair(
    roles: list[str | None], texts: list[str | None], entry: np.ndarray | None = None, leave: int | None = None, last: bool = True
) -> list[tuple]:
    """Repair a stretch: for each turn its new role, action, the roles inserted before and after it, and its rendering.

    ``entry`` has the costs of the states before it (the start, if none) and
    ``leave`` the state that it ends in.  The renderings of a conversation's
    turns, one after the other, are the rendered conversation.  Markers that
    stand in a text are broken by a blank.
    """
    before, states = best_path([_step(r) for r in roles], only(START) if entry is None else entry, END if leave is None else only(leave))
    out = []
    for k, (role, text, t) in enumerate(zip(roles, texts, states)):
        label = 0.0 if role == ROLES[t - 1] else RELABEL
        path = PATHS.get((before, t))
        merge = before == t and (path is None or MERGE <= INSERT * len(path))
        inserted = [] if merge else path
        action = ("relabel" if label else "") + ("+" if label and merge else "") + ("merge" if merge else "") or "keep"
        body = (text or "").replace("<|", "< |")
        if merge:
            shown = "\n" + body
        else:
            shown = (CLOSE if before != START else "") + "".join(_head(i) + CLOSE for i in inserted) + _head(t) + body
        after: list[int] = []
        if last and k == len(roles) - 1:
            shown += CLOSE
            if t not in FINAL:
                f = min((f for f in FINAL if (t, f) in PATHS), key=lambda f: len(PATHS[t, f]))
                after = PATHS[t, f] + [f]
                shown += "".join(_head(i) + CLOSE for i in after)
        out.append((ROLES[t - 1], action, [ROLES[i - 1] for i in inserted], [ROLES[i - 1] for i in after], shown))
        before = t
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of each run of rows with equal first ``keys`` columns."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        n = batch.num_rows
        i = 0
        while i < n:
            key = [c[i] for c in columns[:keys]]
            j = i + 1
            while j < n and all(columns[k][j] == key[k] for k in range(keys)):
                j += 1
            part = [c[i:j] for c in columns]
            if held is not None and [c[0] for c in held[:keys]] == key:
                held = [a + b for a, b in zip(held, part)]
            else:
                if held is not None:
                    yield held
                held = part
            i = j
    if held is not None:
        yield held


def _stretches(turns: DataFrame, stretch: int) -> DataFrame:
    """Rows (conv_id, _s, _k, turn, role, text): _s numbers stretches in the order of the rows, _k the rows of a partition."""
    order = ["conv_id", "turn", "role", "text"]
    # equal rows would all fall into one range: a number that means nothing deals them out
    rows = turns.select(*order).withColumn("_deal", F.rand(7))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order, "_deal").sortWithinPartitions(*order, "_deal")
    schema = T.StructType([T.StructField("_s", T.LongType()), T.StructField("_k", T.LongType()), *(turns.schema[c] for c in order)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done, s, held, last = TaskContext.get().partitionId() << 33, 0, -1, 0, object()
        for batch in batches:
            number = []
            for conv in batch.column(0).to_pylist():
                if conv != last or held == stretch:
                    last, held, s = conv, 0, s + 1
                held += 1
                number.append(base + s)
            place = np.arange(done, done + batch.num_rows, dtype=np.int64)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(place), *batch.columns], names=schema.names)

    return B.cut(rows.select(*order).transform(B.arrow, run, schema))


def _borders(rows: DataFrame, long: DataFrame) -> DataFrame:
    """(_s, _entry, _leave, _last) of the stretches of the conversations ``long``: costs before each, the state it ends in, whether it is the last."""
    kind = rows.schema["conv_id"].dataType
    of = T.StructField("conv_id", kind)
    number, costs = T.StructField("_s", T.LongType()), T.ArrayType(T.DoubleType())
    arrow = [("conv_id", _arrow(kind)), ("_s", pa.int64())]
    many = rows.select("conv_id", "_s", "_k", "role").join(long.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    many = many.repartition("_s").sortWithinPartitions("_s", "_k").select("conv_id", "_s", "role")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([*arrow, ("_m", pa.list_(pa.float64()))])
        for conv, s, role in _groups(batches, 2):
            yield pa.RecordBatch.from_pylist([{"conv_id": conv[0], "_s": s[0], "_m": stretch_matrix(role).ravel().tolist()}], out)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, cost = pa.schema([*arrow, ("_m", pa.list_(pa.float64())), ("_entry", pa.list_(pa.float64()))]), object(), only(START)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["conv_id"] != last:
                    last, cost = r["conv_id"], only(START)
                found.append(r | {"_entry": cost.tolist()})
                cost = (cost[:, None] + np.array(r["_m"]).reshape(4, 4)).min(axis=0)
            yield pa.RecordBatch.from_pylist(found, out)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([*arrow, ("_entry", pa.list_(pa.float64())), ("_back", pa.list_(pa.int32())), ("_end", pa.int32())])
        for conv, s, role, entry in _groups(batches, 2):
            steps, cost = [_step(r) for r in role], np.array(entry[0])
            whole = cost.copy()
            for m in steps:
                whole = (whole[:, None] + m).min(axis=0)
            back = [best_path(steps, cost, only(t))[0] for t in range(4)]
            yield pa.RecordBatch.from_pylist([{"conv_id": conv[0], "_s": s[0], "_entry": entry[0], "_back": back, "_end": int((whole + END).argmin())}], out)

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, leave = pa.schema([("_s", pa.int64()), ("_entry", pa.list_(pa.float64())), ("_leave", pa.int32()), ("_last", pa.bool_())]), object(), 0
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                end = r["conv_id"] != last
                last, leave = r["conv_id"], r["_end"] if end else leave
                found.append({"_s": r["_s"], "_entry": r["_entry"], "_leave": leave, "_last": end})
                leave = r["_back"][leave]
            yield pa.RecordBatch.from_pylist(found, out)

    m = many.transform(B.arrow, matrices, T.StructType([of, number, T.StructField("_m", costs)]))
    m = m.repartition("conv_id").sortWithinPartitions("conv_id", "_s")
    entries = m.transform(B.arrow, forward, T.StructType([of, number, T.StructField("_m", costs), T.StructField("_entry", costs)]))
    again = rows.select("conv_id", "_s", "_k", "role").join(entries.select("_s", "_entry"), "_s")
    again = again.repartition("_s").sortWithinPartitions("_s", "_k").select("conv_id", "_s", "role", "_entry")
    ints = T.ArrayType(T.IntegerType())
    found = again.transform(B.arrow, exits, T.StructType([of, number, T.StructField("_entry", costs), T.StructField("_back", ints), T.StructField("_end", T.IntegerType())]))
    found = found.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("_s"))
    return found.transform(
        B.arrow, backward, T.StructType([number, T.StructField("_entry", costs), T.StructField("_leave", T.IntegerType()), T.StructField("_last", T.BooleanType())])
    )


def format_chats(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Rows of ``turns`` (conv_id, turn, role, text), each with its repaired role, action, insertions and rendering.

    Turns are ordered by turn, then role, then text; a null turn comes first,
    a negative one before zero, a null or unknown role must be relabelled, a
    null text is empty.  Rows without a conv_id are one conversation.  Repeated
    rows are turns like any others.  ``stretch`` is how many rows are repaired
    at once; the result doesn't depend on it.  An empty table gives an empty
    table; other columns are neither read nor returned.
    """
    rows = _stretches(turns, stretch)
    kind, kind_turn = turns.schema["conv_id"].dataType, turns.schema["turn"].dataType
    edges = rows.groupBy("conv_id").agg(F.min("_s").alias("a"), F.max("_s").alias("b"))
    long = B.cut(edges.where("a <> b").select("conv_id"))
    plan = rows.withColumns({"_entry": F.lit(None).cast("array<double>"), "_leave": F.lit(None).cast("int"), "_last": F.lit(True)})
    if not long.isEmpty():
        plan = rows.join(_borders(rows, long), "_s", "left").withColumn("_last", F.coalesce("_last", F.lit(True)))

    schema = T.StructType([
        T.StructField("conv_id", kind), T.StructField("turn", kind_turn), T.StructField("role", T.StringType()),
        T.StructField("new_role", T.StringType()), T.StructField("action", T.StringType()),
        T.StructField("inserted_before", T.ArrayType(T.StringType())), T.StructField("inserted_after", T.ArrayType(T.StringType())),
        T.StructField("rendered", T.StringType()),
    ])
    arrow = pa.schema([
        ("conv_id", _arrow(kind)), ("turn", _arrow(kind_turn)), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()),
        ("inserted_before", pa.list_(pa.string())), ("inserted_after", pa.list_(pa.string())), ("rendered", pa.string()),
    ])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in arrow]
        for conv, _, turn, role, text, entry, leave, last in _groups(batches, 2):
            for k, found in enumerate(repair(role, text, None if entry[0] is None else np.array(entry[0]), leave[0], last[0])):
                for c, x in zip(held, (conv[k], turn[k], role[k], *found)):
                    c.append(x)
            if len(held[0]) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, arrow.types)], schema=arrow)
                held = [[] for _ in arrow]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, arrow.types)], schema=arrow)

    plan = plan.repartition("_s").sortWithinPartitions("_s", "_k")
    return plan.select("conv_id", "_s", "turn", "role", "text", "_entry", "_leave", "_last").transform(B.arrow, render, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
