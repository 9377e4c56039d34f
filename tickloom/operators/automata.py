"""Finite-state machines over series, in blocks.

An event maps every state to a state, so the events of a block compose to one small map. The maps of a series' blocks are combined in order, which gives the state every block starts in; the rows
of all blocks are then walked independently. A series of any length spreads over tasks, and only hot series pay for the first pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import join_back
from tickloom.operators.axis import BLOCK, HOT, Axis, split, unsplit


class Machine:
    """``next[state][event]`` by number, -1 where the event is not legal (the state stays); the last event stands for all unknown ones."""

    def __init__(self, transitions: Mapping[tuple[str, str], str], start: str):
        self.states = list(dict.fromkeys([start, *[s for s, _ in transitions], *transitions.values()]))
        self.events = list(dict.fromkeys(e for _, e in transitions))
        at, of = {s: i for i, s in enumerate(self.states)}, {e: i for i, e in enumerate(self.events)}
        self.next = [[-1] * (len(self.events) + 1) for _ in self.states]
        for (s, e), to in transitions.items():
            self.next[at[s]][of[e]] = at[to]

    def walk(self, events: list[int], state: int) -> list[int]:
        """States before each event, and after the last."""
        out, table = [state], self.next
        for e in events:
            to = table[state][e]
            state = state if to < 0 else to
            out.append(state)
        return out


def run_machine(df: DataFrame, axis: Axis, event: str, transitions: Mapping[tuple[str, str], str], start: str, *, before: str = "from_status", after: str = "to_status", legal: str = "legal") -> DataFrame:
    """``df`` with the state before and after each row's event, and whether the event was legal there; an illegal, unknown or NULL event keeps the state."""
    keys, machine = list(axis.keys), Machine(transitions, start)
    code = F.lit(len(machine.events))
    for i, e in enumerate(machine.events):
        code = F.when(F.col(event) == e, i).otherwise(code)
    rows = split(df.withColumn("__event", code.cast("int")), axis)
    place = W.partitionBy(*keys, BLOCK).orderBy(*axis.order)

    hot = rows.where(HOT).select(*keys, BLOCK, *axis.order, "__event").withColumn("__first", F.row_number().over(place) == 1).select(*keys, BLOCK, "__event", "__first")
    maps = T.StructType([hot.schema[c] for c in (*keys, BLOCK)] + [T.StructField("__map", T.ArrayType(T.IntegerType()))])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The map of each block, put out when its last row has come."""
        own, held = list(range(len(machine.states))), None

        def told() -> pa.RecordBatch:
            head, now = held
            return pa.RecordBatch.from_arrays([*head.columns, pa.array([now], pa.list_(pa.int32()))], [*head.schema.names, "__map"])

        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            events, starts = get("__event").to_numpy(), np.flatnonzero(get("__first").to_numpy(zero_copy_only=False))
            cuts = sorted({0, *starts.tolist(), batch.num_rows})
            begins = set(starts.tolist())
            for low, high in zip(cuts, cuts[1:]):
                if low in begins:
                    if held:
                        yield told()
                    held = batch.select([*keys, BLOCK]).slice(low, 1), own
                part = events[low:high].tolist()
                held = held[0], [machine.walk(part, s)[-1] for s in held[1]]
        if held:
            yield told()

    blocks = hot.mapInArrow(composed, maps).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(BLOCK, "__map"))).alias("__b"))  # a row for each block
    zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("done"))
    states = F.aggregate("__b", zero, lambda s, b: F.struct(F.element_at(b["__map"], s["s"] + 1).alias("s"), F.concat(s["done"], F.array(s["s"])).alias("done")), lambda s: s["done"])
    starts = blocks.select(*keys, F.explode(F.arrays_zip(F.transform("__b", lambda b: b[BLOCK]).alias(BLOCK), states.alias("__start"))).alias("z")).select(*keys, f"z.{BLOCK}", "z.__start")

    placed = join_back(rows, starts, [*keys, BLOCK], "left").withColumn("__start", F.coalesce("__start", F.lit(0))).withColumn("__first", F.row_number().over(place) == 1)
    out = T.StructType([*placed.drop("__event", "__start", "__first").schema.fields, T.StructField(before, T.StringType()), T.StructField(after, T.StringType()), T.StructField(legal, T.BooleanType())])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, names, table = 0, np.array(machine.states, object), np.array(machine.next)
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            events, begin = get("__event").to_numpy(), get("__start").to_numpy()
            firsts = np.flatnonzero(get("__first").to_numpy(zero_copy_only=False)).tolist()
            here, opened = [], set(firsts)
            for low, high in zip([0, *firsts], [*firsts, batch.num_rows]):
                if low < high:
                    path = machine.walk(events[low:high].tolist(), int(begin[low]) if low in opened else state)
                    state = path[-1]
                    here += path[:-1]
            here = np.array(here)
            to = table[here, events]
            kept = [c for c in batch.schema.names if c not in ("__event", "__start", "__first")]
            yield pa.RecordBatch.from_arrays([*[get(c) for c in kept], pa.array(names[here], pa.string()), pa.array(names[np.where(to < 0, here, to)], pa.string()), pa.array(to >= 0)], [*kept, before, after, legal])

    return unsplit(placed.mapInArrow(walked, out))
