"""Ordered prefix operators that stay parallel inside one very large group.

A plain ``Window.partitionBy(book)`` puts a whole book in one task. Here the order column is cut into
slabs: windows run per (keys, slab), each slab is summarised to one row, and only those summaries are
scanned across slabs. With several slab levels the summaries are scanned the same way, so the number
of rows any task orders stays near the slab size however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textsync.session import stage

SLAB = 8192


@dataclass(frozen=True)
class Spec:
    kind: str  # sum | max | last | next
    value: Column
    inclusive: bool = False


def total_before(value: Column) -> Spec:
    return Spec("sum", value)


def total_through(value: Column) -> Spec:
    return Spec("sum", value, True)


def max_before(value: Column) -> Spec:
    return Spec("max", value)


def last_before(value: Column) -> Spec:
    """The nearest earlier non-null value."""
    return Spec("last", value)


def last_through(value: Column) -> Spec:
    return Spec("last", value, True)


def next_after(value: Column) -> Spec:
    """The nearest later non-null value."""
    return Spec("next", value)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry)


def _local(spec: Spec, window) -> Column:
    edge = 0 if spec.inclusive else 1
    if spec.kind == "next":
        frame = window.rowsBetween(edge, Window.unboundedFollowing)
        return F.first(spec.value, ignorenulls=True).over(frame)
    frame = window.rowsBetween(Window.unboundedPreceding, -edge)
    if spec.kind == "sum":
        return F.sum(spec.value).over(frame)
    if spec.kind == "max":
        return F.max(spec.value).over(frame)
    return F.last(spec.value, ignorenulls=True).over(frame)


def _summary(spec: Spec, order: Column) -> Column:
    if spec.kind == "sum":
        return F.sum(spec.value)
    if spec.kind == "max":
        return F.max(spec.value)
    ranked = F.when(spec.value.isNotNull(), order)
    return (F.min_by if spec.kind == "next" else F.max_by)(spec.value, ranked)


def scan(df: DataFrame, keys: list[str], order: list[str], slabs: list[Column], **specs: Spec) -> DataFrame:
    """Add one column per spec, evaluated in ``order`` inside each group of ``keys``.

    ``slabs`` lists slab expressions from fine to coarse; each must be non-decreasing in the order,
    and each coarse one a function of the finer. An empty list means one window per group.
    """
    if not slabs:
        window = Window.partitionBy(*keys).orderBy(*order)
        out = df
        for name, spec in specs.items():
            value = _local(spec, window)
            out = out.withColumn(name, F.coalesce(value, F.lit(0)) if spec.kind == "sum" else value)
        return out

    marks = [f"_slab{len(slabs)}{i}" for i in range(len(slabs))]
    df = reduce(lambda d, m: d.withColumn(m[0], m[1]), zip(marks, slabs), df)
    position = F.struct(*order)
    totals = df.groupBy(*keys, *marks).agg(
        *[_summary(spec, position).alias(f"_v{i}") for i, spec in enumerate(specs.values())]
    )
    carried = scan(
        totals,
        keys,
        [marks[0]],
        [F.col(m) for m in marks[1:]],
        **{f"_c{i}": Spec(s.kind, F.col(f"_v{i}")) for i, s in enumerate(specs.values())},
    ).select(*keys, marks[0], *[f"_c{i}" for i in range(len(specs))])

    window = Window.partitionBy(*keys, marks[0]).orderBy(*order)
    local = reduce(
        lambda d, e: d.withColumn(f"_l{e[0]}", _local(e[1], window)), enumerate(specs.values()), df
    )
    joined = local.join(carried, [*keys, marks[0]])
    result = [c for c in df.columns if c not in marks]
    combined = [
        _combine(spec.kind, F.col(f"_c{i}"), F.col(f"_l{i}")).alias(name)
        for i, (name, spec) in enumerate(specs.items())
    ]
    return joined.select(*result, *combined)


def slabs_of(order: Column, size: int = SLAB, levels: int = 1) -> list[Column]:
    """Slabs of a numeric order column, each level ``size`` times coarser than the one before."""
    return [F.floor(order / size ** (i + 1)).cast("bigint") for i in range(levels)]


def fold_slabs(rows: DataFrame, entries: DataFrame, keys: list[str], order: str, reads: list[str], step, writes: str,
               first: int = 0, repair=None, rounds: list[int] | None = None) -> DataFrame:
    """An ordered fold with one long of state, run on all slabs of all groups at once.

    ``rows`` carry ``slab``; ``entries`` hold (keys, slab, entry, …) with a guess of the state each slab starts from. For each
    row in order ``step(state, *reads)`` returns the next state and the values of ``writes``, given as ``name type, …``. The
    result has (keys, slab, entry, order, state, writes): what one pass over each group would give, started at ``first``.

    A slab is a map of entry states to exit states, known where it has been evaluated. A round composes the maps along each
    group as far as they are known (one short row an evaluation, streamed in order), and evaluates next what is
    missing, everywhere at once. Where a guess was wrong, the true state is evaluated on the slab and on the ``2 ** round``
    slabs after it as well. So a slab that ends in the same state wherever it started costs one round, and a state that passes
    unchanged through n slabs costs log2(n) of them, not n. Other slabs are settled one a round.

    With ``repair`` a step writes ``redo``, true for rows it lacked data for; ``repair(rows to redo)`` returns replacements, as
    rows with the ``entry`` they are for, and these slabs are evaluated again from there. ``rounds`` collects how many
    evaluations each round began.
    """
    on = [*keys, "slab"]
    with_entry = [*on, "entry"]
    rows = stage(rows)
    slabs = scan(entries, keys, ["slab"], slabs_of(F.col("slab")), number=total_before(F.lit(1).cast("bigint")))
    slabs = stage(slabs)
    extra = [c for c in entries.columns if c not in with_entry]
    kinds = {f.name: f.dataType for f in [*rows.schema, *slabs.schema]}
    head = T.StructType([T.StructField(c, kinds[c]) for c in [*with_entry, order]] + [T.StructField("state", T.LongType())])
    schema = T.StructType([*head, *(T.StructType.fromDDL(writes) if writes else [])])
    fixed = None

    def run(due: DataFrame, turn: int) -> DataFrame:
        found = rows.join(due, on)
        if fixed is not None:
            mine = fixed.join(due, with_entry)
            found = found.join(mine.select(*with_entry, order), [*with_entry, order], "left_anti").unionByName(mine.select(found.columns))
        found = found.join(slabs.select(*on, *extra), on).select(*dict.fromkeys([*with_entry, order, *reads]))
        dealt = found.repartition(*with_entry).sortWithinPartitions(*with_entry, order)
        return stage(dealt.mapInArrow(_walk(with_entry, order, reads, step, schema), schema).withColumn("_turn", F.lit(turn)))

    def summary(part: DataFrame) -> DataFrame:
        redo = F.max("redo") if repair else F.lit(False)
        return stage(part.groupBy(*with_entry, "_turn").agg(F.max_by("state", order).alias("exit"), redo.alias("redo")))

    done = run(slabs.select(*with_entry), 0)
    known = summary(done)
    turn = 0
    while True:
        turn += 1
        latest = known.groupBy(*with_entry).agg(F.max("_turn").alias("_turn"), F.max_by("exit", "_turn").alias("exit"), F.max_by("redo", "_turn").alias("redo"))
        placed = latest.join(slabs.select(*on, "number", F.col("entry").alias("guess")), on).select(*keys, "number", "slab", "entry", "exit", "redo", "guess", "_turn")
        dealt = placed.repartition(*keys).sortWithinPartitions(*keys, "number")
        told = T.StructType([*[T.StructField(c, kinds[c]) for c in keys], T.StructField("number", T.LongType()), T.StructField("entry", T.LongType()), T.StructField("_turn", T.IntegerType()), T.StructField("wanted", T.IntegerType())])
        composed = stage(dealt.mapInArrow(_compose(keys, first, 2**turn, told), told))
        wanted = composed.where("wanted > 0").join(slabs.select(*on, "number"), [*keys, "number"]).select(*with_entry, "_turn", "wanted")
        wanted = stage(wanted)
        if rounds is not None:
            rounds.append(wanted.count())
        if wanted.isEmpty():
            path = composed.join(slabs.select(*on, "number"), [*keys, "number"]).select(*with_entry, "_turn")
            return done.join(path, [*with_entry, "_turn"]).select(schema.names)
        if repair:
            again = done.join(wanted.where("wanted = 2").select(*with_entry, "_turn"), [*with_entry, "_turn"], "left_semi").where("redo")
            again = stage(again.drop("_turn"))
            if not again.isEmpty():
                better = stage(repair(again))
                kept = None if fixed is None else fixed.join(better.select(*with_entry, order), [*with_entry, order], "left_anti")
                fixed = better if kept is None else stage(kept.unionByName(better))
        fresh = run(wanted.select(*with_entry), turn)
        done, known = done.unionByName(fresh), known.unionByName(summary(fresh))


def _cells(column: pa.Array) -> list:
    """The values of a column for a loop over rows; arrays stay numpy views."""
    if pa.types.is_list(column.type):
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(column.value_lengths().fill_null(0)))
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
    return column.to_pylist()


def _walk(with_entry: list[str], order: str, reads: list[str], step, schema: T.StructType):
    """Fold sorted rows; the state is all that is kept between two batches."""
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            starts = list(zip(*[column(c).to_pylist() for c in with_entry]))
            cells = list(zip(*[_cells(column(c)) for c in reads])) if reads else [()] * len(starts)
            out = []
            for start, row in zip(starts, cells):
                if start != last:
                    last, state = start, start[-1]
                state, *written = step(state, *row)
                out.append((state, *written))
            made = list(zip(*out)) if out else [()] * (len(schema) - len(with_entry) - 1)
            arrays = [column(c) for c in [*with_entry, order]] + [pa.array(values, field.type) for values, field in zip(made, list(kind)[len(with_entry) + 1 :])]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, kind)], schema=kind)

    return run


def _compose(keys: list[str], first: int, gallop: int, schema: T.StructType):
    """Follow each group's states through its slabs, given as one row an evaluation in the order of slabs.

    Rows out: 0, the evaluation that the path takes (or, where the true one is missing, that of the guess), 1, a state to
    evaluate, 2, an evaluation to repair."""
    kind = to_arrow_schema(schema)

    def settle(place: tuple, evaluated: dict, guess: int, state: int, ahead: dict[int, int], out: list) -> int:
        number = place[-1]
        wanted = {}
        if state in evaluated:
            out.append((*place, state, evaluated[state][2], 0))
            left = evaluated[state][0]
        else:
            wanted[state] = 1
            out.append((*place, guess, evaluated[guess][2], 0))
            left = evaluated[guess][0]
        if wanted or evaluated[state][1]:
            ahead[state] = max(ahead.get(state, 0), number + gallop)
        for value in [v for v, until in ahead.items() if until < number]:
            del ahead[value]
        for value in ahead:
            if value not in evaluated:
                wanted[value] = 1
            elif evaluated[value][1]:
                wanted[value] = 2
        out.extend((*place, value, evaluated[value][2] if value in evaluated else None, why) for value, why in wanted.items())
        return left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, evaluated, guess, state, ahead = None, {}, None, first, {}
        for batch in batches:
            out = []
            for *own, _, entry, left, redo, supposed, turn in zip(*[c.to_pylist() for c in batch.columns]):
                own = tuple(own)
                if own != place:
                    if place is not None:
                        state = settle(place, evaluated, guess, state, ahead, out)
                        if own[:-1] != place[:-1]:
                            state, ahead = first, {}
                    place, evaluated, guess = own, {}, supposed
                evaluated[entry] = (left, redo, turn)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(kind), kind)], schema=kind)
        if place is not None:
            out = []
            settle(place, evaluated, guess, state, ahead, out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return run
