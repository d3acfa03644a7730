"""Ranks, running totals and neighbours without sorting a group in one task.

A window over a whole component would pull a third of the table into a single
task.  Here the rows are exchanged by range of the *composite* order key, group first
and the row's place in its source last, so even many equal radii, and equal rows,
are parted.  A task runs over its sorted partition once, batch by batch, and stores the
outcome with each row's place.  Only the first group of a partition can have begun
before it, so what crosses the cuts is one row per partition: :func:`_carried` adds
it up, and it is joined back by partition number.

The input is read twice, by Spark's sample for the cuts and by the exchange; the plan is
the same at every size, and no key or cut comes to the driver's Python.  Group columns must not be null
here; a null is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.operators.keys import BROADCAST_ROWS, lookup_join
from halocline.storage import materialise

AT = "__at"  # place of a row: its partition, then its number there
PART = "__part"
ROW_BITS = 33  # fixed value: the low bits of Spark's increasing ids number the rows of a partition
SOURCE = "__source"
PARTS_PER_BLOCK = 1024

Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_order(
    df: DataFrame,
    order_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    *,
    partitions: int | None = None,
    scan: Scan | None = None,
    schema: T.StructType | None = None,
    name: str = "ordered",
) -> DataFrame:
    """``df`` stored in the order of (groups, ``order_cols``), with each row's place in :data:`AT`.

    Places ascend with the order over all rows; rows that are equal in it keep the order of the source.
    ``scan`` may add columns (then ``schema`` has them) while it passes over each sorted partition.
    """
    fault = F.raise_error(F.lit("null in a group column"))
    groups = {c: F.coalesce(F.col(c), fault.cast(df.schema[c].dataType)) for c in group_cols}
    keys = [*group_cols, *order_cols, SOURCE]
    rows = df.withColumns(groups | {SOURCE: F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    rows = rows.withColumn(AT, F.monotonically_increasing_id()).drop(SOURCE)
    if scan is not None:
        rows = rows.mapInArrow(scan, schema)
    return materialise(rows, name)


def part_of(at: str = AT) -> Column:
    return F.shiftright(F.col(at), ROW_BITS).cast("int")


def ranked(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (), *, rank: str, partitions: int | None = None) -> DataFrame:
    """Add each row's number, from 0, in ``order_cols`` order within its group; nothing leaves the JVM."""
    stored = in_order(df, order_cols, group_cols, partitions=partitions)
    before = starts_of_parts(stored)
    within = F.col(AT).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    rows = _with_parts(stored, before.select(PART, "__before"), partitions)
    rows = rows.withColumn(rank, F.col("__before") + within)
    if group_cols:
        starts = rows.groupBy(*group_cols).agg(F.min(rank).alias("__start"))
        rows = lookup_join(rows, starts, list(group_cols), null_safe=False)
        rows = rows.withColumn(rank, F.col(rank) - F.col("__start"))
    return rows.select(*[c for c in df.columns if c != rank], rank)


def starts_of_parts(stored: DataFrame) -> DataFrame:
    """(:data:`PART`, ``__n``, ``__before``): rows of each partition and of all before it."""
    counts = stored.groupBy(part_of().alias(PART)).agg(F.count(F.lit(1)).alias("__n"))
    return prefix_sums(counts, {"__before": F.col("__n")})


def prefix_sums(parts: DataFrame, sums: Mapping[str, Column], by: str = PART) -> DataFrame:
    """Add sums over all smaller ``by``, in two levels: inside blocks of partitions, and over the blocks."""
    blocks = parts.withColumn("__block", F.floor(F.col(by) / PARTS_PER_BLOCK))
    totals = blocks.groupBy("__block").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    over = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__block", *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy("__block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = out.join(totals, "__block").withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums})
    return out.drop("__block", *[f"__b_{n}" for n in sums])


def _with_parts(stored: DataFrame, per_part: DataFrame, partitions: int | None, how: str = "inner") -> DataFrame:
    """Rows with what is known of their partition: as many rows as the exchange had partitions, at most."""
    most = partitions or int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_part = per_part.withColumnRenamed(PART, "__p")
    right = F.broadcast(per_part) if most <= BROADCAST_ROWS else per_part
    return stored.join(right, part_of() == F.col("__p"), how).drop("__p")


def _group(group_cols: Sequence[str]) -> Column:
    return F.struct(*(group_cols or [F.lit(0).alias("one")]))


def _carried(stored: DataFrame, group_cols: Sequence[str], tails: Mapping[str, Column], across: Callable[[str], Column]) -> DataFrame:
    """(:data:`PART`, ``__of``, names of ``tails``): what the partitions before leave to the first group of each.

    A tail is a row's state when its group ends with it; ``across`` joins the states of a group's partitions as a window
    function.  Groups stand in order, so a group that goes on is the last one of the partition before.
    """
    whole = _group(group_cols)
    parts = stored.groupBy(part_of().alias(PART)).agg(
        F.min_by(whole, AT).alias("__first"), F.max_by(whole, AT).alias("__last"), *[F.max_by(c, AT).alias(n) for n, c in tails.items()]
    )
    # the windows see one row for each partition, fewer than the driver keeps of the tasks themselves
    upto = Window.partitionBy("__last").orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.select(PART, "__first", "__last", *[across(n).over(upto).alias(n) for n in tails])
    w = Window.orderBy(PART)
    ends = ends.select(PART, F.col("__first").alias("__of"), *[F.lag(c).over(w).alias(c) for c in ("__last", *tails)])
    return ends.filter(F.col("__last").eqNullSafe(F.col("__of"))).drop("__last")


def _changes(batch: pa.RecordBatch, group_cols: Sequence[str], last: list | None) -> np.ndarray:
    """True where a row's group is another than that of the row before; ``last`` is the row before the batch."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[0] = last is None
    for i, c in enumerate(group_cols):
        values = batch.column(c)
        if pa.types.is_floating(values.type):  # NaN is one group, and so are the zeros
            v = values.to_numpy(zero_copy_only=False)
            new[1:] |= (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
            if last is not None:
                new[0] |= v[0] != last[i] and not (np.isnan(v[0]) and np.isnan(last[i]))
        else:
            new[1:] |= pc.not_equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if last is not None:
                new[0] |= values[0].as_py() != last[i]
    return new


def _last_group(batch: pa.RecordBatch, group_cols: Sequence[str]) -> list:
    return [batch.column(c)[-1].as_py() for c in group_cols]


def _with_columns(df: DataFrame, extra: Mapping[str, T.DataType]) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in extra]
    return T.StructType([*kept, T.StructField(AT, T.LongType()), *[T.StructField(n, t) for n, t in extra.items()]])


def _append(batch: pa.RecordBatch, names: Sequence[str], extra: Mapping[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *extra.values()], names=[*names, *extra])


def _cumulated(inputs: Mapping[str, str], kinds: Mapping[str, T.DataType], group_cols: Sequence[str], kept: Sequence[str]) -> Scan:
    """Running sums inside the runs of equal groups of a partition; null adds nothing."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, dict.fromkeys(inputs, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _changes(batch, group_cols, last)
            runs = np.cumsum(new) - new[0]
            extra = {}
            for n, source in inputs.items():
                whole = isinstance(kinds[n], T.LongType)
                v = pc.fill_null(batch.column(source).cast(pa.int64() if whole else pa.float64()), 0).to_numpy(zero_copy_only=False)
                v = pd.Series(v).groupby(runs, sort=False).cumsum().to_numpy()
                if not new[0]:
                    v = np.where(runs == 0, v + sums[n], v)
                sums[n] = v[-1]
                extra[n] = pa.array(v)
            last = _last_group(batch, group_cols)
            yield _append(batch, kept, extra)

    return scan


def running_totals(
    df: DataFrame,
    order_cols: Sequence[str],
    totals: Mapping[str, Column],
    *,
    group_cols: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add running sums of ``totals`` in ``order_cols`` order within each group: long for whole numbers, else double.

    ``order_cols`` must identify a row within its group for a repeatable result.  A null adds nothing.
    """
    inputs = {n: f"__in_{n}" for n in totals}
    kept = [c for c in df.columns if c not in totals]
    rows = df.select(*kept, *[c.alias(inputs[n]) for n, c in totals.items()])
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    kinds = {n: T.LongType() if isinstance(rows.schema[i].dataType, whole) else T.DoubleType() for n, i in inputs.items()}
    rows = rows.withColumns({i: F.col(i).cast(kinds[n]) for n, i in inputs.items()})
    scan = _cumulated(inputs, kinds, group_cols, [*kept, AT])
    stored = in_order(rows, order_cols, group_cols, partitions=partitions, scan=scan, schema=_with_columns(df.select(*kept), kinds))
    carry = _carried(stored, group_cols, {f"__{n}": F.col(n) for n in totals}, F.sum)
    out = _with_parts(stored, carry, partitions, "left")
    mine = _group(group_cols).eqNullSafe(F.col("__of"))
    return out.select(*kept, *[(F.col(n) + F.when(mine, F.col(f"__{n}")).otherwise(0)).alias(n) for n in totals])


RANK = "__rank"


def _locally_first(group_cols: Sequence[str], kept: Sequence[str]) -> Scan:
    """Rows of a sorted partition that are among the first ``__limit`` of their group there."""
    count = _cumulated({RANK: "__one"}, {RANK: T.LongType()}, group_cols, kept)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in count(batches):
            yield batch.filter(pc.less_equal(batch.column(RANK), batch.column("__limit"))).select(kept)

    return scan


def first_in_order(
    df: DataFrame,
    order_cols: Sequence[str],
    limit: Column,
    *,
    group_cols: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """The first ``limit`` rows of each group.

    ``limit`` is a column over the group columns.  Each partition of the input first gives up the rows that aren't among the
    first of their group there, and only the others are exchanged and counted.
    """
    rows = df.withColumns({"__limit": limit.cast("long"), "__one": F.lit(1).cast("long")})
    kept = [*df.columns, "__limit"]
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__one"])
    local = rows.sortWithinPartitions(*group_cols, *order_cols).mapInArrow(_locally_first(group_cols, kept), schema)
    ranks = running_totals(materialise(local, "first"), order_cols, {RANK: F.lit(1)}, group_cols=group_cols, partitions=partitions)
    return ranks.filter(F.col(RANK) <= F.col("__limit")).select(*df.columns)


def _struct(batch: pa.RecordBatch, cols: Sequence[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([batch.column(c) for c in cols], names=list(cols))


def _taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    """Values at the positions ``at``, null where a position is negative."""
    return values.take(pa.array(np.maximum(at, 0), mask=at < 0))


def _beside(cols: Sequence[str], group_cols: Sequence[str], kept: Sequence[str]) -> Scan:
    """The rows before and after each row within its group and partition; a batch waits for the one after it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # held: a batch, its own values, those before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new, own = _changes(batch, group_cols, last), _struct(batch, cols)
            known = pa.concat_arrays([held[1].slice(held[0].num_rows - 1), own]) if held else own
            before = np.arange(n) - (held is None)
            if held:
                after = np.r_[np.arange(1, held[0].num_rows), held[0].num_rows if not new[0] else -1]
                after[:-1][held[3][1:]] = -1
                yield _append(held[0], kept, {"prev": held[2], "next": _taken(pa.concat_arrays([held[1], own.slice(0, 1)]), after)})
            before[new] = -1
            held, last = (batch, own, _taken(known, before), new), _last_group(batch, group_cols)
        if held:
            after = np.r_[np.arange(1, held[0].num_rows), -1]
            after[:-1][held[3][1:]] = -1
            yield _append(held[0], kept, {"prev": held[2], "next": _taken(held[1], after)})

    return scan


def neighbours(
    df: DataFrame,
    order_cols: Sequence[str],
    cols: Sequence[str],
    *,
    group_cols: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add structs ``prev`` and ``next`` with ``cols`` of the adjacent rows (null at the ends)."""
    own = F.struct(*cols)
    kind = df.select(own.alias("own")).schema["own"].dataType
    kept = [c for c in df.columns if c not in ("prev", "next")]
    scan = _beside(cols, group_cols, [*kept, AT])
    stored = in_order(df, order_cols, group_cols, partitions=partitions, scan=scan, schema=_with_columns(df, {"prev": kind, "next": kind}))
    whole, w = _group(group_cols), Window.orderBy(PART)
    parts = stored.groupBy(part_of().alias(PART)).agg(
        F.min_by(whole, AT).alias("__first"), F.max_by(whole, AT).alias("__last"), F.max(AT).alias("__end"),
        F.min_by(own, AT).alias("__head"), F.max_by(own, AT).alias("__tail"),
    )
    parts = parts.select(
        PART,
        "__end",
        F.when(F.lag("__last").over(w).eqNullSafe(F.col("__first")), F.lag("__tail").over(w)).alias("__before"),
        F.when(F.lead("__first").over(w).eqNullSafe(F.col("__last")), F.lead("__head").over(w)).alias("__after"),
    )
    out = _with_parts(stored, parts, partitions)
    begins = F.col(AT) == F.shiftleft(part_of().cast("long"), ROW_BITS)
    return out.select(
        *kept,
        F.when(begins, F.col("__before")).otherwise(F.col("prev")).alias("prev"),
        F.when(F.col(AT) == F.col("__end"), F.col("__after")).otherwise(F.col("next")).alias("next"),
    )


def _filled(value: str, group_cols: Sequence[str], kept: Sequence[str]) -> Scan:
    """The last value of a mark (``__kind`` 0) so far in each row's group and partition, as ``__seen``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new, values = _changes(batch, group_cols, last), batch.column(value)
            marks = batch.column("__kind").to_numpy(zero_copy_only=False) == 0
            at = np.arange(n)
            latest = np.maximum.accumulate(np.where(marks, at, -1))
            begun = np.maximum.accumulate(np.where(new, at, -1))
            # the first run may go on from the batch before, whose last value stands in front
            latest = np.where(latest >= np.maximum(begun, 0), latest + 1, np.where((begun < 0) & (carried is not None), 0, -1))
            front = carried if carried is not None else values.slice(0, 1)
            seen = _taken(pa.concat_arrays([front, values]), latest)
            carried, last = seen.slice(n - 1), _last_group(batch, group_cols)
            yield _append(batch, kept, {"__seen": seen})

    return scan


def as_of(
    points: DataFrame,
    intervals: DataFrame,
    *,
    point_x: str,
    start: str,
    group_cols: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Attach to each point the last interval of its group with ``start <= x``.

    Both tables are merged in order and the latest interval is carried
    forward, inside partitions and then across them, so the cost does not depend on
    how the starts are spread.  Adds the interval's columns; null before the
    first start.
    """
    carried = [c for c in intervals.columns if c not in group_cols]
    own = [c for c in points.columns if c not in group_cols]
    g = [F.col(c) for c in group_cols]
    rows = points.select(*g, F.col(point_x).alias("__x"), F.lit(1).alias("__kind"), F.struct(*own).alias("__point"))
    marks = intervals.select(*g, F.col(start).alias("__x"), F.lit(0).alias("__kind"), F.struct(*carried).alias("__interval"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    kept = [*group_cols, "__kind", "__point", AT]
    schema = _with_columns(both.select(*group_cols, "__kind", "__point"), {"__seen": both.schema["__interval"].dataType})
    scan = _filled("__interval", group_cols, kept)
    stored = in_order(both, ["__x", "__kind"], group_cols, partitions=partitions, scan=scan, schema=schema)
    carry = _carried(stored, group_cols, {"__left": F.col("__seen")}, lambda n: F.last(n, ignorenulls=True))
    out = _with_parts(stored.filter(F.col("__kind") == 1), carry, partitions, "left")
    hit = F.coalesce(F.col("__seen"), F.when(_group(group_cols).eqNullSafe(F.col("__of")), F.col("__left")))
    out = out.withColumn("__hit", hit)
    return out.select(
        *group_cols, *[F.col("__point")[c].alias(c) for c in own], *[F.col("__hit")[c].alias(c) for c in carried]
    )


def assign_ids(df: DataFrame, order_cols: Sequence[str], id_col: str = "id", **exchange) -> DataFrame:
    """Consecutive ids 1..N in ``order_cols`` order."""
    return ranked(df, order_cols, rank=id_col, **exchange).withColumn(id_col, F.col(id_col) + 1)


def limit_particles(
    df: DataFrame,
    n: int,
    *,
    source_cols: Sequence[str] = ("component",),
    order_cols: Sequence[str] = ("particle_id", "mass"),
    **exchange,
) -> DataFrame:
    """At most ``n`` rows of every source, first ones in ``order_cols`` order."""
    return first_in_order(df, order_cols, F.lit(n), group_cols=source_cols, **exchange)


# Multiplier, increment and modulus of the integer draw below.
DRAW_MULTIPLIER = 48271
DRAW_INCREMENT = 12345
DRAW_MODULUS = 2147483647


def integer_draw(id_col: Column, seed: int) -> Column:
    """Repeatable pseudo-random integer from (seed, id) in 64-bit arithmetic."""
    m = F.lit(DRAW_MODULUS).cast("bigint")
    first = F.pmod(F.pmod(id_col.cast("bigint"), m) * DRAW_MULTIPLIER + (abs(seed) * 7919 + DRAW_INCREMENT), m)
    return F.pmod(first * DRAW_MULTIPLIER + DRAW_INCREMENT, m)


def component_subsample(
    df: DataFrame,
    counts: Mapping[str, int],
    *,
    seed: int = 1,
    component_col: str = "component",
    id_cols: Sequence[str] = ("particle_id", "mass"),
    **exchange,
) -> DataFrame:
    """Exactly ``counts[c]`` rows (or all, if fewer) of each component; 0 or absent skips it."""
    wanted = {c: n for c, n in counts.items() if n > 0}
    if not wanted:
        return df.limit(0)
    draw = "__draw"
    rows = df.filter(F.col(component_col).isin(list(wanted))).withColumn(
        draw, integer_draw(F.col(id_cols[0]), seed)
    )
    quota = F.lit(0)
    for c, n in wanted.items():
        quota = F.when(F.col(component_col) == c, n).otherwise(quota)
    out = first_in_order(rows, [draw, *id_cols], quota, group_cols=[component_col], **exchange)
    return out.drop(draw)
