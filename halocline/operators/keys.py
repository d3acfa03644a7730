"""Joins against per-key tables that hold up when one key is very hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.storage import materialise

# A side is hinted for broadcast only when the caller can prove it has at most
# this many rows; otherwise Spark decides from measured sizes.
BROADCAST_ROWS = 10_000

HOT_SAMPLE = 0.001
# A key seen less often than this in the sample isn't taken for hot.
HOT_LEAST = 10


def hot_keys(df: DataFrame, on: Sequence[str], share: float = 0.01, fraction: float = HOT_SAMPLE) -> list[tuple]:
    """Keys that hold more than ``share`` of a sample of ``fraction`` of the rows: at most 1/share of them.

    Only decides which keys get salted, so a sample is enough; no result row
    depends on it.
    """
    sample = df.select(*on).sample(fraction, seed=11)
    least = max(sample.count() * share, HOT_LEAST)
    counts = sample.groupBy(*on).count().filter(F.col("count") > least)
    return [tuple(r[c] for c in on) for r in counts.collect()]


def _is_any(cols: Sequence[str], keys: Sequence[tuple]) -> Column:
    def one(key: tuple) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(cols, key)))

    return reduce(lambda a, b: a | b, (one(k) for k in keys))


def spread(df: DataFrame, *on: str) -> DataFrame:
    """``df`` dealt over all tasks of a shuffle, before each row becomes many: a small file is read by one task."""
    # a set number of tasks, as Spark would merge those of so few bytes
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    max_rows: int | None = None,
    salts: int = 64,
    hot: Sequence[tuple] = (),
    measure: bool = False,
    null_safe: bool = True,
    widened: bool = False,
) -> DataFrame:
    """Join a large table to one with unique keys ``on``; the same plan for any size of input.

    ``max_rows`` is a proven bound on ``right``: within :data:`BROADCAST_ROWS` it is
    broadcast.  Otherwise the join is a plain equi-join.  Adaptive execution measures
    both sides as they are shuffled: it broadcasts ``right`` if its true size allows, and
    otherwise splits the partitions that hold hot keys of ``left``.

    A caller may ask for more.  ``measure`` writes ``right`` out first, so that the choice rests
    on its true size before ``left`` is shuffled.  The rows of ``hot`` keys (:func:`hot_keys`
    finds them) spread over ``salts`` reducers and only their few ``right`` rows are repeated.

    ``widened`` says that ``right`` has many rows for each row of the table it is made from.  The planner
    takes such a table for as small as its source and would gather it on the driver to broadcast it, so it
    is shuffled and merged instead, whatever its size.

    Null keys match each other unless ``null_safe`` is off, which lets the join reuse
    a partitioning by the same columns.
    """
    renamed = {c: f"__r_{c}" for c in on}
    if max_rows is not None and max_rows <= BROADCAST_ROWS:
        right = F.broadcast(right)
        hot = ()
    elif widened:
        right = right.hint("merge")
    elif measure:
        right = materialise(right, "lookup")
    right = right.withColumnsRenamed(renamed)
    same = Column.eqNullSafe if null_safe else Column.__eq__
    cond = [same(F.col(c), F.col(renamed[c])) for c in on]
    if hot:
        spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
        left = left.withColumn("__salt", F.when(_is_any(list(on), hot), spread).otherwise(0))
        copies = F.when(
            _is_any(list(renamed.values()), hot), F.sequence(F.lit(0), F.lit(salts - 1))
        ).otherwise(F.array(F.lit(0)))
        right = right.withColumn("__r_salt", F.explode(copies))
        cond.append(F.col("__salt") == F.col("__r_salt"))
    out = left.join(right, reduce(lambda a, b: a & b, cond), how)
    return out.drop("__salt", "__r_salt", *renamed.values())


def attach(df: DataFrame, stats: DataFrame, group_cols: Sequence[str], how: str = "inner", **options) -> DataFrame:
    """Put one row of group statistics on every row of its group.

    Without group columns ``stats`` has exactly one row and is broadcast.  ``options`` are those
    of :func:`lookup_join`.
    """
    if group_cols:
        return lookup_join(df, stats, list(group_cols), how, **options)
    one = "__one"
    joined = lookup_join(
        df.withColumn(one, F.lit(0)), stats.withColumn(one, F.lit(0)), [one], how, max_rows=1
    )
    return joined.drop(one)
