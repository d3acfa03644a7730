"""Natural cubic splines over many tables of any length.

The second derivatives of one table solve a tridiagonal system.  It is cut into
blocks of rows: inside a block the unknowns are expressed through the two rows
that bound it, which leaves a system over the bounding rows, shorter by the block length, that is cut up
in turn until a table's rest fits in one block.  On the way back each level fills in its blocks.  The answer is that of
the undivided system, while no row, task or group holds more than one block, however long a table is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.operators.keys import lookup_join
from halocline.operators.ordering import as_of, neighbours, running_totals
from halocline.storage import materialise

BLOCK = 2048
DOUBLES = T.ArrayType(T.DoubleType())


def _tridiagonal(lower, diag, upper, rhs) -> np.ndarray:
    """Solve many systems at once: (systems, n) bands and (systems, n, k) right-hand sides."""
    n = diag.shape[1]
    d, r = diag.astype(float).copy(), rhs.astype(float).copy()
    for k in range(1, n):
        w = lower[:, k] / d[:, k - 1]
        d[:, k] -= w * upper[:, k - 1]
        r[:, k] -= w[:, None] * r[:, k - 1]
    r[:, n - 1] /= d[:, n - 1, None]
    for k in range(n - 2, -1, -1):
        r[:, k] = (r[:, k] - upper[:, k, None] * r[:, k + 1]) / d[:, k, None]
    return r


def _by_length(arrays: pd.Series):
    """Positions of rows grouped by array length, so that each group stacks into a matrix."""
    lengths = arrays.map(len).to_numpy()
    for n in np.unique(lengths):
        yield n, np.flatnonzero(lengths == n)


def _stack(arrays: pd.Series, rows: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=float) for a in arrays.iloc[rows]])


def _inner_solution(bands: np.ndarray) -> np.ndarray:
    """Interior unknowns of equally long blocks as p + q*first + w*last (last axis).

    ``bands`` has (block, row, band): the factors of the row before, the row itself and the row after, and the right-hand side.
    """
    inner = bands[:, 1:-1]
    rhs = np.zeros((*inner.shape[:2], 3))
    rhs[:, :, 0] = inner[:, :, 3]
    rhs[:, 0, 1] = -inner[:, 0, 0]
    rhs[:, -1, 2] -= inner[:, -1, 2]
    return _tridiagonal(inner[:, :, 0], inner[:, :, 1], inner[:, :, 2], rhs)


def _stacked(bands: Sequence[pd.Series], rows: np.ndarray) -> np.ndarray:
    return np.stack([_stack(b, rows) for b in bands], axis=2)


@F.pandas_udf(DOUBLES)
def _reduce_blocks(lower: pd.Series, diag: pd.Series, upper: pd.Series, rhs: pd.Series) -> pd.Series:
    """What a block adds to the rows that bound it: four bands for its first row, then four for its last.

    A bounding row keeps its factors of unknowns that bound blocks; the interior neighbour is written through these.  Its own diagonal and
    right-hand side come from the block that it opens (and from the last block for the end of a table, by the caller).
    """
    out = np.empty(len(lower), dtype=object)
    for n, rows in _by_length(lower):
        b = _stacked((lower, diag, upper, rhs), rows)
        first, last = b[:, 0], b[:, -1]
        if n > 2:
            inner = _inner_solution(b)
            after, before = inner[:, 0], inner[:, -1]
        else:  # the bounding rows touch: each is the other's neighbour
            after, before = np.tile([0.0, 0.0, 1.0], (len(rows), 1)), np.tile([0.0, 1.0, 0.0], (len(rows), 1))
        zero, up, low = np.zeros(len(rows)), first[:, 2], last[:, 0]
        table = np.column_stack([
            zero, first[:, 1] + up * after[:, 1], up * after[:, 2], first[:, 3] - up * after[:, 0],
            low * before[:, 1], low * before[:, 2], zero, -low * before[:, 0],
        ])
        for i, row in zip(rows, table):
            out[i] = row
    return pd.Series(out)


@F.pandas_udf(DOUBLES)
def _solve_whole(lower: pd.Series, diag: pd.Series, upper: pd.Series, rhs: pd.Series) -> pd.Series:
    """Unknowns of tables that are one block."""
    out = np.empty(len(lower), dtype=object)
    for _, rows in _by_length(lower):
        b = _stacked((lower, diag, upper, rhs), rows)
        for i, row in zip(rows, _tridiagonal(b[:, :, 0], b[:, :, 1], b[:, :, 2], b[:, :, 3:])[:, :, 0]):
            out[i] = row
    return pd.Series(out)


@F.pandas_udf(DOUBLES)
def _fill_blocks(lower: pd.Series, diag: pd.Series, upper: pd.Series, rhs: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    """Unknowns of whole blocks from those of the rows that bound them."""
    out = np.empty(len(lower), dtype=object)
    for n, rows in _by_length(lower):
        ends = np.column_stack([left.to_numpy()[rows], right.to_numpy()[rows]])
        m = np.empty((len(rows), n))
        m[:, 0], m[:, -1] = ends[:, 0], ends[:, 1]
        if n > 2:
            inner = _inner_solution(_stacked((lower, diag, upper, rhs), rows))
            m[:, 1:-1] = inner[:, :, 0] + inner[:, :, 1] * ends[:, :1] + inner[:, :, 2] * ends[:, 1:]
        for i, row in zip(rows, m):
            out[i] = row
    return pd.Series(out)


BANDS = ("__lower", "__diag", "__upper", "__rhs")
ROW, END = "__i", "__end"  # number of a row in its table, from 0; whether it is the last


def _arrays(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per block, with its row numbers and bands as arrays; a block has a bounded number of rows."""
    blocks = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(ROW, *BANDS))).alias("__k"), F.max(END).alias(END))
    return blocks.select(*by, END, *[F.col(f"__k.{c}").alias(c) for c in (ROW, *BANDS)])


def solve_tridiagonal(rows: DataFrame, g: Sequence[str], *, longest: int, block: int = BLOCK) -> DataFrame:
    """(groups, row number, ``__m``): the unknowns of one tridiagonal system per group.

    ``rows`` has the number, the end mark and the bands of each row; the first and the last row of a table name their unknowns
    by themselves (no neighbours).  ``longest`` is the number of rows of the longest table, which decides the number of levels.
    """
    if longest <= block + 1:
        whole = _arrays(rows, g)
        solved = whole.select(*g, F.explode(F.arrays_zip(F.col(ROW), _solve_whole(*BANDS).alias("__m"))).alias("__z"))
        return solved.select(*g, F.col(f"__z.{ROW}").alias(ROW), F.col("__z.__m").alias("__m"))
    # a bounding row, with a multiple of the block length as number, closes one block and opens the next
    at = F.floor(F.col(ROW) / block).cast("bigint")
    bounds = (F.col(ROW) % block == 0) & (F.col(ROW) > 0)
    member = F.when(bounds & F.col(END), F.array(at - 1)).when(bounds, F.array(at - 1, at)).otherwise(F.array(at))
    blocks = materialise(_arrays(rows.withColumn("__block", F.explode(member)), [*g, "__block"]), "tridiagonal-blocks")

    # the system over the bounding rows: what the blocks on either side leave of them
    c = F.col("__c")
    part = lambda k, end, own: F.struct(
        (F.col("__block") + k).alias(ROW), end.alias(END), *[(c[4 * k + i] + own[i] if own else c[4 * k + i]).alias(n) for i, n in enumerate(BANDS)]
    )
    last = [F.when(F.col(END), F.element_at(n, -1)).otherwise(0.0) if n in ("__diag", "__rhs") else F.lit(0.0) for n in BANDS]
    reduced = blocks.withColumn("__c", _reduce_blocks(*BANDS))
    halves = reduced.select(*g, F.inline(F.array(part(0, F.lit(False), None), part(1, F.col(END), last))))
    smaller = halves.groupBy(*g, ROW).agg(F.max(END).alias(END), *[F.sum(n).alias(n) for n in BANDS])
    solved = solve_tridiagonal(smaller, g, longest=-(-(longest - 1) // block) + 1, block=block)
    solved = materialise(solved, "tridiagonal-bounds")

    left = solved.select(*g, F.col(ROW).alias("__block"), F.col("__m").alias("__left"))
    right = solved.select(*g, (F.col(ROW) - 1).alias("__block"), F.col("__m").alias("__right"))
    filled = lookup_join(lookup_join(blocks, left, [*g, "__block"]), right, [*g, "__block"])
    filled = filled.withColumn("__m", _fill_blocks(*BANDS, "__left", "__right"))
    each = filled.select(*g, "__block", END, F.size("__m").alias("__n"), F.posexplode(F.arrays_zip(ROW, "__m")).alias("__pos", "__z"))
    # the closing row of a block is reported by the block it opens
    each = each.filter((F.col("__pos") < F.col("__n") - 1) | F.col(END))
    return each.select(*g, F.col(f"__z.{ROW}").alias(ROW), F.col("__z.__m").alias("__m"))


def spline_coefficients(
    knots: DataFrame,
    *,
    x: str = "x",
    y: str = "y",
    group_cols: Sequence[str] = ("table_id",),
    block: int = BLOCK,
    **exchange,
) -> DataFrame:
    """Second derivative ``y2`` of the natural cubic spline at every knot, numbered by ``knot``.

    Knots need distinct ``x`` within a table, and at least two of them.  Blocks are
    rows holding arrays of at most ``block`` + 1 knots, solved many at a time in
    numpy; grouping and carrying values between blocks is Spark's.
    """
    if block < 2:
        raise ValueError("a block needs two rows or more")
    g = list(group_cols)
    slim = knots.select(*g, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    numbered = running_totals(slim, ["__x"], {ROW: F.lit(1).cast("bigint")}, group_cols=g, **exchange)
    near = neighbours(numbered, ["__x"], ["__x", "__y"], group_cols=g, **exchange)
    p, n = F.col("prev"), F.col("next")
    here = F.concat_ws(", ", *[F.concat(F.lit(f"{c} = "), F.col(c).cast("string")) for c in g])
    alone = F.raise_error(F.concat(F.lit(f"a natural spline of {y} needs at least two points, of {x}; there is one where "), here))
    before, after = F.col("__x") - p["__x"], n["__x"] - F.col("__x")
    bend = ((n["__y"] - F.col("__y")) / after - (F.col("__y") - p["__y"]) / before) * 6.0
    inside = p.isNotNull() & n.isNotNull()
    rows = near.select(
        *g,
        (F.col(ROW) - 1).alias(ROW),
        F.when(p.isNull() & n.isNull(), alone.cast("boolean")).otherwise(n.isNull()).alias(END),
        F.when(inside, before).otherwise(0.0).alias("__lower"),
        F.when(inside, (before + after) * 2.0).otherwise(1.0).alias("__diag"),
        F.when(inside, after).otherwise(0.0).alias("__upper"),
        F.when(inside, bend).otherwise(0.0).alias("__rhs"),
        "__x",
        "__y",
    )
    rows = materialise(rows, "spline-rows")
    longest = (rows.agg(F.max(ROW)).first()[0] or 0) + 1
    solved = solve_tridiagonal(rows.drop("__x", "__y"), g, longest=longest, block=block)
    out = lookup_join(rows.select(*g, ROW, "__x", "__y"), solved, [*g, ROW])
    return out.select(*g, F.col(ROW).alias("knot"), F.col("__x").alias(x), F.col("__y").alias(y), F.col("__m").alias("y2"))


def _cubic(t: Column, at: Column) -> Column:
    h = t["x1"] - t["x0"]
    a, b = (t["x1"] - at) / h, (at - t["x0"]) / h
    return a * t["y0"] + b * t["y1"] + ((a * a * a - a) * t["m0"] + (b * b * b - b) * t["m1"]) * (h * h) / 6.0


def spline_lookup(
    points: DataFrame,
    knots: DataFrame,
    *,
    at: str,
    x: str = "x",
    y: str = "y",
    y2: str = "y2",
    out: str = "value",
    group_cols: Sequence[str] = ("table_id",),
    **exchange,
) -> DataFrame:
    """Evaluate tables with known second derivatives; the end cubics extrapolate."""
    g = list(group_cols)
    near = neighbours(knots.select(*g, x, y, y2), [x], [x, y, y2], group_cols=g, **exchange)
    n, p = F.col("next"), F.col("prev")
    opening = F.when(p.isNull(), F.lit(float("-inf"))).otherwise(F.col(x))
    intervals = near.filter(n.isNotNull()).select(
        *g,
        opening.alias("__start"),
        F.struct(
            F.col(x).alias("x0"), F.col(y).alias("y0"), F.col(y2).alias("m0"),
            n[x].alias("x1"), n[y].alias("y1"), n[y2].alias("m1"),
        ).alias("__cubic"),
    )
    hit = as_of(points, intervals, point_x=at, start="__start", group_cols=g, **exchange)
    return hit.withColumn(out, _cubic(F.col("__cubic"), F.col(at))).drop("__start", "__cubic")
