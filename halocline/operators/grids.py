"""Bilinear lookup on (R, z) lattices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.operators.keys import attach, lookup_join
from halocline.storage import materialise


def _axis(grid: DataFrame, axis: str, g: list[str], side: str) -> DataFrame:
    """(group, __v<side>): the distinct values of one axis in order.

    A group's nodes are all pairs of its axis values, so the array has about as many as the root of its nodes.
    """
    values = grid.groupBy(*g).agg(F.collect_set(F.col(axis).cast("double")).alias("__v"))
    return values.select(*g, F.array_sort("__v").alias(f"__v{side}"))


def _interval(values: Column, at: Column, most: int) -> Column:
    """Number of the interval of ``values`` that ``at`` is in, by bisection; the first and the last go on outside."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most.bit_length())))])
    # the largest k with values[k] <= at, among all but the last value
    descend = lambda low, step: F.when((low + step <= F.size(values) - 2) & (F.get(values, low + step) <= at), low + step).otherwise(low)
    return F.aggregate(steps, F.lit(0), descend)


def _node(values: Column, at: Column, most: int) -> Column:
    """Number of the axis value that a node has."""
    k = _interval(values, at, most)
    return F.when(F.get(values, k + 1) == at, k + 1).otherwise(k).cast("long")


def grid_lookup_bilinear(
    points: DataFrame,
    grid: DataFrame,
    *,
    values: Sequence[str] = ("psi", "f_r", "f_z"),
    point_cols: Sequence[str] = ("R", "z"),
    grid_cols: Sequence[str] = ("r", "z"),
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Bilinear ``values`` at each point; points outside extrapolate from the border cell.

    A group's nodes are all pairs of its axis values, which may be spaced unevenly; a lattice
    with missing or repeated nodes, or fewer than two values on an axis, is an error.  A group's two axes are
    arrays, about as long as the root of its nodes, that its points and nodes are joined to once; points find their
    interval on each by bisection, every node is sent to the up to four cells it bounds, and values need one equi-join on
    the cell.  Points of a group without a grid have nulls.
    """
    g = list(group_cols)
    axes = attach(_axis(grid, grid_cols[0], g, "x"), _axis(grid, grid_cols[1], g, "z"), g)
    axes = attach(axes, grid.groupBy(*g).agg(F.count(F.lit(1)).alias("__n")), g)
    axes = axes.withColumns({"__nx": F.size("__vx").cast("long"), "__nz": F.size("__vz").cast("long")})
    axes = materialise(axes, "grid-axes")
    most = axes.agg(F.max(F.greatest("__nx", "__nz"))).first()[0] or 1
    sides = list(zip(("x", "z"), grid_cols, point_cols))
    nodes = attach(grid, axes.select(*g, "__vx", "__vz"), g)
    nodes = nodes.withColumns({f"__{side}": _node(F.col(f"__v{side}"), F.col(axis).cast("double"), most) for side, axis, _ in sides}).drop("__vx", "__vz")
    placed = attach(points, axes.select(*g, "__vx", "__vz"), g, "left")
    placed = placed.withColumns({f"__k{side}": F.when(F.col(at).isNotNull(), _interval(F.col(f"__v{side}"), F.col(at), most)) for side, _, at in sides})
    for side, _, _ in sides:
        v, k = F.col(f"__v{side}"), F.col(f"__k{side}")
        placed = placed.withColumn(f"__cell{side}", F.struct(k.cast("long").alias("i"), F.get(v, k).alias("lo"), F.get(v, k + 1).alias("hi")))
    placed = placed.drop("__vx", "__vz", "__kx", "__kz")
    shape = axes.select(*g, "__n", "__nx", "__nz")
    nx, nz, n = F.col("__nx"), F.col("__nz"), F.col("__n")
    fault = F.raise_error(F.lit("the grid is not a full lattice of its axis values, two at least on each")).cast("bigint")
    nodes = attach(nodes, shape.select(*g, F.when((nx * nz == n) & (nx > 1) & (nz > 1), n).otherwise(fault).alias("__n")), g)
    corner = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    )
    spread = nodes.filter(F.col("__n") > 0).withColumn("__c", corner).withColumns(
        {"__ix": F.col("__x") - F.col("__c.a"), "__iz": F.col("__z") - F.col("__c.b")}
    )
    here = lambda a, b: (F.col("__c.a") == a) & (F.col("__c.b") == b)
    cells = spread.groupBy(*g, "__ix", "__iz").agg(
        *[
            F.max(F.when(here(a, b), F.col(v))).alias(f"__{v}{a}{b}")
            for v in values
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    cx, cz = F.col("__cellx"), F.col("__cellz")
    placed = placed.withColumns(
        {
            "__ix": cx["i"],
            "__iz": cz["i"],
            "__s": (F.col(point_cols[0]) - cx["lo"]) / (cx["hi"] - cx["lo"]),
            "__t": (F.col(point_cols[1]) - cz["lo"]) / (cz["hi"] - cz["lo"]),
        }
    )
    out = lookup_join(placed, cells, [*g, "__ix", "__iz"], "left")
    s, t = F.col("__s"), F.col("__t")
    at = lambda n, a, b: F.col(f"__{n}{a}{b}")
    blend = lambda n: (
        at(n, 0, 0) * (F.lit(1.0) - s) * (F.lit(1.0) - t)
        + at(n, 1, 0) * s * (F.lit(1.0) - t)
        + at(n, 0, 1) * (F.lit(1.0) - s) * t
        + at(n, 1, 1) * s * t
    )
    return out.select(*points.columns, *[blend(n).alias(n) for n in values])
