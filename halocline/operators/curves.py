"""Tabulated curves: rotation curves, resampling, differences, quadrature, maxima."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halocline.operators.frames import POS
from halocline.operators.keys import attach, lookup_join
from halocline.operators.ordering import neighbours, running_totals


def particle_rotation_curve(
    df: DataFrame,
    *,
    G: float = 1.0,
    velocity_scale: float = 1.0,
    mass: str = "mass",
    pos: Sequence[str] = POS,
    id_cols: Sequence[str] = ("particle_id", "mass"),
    group_cols: Sequence[str] = ("component",),
    **exchange,
) -> DataFrame:
    """sqrt(G M(<=r)/r) at every particle, counting particles outward in each group.

    Null at r = 0.  The order is (r, ids), parted as described in
    :mod:`halocline.operators.ordering`.
    """
    r = F.sqrt(sum((F.col(c) * F.col(c) for c in pos[1:]), F.col(pos[0]) * F.col(pos[0])))
    slim = df.select(*dict.fromkeys([*group_cols, *id_cols, mass]), r.alias("r"))
    out = running_totals(slim, ["r", *id_cols], {"m_enc": F.col(mass)}, group_cols=group_cols, **exchange)
    v = F.sqrt(F.try_divide(F.col("m_enc") * G, F.col("r"))) * velocity_scale
    return out.withColumn("v", v)


def linear_resample(
    curve: DataFrame,
    *,
    start: float,
    stop: float,
    num: int,
    x: str = "r",
    y: str = "v",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Piecewise-linear curve on ``num`` equally spaced points, zero outside its range.

    A grid point needs only the last curve point below it and the first at or
    above it, so the curve is reduced to those two per grid cell (combined
    map-side) and the rest happens on ``num`` rows per group.
    """
    g = list(group_cols)
    dx = (stop - start) / (num - 1)
    knots = curve.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    # cell i holds [x_{i-1}, x_i); the two corrections undo rounding of the quotient
    c = F.floor((F.col(x) - start) / dx)
    c = c - F.when(F.col(x) < c * dx + start, 1).otherwise(0) + F.when(
        F.col(x) >= (c + 1) * dx + start, 1
    ).otherwise(0)
    cell = F.least(F.greatest(c + 1, F.lit(0)), F.lit(num)).cast("int")
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = knots.groupBy(*g, cell.alias("__cell")).agg(
        F.max(point).alias("__below"), F.min(point).alias("__above")
    )
    frame = ends.select(*g).distinct() if g else curve.sparkSession.range(1).select()
    frame = frame.select(*g, F.explode(F.sequence(F.lit(0), F.lit(num))).alias("__cell"))
    full = lookup_join(frame, ends, [*g, "__cell"], "left")
    w = Window.partitionBy(*(g or [F.lit(0)])).orderBy("__cell")
    below = F.last("__below", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("__above", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    at = F.col("__cell") * dx + start
    lo, hi = F.col("__lo"), F.col("__hi")
    # an abscissa equal to the first knot has nothing below it but is inside
    value = (
        F.when(lo.isNull() & (hi["x"] == F.col("x")), hi["y"])
        .when(lo.isNull() | hi.isNull(), 0.0)
        .otherwise(lo["y"] + (hi["y"] - lo["y"]) / (hi["x"] - lo["x"]) * (F.col("x") - lo["x"]))
    )
    return (
        full.select(*g, F.col("__cell").alias("i"), at.alias("x"), below.alias("__lo"), above.alias("__hi"))
        .filter(F.col("i") < num)
        .select(*g, "i", "x", value.alias("y"))
    )


def combined_rotation_curve(
    particles: DataFrame,
    *,
    halo: str = "halo",
    disk: str = "disk",
    stop: float = 100.0,
    num: int = 500,
    component_col: str = "component",
    group_cols: Sequence[str] = (),
    **curve_options,
) -> DataFrame:
    """Halo and disk curves on a common grid with their quadrature sum."""
    g = list(group_cols)
    both = particles.filter(F.col(component_col).isin(halo, disk))
    curve = particle_rotation_curve(both, group_cols=[*g, component_col], **curve_options)
    on_grid = linear_resample(curve, start=0.0, stop=stop, num=num, group_cols=[*g, component_col])
    pick = lambda name: F.coalesce(F.max(F.when(F.col(component_col) == name, F.col("y"))), F.lit(0.0))
    out = on_grid.groupBy(*g, "i", "x").agg(pick(halo).alias("v_halo"), pick(disk).alias("v_disk"))
    total = F.sqrt(F.col("v_halo") * F.col("v_halo") + F.col("v_disk") * F.col("v_disk"))
    return out.withColumnRenamed("x", "r").withColumn("v_total", total)


def finite_difference(
    curve: DataFrame, *, x: str, y: str, group_cols: Sequence[str] = (), **exchange
) -> DataFrame:
    """Central difference dy/dx at interior knots, null at the two ends."""
    near = neighbours(curve, [x], [x, y], group_cols=group_cols, **exchange)
    p, n = F.col("prev"), F.col("next")
    return near.withColumn("dydx", F.try_divide(n[y] - p[y], n[x] - p[x])).drop("prev", "next")


def tabulate(
    bounds: DataFrame, func: Callable[[Column], Column], *, n: int = 128, lo: str = "a", hi: str = "b"
) -> DataFrame:
    """n+1 equally spaced samples of ``func`` between each row's bounds (n made even)."""
    n += n % 2
    rows = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    at = F.col(lo) + (F.col(hi) - F.col(lo)) / n * F.col("i")
    return rows.withColumn("x", at).withColumn("y", func(F.col("x")))


def simpson_table(
    table: DataFrame, *, group_cols: Sequence[str], i: str = "i", x: str = "x", y: str = "y"
) -> DataFrame:
    """Simpson integral of samples numbered 0..n; an odd n is an error.

    One aggregate: inner weights 4, 2, 4 ... from the parity of the index, and
    the two ends, counted as 2, are put right afterwards.
    """
    idx, v = F.col(i), F.col(y)
    sums = table.groupBy(*group_cols).agg(
        F.sum(v * F.when(idx % 2 == 1, 4.0).otherwise(2.0)).alias("__s"),
        F.min_by(F.struct(F.col(x).alias("x"), v.alias("y")), idx).alias("__first"),
        F.max_by(F.struct(F.col(x).alias("x"), v.alias("y")), idx).alias("__last"),
        F.max(idx).alias("__n"),
    )
    a, b, n = F.col("__first"), F.col("__last"), F.col("__n")
    value = (F.col("__s") - a["y"] - b["y"]) * (b["x"] - a["x"]) / (n * 3.0)
    value = F.when(n % 2 == 1, F.raise_error(F.lit("an odd number of intervals")).cast("double")).otherwise(value)
    return sums.select(*group_cols, value.alias("integral"))


def argmax_table(
    table: DataFrame, *, group_cols: Sequence[str], i: str = "i", x: str = "x", y: str = "y"
) -> DataFrame:
    """Place and value of the maximum, moved to the top of the parabola through its neighbours.

    Samples may be spaced unevenly; at an end the sample itself is returned.  See :func:`spline_maximum` for the top
    of the smooth curve through all samples and :func:`maximize` for that of a function.
    """
    g = list(group_cols)
    best = table.groupBy(*g).agg(
        F.max_by(F.col(i), F.struct(F.col(y), -F.col(i))).alias("__best")
    )
    near = attach(table.select(*g, i, x, y), best, g).filter(F.abs(F.col(i) - F.col("__best")) <= 1)
    at = lambda d, c: F.max(F.when(F.col(i) - F.col("__best") == d, F.col(c)))
    samples = [(f"__{c}{n}", at(d, col)) for c, col in (("x", x), ("y", y)) for d, n in ((-1, "m"), (0, "0"), (1, "p"))]
    tip = near.groupBy(*g).agg(*[v.alias(n) for n, v in samples])
    before, after = F.col("__x0") - F.col("__xm"), F.col("__xp") - F.col("__x0")
    rise, fall = (F.col("__y0") - F.col("__ym")) / before, (F.col("__yp") - F.col("__y0")) / after
    slope, bend = (rise * after + fall * before) / (before + after), (fall - rise) / (before + after)
    shift = F.coalesce(F.try_divide(slope * -0.5, bend), F.lit(0.0))
    top = F.coalesce(F.col("__y0") + slope * shift * 0.5, F.col("__y0"))
    return tip.select(*g, (F.col("__x0") + shift).alias("x_max"), top.alias("y_max"))


def spline_maximum(
    knots: DataFrame, *, x: str = "x", y: str = "y", y2: str = "y2", group_cols: Sequence[str] = ("table_id",), **exchange
) -> DataFrame:
    """Place and value of the highest point of each spline, between its first and last knot.

    On an interval the slope is a quadratic, whose roots are tried beside the knots; so the answer is exact however the knots are
    spaced.  Of equal tops the first counts.
    """
    g = list(group_cols)
    near = neighbours(knots.select(*g, x, y, y2), [x], [x, y, y2], group_cols=g, **exchange)
    n = F.col("next")
    rows = near.select(
        *g,
        F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(y2).alias("__m"),
        (n[x] - F.col(x)).alias("__h"), n[y].alias("__y1"), n[y2].alias("__m1"),
    )
    sixth = F.col("__h") * F.col("__h") / 6.0
    # slope over the interval, by the share t of it: a t^2 + b t + c
    a = sixth * (F.col("__m1") - F.col("__m")) * 3.0
    b = sixth * F.col("__m") * 6.0
    c = F.col("__y1") - F.col("__y") - sixth * (F.col("__m") * 2.0 + F.col("__m1"))
    rows = rows.withColumns({"__a": a, "__b": b, "__c": c, "__p": sixth})
    root = F.sqrt(F.greatest(F.col("__b") * F.col("__b") - F.col("__a") * F.col("__c") * 4.0, F.lit(0.0)))
    rows = rows.withColumn("__q", (F.col("__b") + F.when(F.col("__b") < 0, -root).otherwise(root)) * -0.5)
    inside = lambda t: F.when((t > 0) & (t < 1), t)
    tried = F.array(F.lit(0.0), inside(F.try_divide(F.col("__q"), F.col("__a"))), inside(F.try_divide(F.col("__c"), F.col("__q"))))
    rows = rows.withColumn("__t", F.explode(F.array_compact(tried)))
    t = F.col("__t")
    u = F.lit(1.0) - t
    value = u * F.col("__y") + t * F.col("__y1") + ((u * u * u - u) * F.col("__m") + (t * t * t - t) * F.col("__m1")) * F.col("__p")
    # the last knot opens no interval
    rows = rows.select(*g, (F.col("__x") + F.coalesce(t * F.col("__h"), F.lit(0.0))).alias("__at"), F.when(t == 0, F.col("__y")).otherwise(value).alias("__v"))
    best = rows.groupBy(*g).agg(F.max(F.struct("__v", (-F.col("__at")).alias("__first"))).alias("__best"))
    return best.select(*g, (-F.col("__best")["__first"]).alias("x_max"), F.col("__best")["__v"].alias("y_max"))


def maximize(
    bounds: DataFrame, func: Callable[[Column], Column], *, xtol: float = 1e-6, n: int = 32, lo: str = "a", hi: str = "b"
) -> DataFrame:
    """``x_max`` and ``y_max`` of a function with one maximum between each row's bounds, to within ``xtol``.

    ``func`` may use the other columns of ``bounds``.  A row brackets its maximum between the neighbours of the best of n + 1 samples, again and
    again, until the widest bracket is below ``xtol``: nothing is shuffled.  Equal bounds give that point; null or reversed bounds give nulls.
    """
    width = bounds.agg(F.max(F.col(hi) - F.col(lo))).first()[0]
    rounds = 1
    while width is not None and width * (2.0 / n) ** rounds > xtol and rounds < 60:
        rounds += 1
    sound = F.col(lo) <= F.col(hi)
    rows = bounds.withColumns({"__lo": F.when(sound, F.col(lo).cast("double")), "__hi": F.when(sound, F.col(hi).cast("double"))})
    for _ in range(rounds):
        step = (F.col("__hi") - F.col("__lo")) / n
        rows = rows.withColumn("__step", step)
        # the value first, then the smallest place
        sample = lambda k: F.struct(func(F.col("__lo") + F.col("__step") * k).alias("v"), (-k).alias("k"))
        rows = rows.withColumn("__best", F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n)), sample)))
        at = F.col("__lo") - F.col("__best")["k"] * F.col("__step")
        rows = rows.withColumns({"__x": at, "__y": F.col("__best")["v"]})
        rows = rows.withColumns({"__lo": F.greatest(F.col("__lo"), F.col("__x") - F.col("__step")), "__hi": F.least(F.col("__hi"), F.col("__x") + F.col("__step"))})
    return rows.withColumns({"x_max": F.col("__x"), "y_max": F.when(F.col("__x").isNotNull(), F.col("__y"))}).drop("__lo", "__hi", "__step", "__best", "__x", "__y")
