"""Multipole coefficients straight from particles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocline.functions.special import even_legendre
from halocline.operators.frames import POS
from halocline.operators.keys import lookup_join


def multipole_density(
    particles: DataFrame,
    *,
    dr: float,
    nr: int,
    lmax: int,
    mass: str = "mass",
    pos: Sequence[str] = POS,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Density per (group, l, shell) with shell s spanning [s dr, (s+1) dr); empty shells are absent.

    rho_l = (2l+1) * sum(m P_l(cos theta)) / shell volume, and ``mass_l`` is the sum itself.  All
    that lies beyond the grid is in shell ``nr``, without radius and density, so ``mass_l`` of order 0
    adds up to the whole mass; ``outer_l`` of that shell is its moment sum(m P_l / r^(l+1)), which
    is all that the inside feels of it.
    """
    x, y, z = (F.col(c) for c in pos)
    rows = particles.withColumn("__r", F.sqrt(x * x + y * y + z * z))
    cos = F.coalesce(F.try_divide(z, F.col("__r")), F.lit(0.0))
    shell = F.least(F.floor(F.col("__r") / dr), F.lit(nr)).cast("int")
    per_r = F.when(shell == nr, F.try_divide(F.lit(1.0), F.col("__r")))
    rows = rows.select(*group_cols, F.col(mass).alias("__m"), cos.alias("__cos"), shell.alias("shell"), per_r.alias("__u"))
    orders = list(range(0, lmax + 1, 2))
    legendre = even_legendre(F.col("__cos"), lmax)
    sums = rows.groupBy(*group_cols, "shell").agg(
        *[F.sum(F.col("__m") * p).alias(f"__s{l}") for l, (p, _) in zip(orders, legendre)],
        *[F.sum(F.col("__m") * p * F.pow("__u", F.lit(l + 1.0))).alias(f"__o{l}") for l, (p, _) in zip(orders, legendre)],
    )
    per_l = F.explode(
        F.array(*[F.struct(F.lit(l).alias("l"), F.col(f"__s{l}").alias("m"), (F.col(f"__s{l}") * (2 * l + 1)).alias("s"), F.col(f"__o{l}").alias("o")) for l in orders])
    )
    lo, hi = F.col("shell") * dr, (F.col("shell") + 1) * dr
    volume = (hi * hi * hi - lo * lo * lo) * (4.0 * math.pi / 3.0)
    return sums.select(*group_cols, "shell", per_l.alias("__l")).select(
        *group_cols,
        F.col("__l.l").alias("l"),
        "shell",
        F.when(F.col("shell") < nr, (lo + hi) * 0.5).alias("r"),
        F.when(F.col("shell") < nr, F.col("__l.s") / volume).alias("rho"),
        F.col("__l.m").alias("mass_l"),
        F.col("__l.o").alias("outer_l"),
    )


def multipole_potential(
    density: DataFrame,
    *,
    dr: float,
    nr: int,
    edge_zero: bool = False,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Coefficient rows (l, ir, r, adens, apot, fr) on ir = 0..nr from shell densities.

    The inner integral of rho r^(l+2) and the outer one of rho r^(1-l) are exact
    for constant density in a shell and become running sums over the nr shells
    of each (group, l).  Mass beyond the grid enters the outer integral of every order by its moments ``outer_l``, which are
    exact for any place of it; a ``density`` without that column has none.  Values are divided by the harmonic normalisation.
    ``edge_zero`` shifts every order to vanish at the edge.
    """
    g = [*group_cols, "l"]
    if "outer_l" not in density.columns:
        density = density.withColumn("outer_l", F.lit(None).cast("double"))
    nodes = density.select(*g).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(nr))).alias("ir"))
    shells = density.select(*g, F.col("shell").alias("ir"), "rho", "outer_l")
    full = lookup_join(nodes, shells, [*g, "ir"], "left")
    l = F.col("l").cast("double")
    lo, hi = F.col("ir") * F.lit(float(dr)), (F.col("ir") + 1) * F.lit(float(dr))
    rho = F.when(F.col("ir") < nr, F.coalesce("rho", F.lit(0.0))).otherwise(0.0)
    inner = rho * (F.pow(hi, l + 3) - F.pow(lo, l + 3)) / (l + 3)
    # for l > 2 the innermost shell's outer integral diverges, but it only meets r = 0
    outer = (
        F.when((F.col("ir") == 0) & (F.col("l") >= 2), 0.0)
        .when(F.col("l") == 2, rho * F.log(F.try_divide(hi, lo)))
        .otherwise(rho * F.try_divide(F.pow(hi, F.lit(2.0) - l) - F.pow(lo, F.lit(2.0) - l), F.lit(2.0) - l))
    )
    # a point mass is a shell of density (2l+1) m P_l / (4 pi r^2)
    beyond = F.when(F.col("ir") == nr, F.coalesce("outer_l", F.lit(0.0)) * (l * 2.0 + 1.0) / (4.0 * math.pi)).otherwise(0.0)
    w = Window.partitionBy(*g).orderBy("ir")
    sums = full.select(
        *g,
        "ir",
        rho.alias("__rho"),
        F.coalesce(F.sum(inner).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__in"),
        F.sum(outer + beyond).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("__out"),
    )
    r = F.col("ir") * F.lit(float(dr))
    k = F.lit(4.0 * math.pi) / (l * 2.0 + 1.0)
    norm = F.sqrt((l * 2.0 + 1.0) / (4.0 * math.pi))
    at_centre = F.col("ir") == 0
    apot = F.when(at_centre, F.when(F.col("l") == 0, F.col("__out")).otherwise(0.0)).otherwise(
        F.col("__in") * F.pow(r, -l - 1.0) + F.col("__out") * F.pow(r, l)
    )
    fr = F.when(at_centre, 0.0).otherwise(
        F.col("__in") * (l + 1.0) * F.pow(r, -l - 2.0) - F.col("__out") * l * F.pow(r, l - 1.0)
    )
    out = sums.select(
        *g,
        "ir",
        r.alias("r"),
        (F.col("__rho") / norm).alias("adens"),
        (k * apot / norm).alias("apot"),
        (k * fr / norm).alias("fr"),
    )
    if edge_zero:
        whole = Window.partitionBy(*g)
        out = out.withColumn("apot", F.col("apot") - F.max(F.when(F.col("ir") == nr, F.col("apot"))).over(whole))
    return out
