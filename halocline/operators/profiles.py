"""Binned profiles, maps, histograms and enclosed mass.

Rows shuffle only as partial sums per (group, bin), so crowded central bins
cost nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halocline.functions.special import all_finite
from halocline.operators.frames import POS, VEL, cylindrical_kinematics
from halocline.operators.keys import attach, lookup_join

NBIN = 50
RMAX = 20.0


def radial_bin(R: Column, nbin: int, rmax: float, rmin: float = 0.0) -> Column:
    """0-based bin of width (rmax-rmin)/nbin."""
    return F.floor((R - rmin) / ((rmax - rmin) / nbin)).cast("int")


def _annulus(bin_col: Column, nbin: int, rmax: float, rmin: float) -> tuple[Column, Column]:
    dr = (rmax - rmin) / nbin
    r = (bin_col + 0.5) * dr + rmin
    lo, hi = r - 0.5 * dr, r + 0.5 * dr
    return r, (hi * hi - lo * lo) * math.pi


def _binned(df, nbin, rmax, rmin, pos, vel, acc, velocity_scale) -> DataFrame:
    rows = cylindrical_kinematics(df, pos=pos, vel=vel, acc=acc, velocity_scale=velocity_scale)
    rows = rows.withColumn("bin", radial_bin(F.col("R_cyl"), nbin, rmax, rmin))
    return rows.filter((F.col("bin") >= 0) & (F.col("bin") < nbin))


def radial_profile_disk(
    df: DataFrame,
    *,
    nbin: int = NBIN,
    rmax: float = RMAX,
    min_count: int = 10,
    velocity_scale: float = 100.0,
    mass: str = "mass",
    pos: Sequence[str] = POS,
    vel: Sequence[str] = VEL,
    acc: Sequence[str] | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Thickness, velocity moments and surface density per radial bin of more than ``min_count``."""
    rows = _binned(df, nbin, rmax, 0.0, pos, vel, acc, velocity_scale)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(pos[2]).alias("mean_z"),
        F.stddev_pop(pos[2]).alias("sigma_z"),
        F.avg("v_z").alias("mean_vz"),
        F.stddev_pop("v_z").alias("sigma_vz"),
        F.avg("v_phi").alias("mean_vphi"),
        F.avg("v_R").alias("mean_vR"),
        F.stddev_pop("v_R").alias("sigma_vR"),
        F.sum(mass).alias("__mass"),
        F.avg("v_phi_sq").alias("mean_vphi_sq"),
    ]
    if acc is not None:
        aggs.append(F.avg("R_dot_a").alias("mean_R_dot_a"))
    r, area = _annulus(F.col("bin"), nbin, rmax, 0.0)
    return (
        rows.groupBy(*group_cols, "bin")
        .agg(*aggs)
        .filter(F.col("n") > min_count)
        .withColumn("r", r)
        .withColumn("surface_density", F.col("__mass") / area)
        .drop("__mass")
    )


def radial_profile_gas(
    df: DataFrame,
    *,
    nbin: int = NBIN,
    rmin: float = 0.0,
    rmax: float = RMAX,
    min_count: int = 10,
    pos: Sequence[str] = POS,
    vel: Sequence[str] = VEL,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Like :func:`radial_profile_disk` in internal velocities, with the number density in dex."""
    rows = _binned(df, nbin, rmax, rmin, pos, vel, None, 1.0)
    r, area = _annulus(F.col("bin"), nbin, rmax, rmin)
    return (
        rows.groupBy(*group_cols, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(pos[2]).alias("mean_z"),
            F.stddev_pop(pos[2]).alias("sigma_z"),
            F.avg("v_z").alias("mean_vz"),
            F.stddev_pop("v_z").alias("sigma_vz"),
            F.avg("v_phi").alias("mean_vphi"),
            F.stddev_pop("v_phi").alias("sigma_vphi"),
            F.avg("v_R").alias("mean_vR"),
            F.stddev_pop("v_R").alias("sigma_vR"),
        )
        .filter(F.col("n") > min_count)
        .withColumn("r", r)
        .withColumn("log_number_density", F.log10(F.col("n") / area))
    )


def _every_bin(
    cells: DataFrame, keys: Sequence[str], bin_col: str, n_bins: int, values: Sequence[str]
) -> DataFrame:
    """One row per key and bin, with null ``values`` where ``cells`` has none; a null bin only keeps its key.

    A key has at most ``n_bins`` + 1 cells, so the map that gathers them is small, and
    the particles behind the cells are not read a second time for the keys.
    """
    cell = F.struct(bin_col, F.struct(*values))
    found = F.collect_list(F.when(F.col(bin_col).isNotNull(), cell))
    rows = cells.groupBy(*keys).agg(F.map_from_entries(found).alias("__found"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias(bin_col))
    hit = F.element_at("__found", F.col(bin_col))
    return rows.select(*keys, bin_col, *[hit[v].alias(v) for v in values])


def _fault(what: str, group_cols: Sequence[str]) -> Column:
    """Error text that names the group."""
    keys = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in group_cols]
    return F.concat_ws(" ", F.lit(what), *keys)


def map_2d_profile(
    df: DataFrame,
    *,
    nbin: int = NBIN,
    rmax: float = RMAX,
    nz: int = 9,
    min_count: int = 10,
    velocity_scale: float = 100.0,
    pos: Sequence[str] = POS,
    vel: Sequence[str] = VEL,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """(R, z) map: number density in dex (-100 when empty) and mean v_phi (0 when empty).

    Each radial bin spans two of its own vertical dispersions up and down; a
    particle counts in the nearest of ``nz`` planes.
    """
    g = list(group_cols)
    rows = _binned(df, nbin, rmax, 0.0, pos, vel, None, velocity_scale)
    spread = (
        rows.groupBy(*g, "bin")
        .agg(F.count(F.lit(1)).alias("__n"), F.stddev_pop(pos[2]).alias("__sigma"))
        .filter(F.col("__n") > min_count)
        .select(*g, "bin", (F.col("__sigma") * 2.0).alias("__zmax"))
    )
    bound = nbin if not g else None
    placed = lookup_join(rows.select(*g, "bin", pos[2], "v_phi"), spread, [*g, "bin"], max_rows=bound)
    plane = F.round(F.try_divide(F.col(pos[2]) + F.col("__zmax"), F.col("__zmax") * 2.0 / (nz - 1))).cast("int")
    # particles beyond the planes count in none, but keep their bin in the map
    cells = (
        placed.withColumn("iz", F.when((plane >= 0) & (plane < nz), plane))
        .groupBy(*g, "bin", "iz")
        .agg(F.count(F.lit(1)).alias("__cell"), F.avg("v_phi").alias("__vphi"))
    )
    r, area = _annulus(F.col("bin"), nbin, rmax, 0.0)
    full = _every_bin(cells, [*g, "bin"], "iz", nz, ["__cell", "__vphi"])
    return full.select(
        *g,
        "bin",
        "iz",
        r.alias("r"),
        F.coalesce("__cell", F.lit(0)).alias("n"),
        F.coalesce(F.log10(F.col("__cell") / area), F.lit(-100.0)).alias("log_number_density"),
        F.coalesce("__vphi", F.lit(0.0)).alias("mean_vphi"),
    )


def density_histogram(
    df: DataFrame,
    *,
    lo: float = 0.1,
    hi: float = 200.0,
    edges: int = 400,
    pos: Sequence[str] = POS,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Counts of r between equally spaced edges, also divided by the squared upper edge."""
    nb = edges - 1
    dr = (hi - lo) / nb
    r = F.sqrt(sum((F.col(c) * F.col(c) for c in pos[1:]), F.col(pos[0]) * F.col(pos[0])))
    rows = df.select(*group_cols, r.alias("__r")).filter((F.col("__r") >= lo) & (F.col("__r") <= hi))
    counts = rows.groupBy(
        *group_cols, F.least(F.floor((F.col("__r") - lo) / dr), F.lit(nb - 1)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    upper = (F.col("bin") + 1) * dr + lo
    return counts.withColumn("r", upper - dr).withColumn("weighted", F.col("n") / (upper * upper))


def velocity_histogram(
    df: DataFrame, *, bins: int = 50, vel: Sequence[str] = VEL, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Histogram of each velocity axis over its own range; every bin is reported."""
    g = list(group_cols)
    ends = df.groupBy(*g).agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"__{c}") for c in vel])
    wide = attach(df.select(*g, *vel), ends, g)
    axes = F.array(
        *[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v"), F.col(f"__{c}").alias("ends")) for c in vel]
    )
    placed = wide.select(*g, F.explode(axes).alias("a")).select(*g, "a.axis", "a.v", "a.ends.*")
    placed = placed.filter(F.col("v").isNotNull())
    flat = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    placed = placed.withColumns({"lo": F.col("lo") - flat, "hi": F.col("hi") + flat})
    keys = [*g, "axis", "lo", "hi"]
    at = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = placed.groupBy(*keys, F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    full = _every_bin(counts, keys, "bin", bins, ["n"])
    width = (F.col("hi") - F.col("lo")) / bins
    return full.select(
        *g, "axis", "bin", (F.col("lo") + width * F.col("bin")).alias("v_lo"), F.coalesce("n", F.lit(0)).alias("n")
    )


def enclosed_mass(
    df: DataFrame,
    *,
    n_bins: int = 40,
    mass: str = "mass",
    pos: Sequence[str] = POS,
    group_cols: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """M(<= edge) at logarithmic edges from the innermost positive radius (at least 1e-3) to r_max.

    One pass finds the radial range, one adds mass into bins; the running sum
    works on ``n_bins`` rows per group.  A group without extent is an error, or
    left out when not ``strict``.
    """
    g = list(group_cols)
    r = F.sqrt(sum((F.col(c) * F.col(c) for c in pos[1:]), F.col(pos[0]) * F.col(pos[0])))
    rows = df.select(*g, F.col(mass).alias("__m"), r.alias("__r"))
    span = rows.groupBy(*g).agg(
        F.greatest(F.min(F.when(F.col("__r") > 0, F.col("__r"))), F.lit(1e-3)).alias("__lo"),
        F.max("__r").alias("r_max"),
    )
    flat = F.coalesce(F.col("r_max") <= 0, F.lit(True))
    if strict:
        span = span.withColumn(
            "r_max",
            F.when(flat, F.raise_error(_fault("zero extent in r", g)).cast("double")).otherwise(
                F.col("r_max")
            ),
        )
    else:
        span = span.filter(~flat)
    span = span.withColumn("__step", F.log(F.col("r_max") / F.col("__lo")) / n_bins)
    placed = attach(rows, span, g)
    at = F.ceil(F.try_divide(F.log(F.col("__r") / F.col("__lo")), F.col("__step"))) - 1
    at = F.when(F.col("__r") <= F.col("__lo"), 0).when(F.col("__r") >= F.col("r_max"), n_bins - 1).otherwise(at)
    shells = [*g, "__lo", "__step", "r_max"]
    sums = placed.groupBy(*shells, F.least(F.greatest(at, F.lit(0)), F.lit(n_bins - 1)).cast("int").alias("bin")).agg(
        F.sum("__m").alias("__m")
    )
    full = _every_bin(sums, shells, "bin", n_bins, ["__m"])
    upto = Window.partitionBy(*(g or [F.lit(0)])).orderBy("bin").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    edge = F.when(F.col("bin") == n_bins - 1, F.col("r_max")).otherwise(
        F.col("__lo") * F.exp(F.col("__step") * (F.col("bin") + 1))
    )
    return full.select(
        *g,
        "bin",
        (F.col("__lo") * F.exp(F.col("__step") * (F.col("bin") + 0.5))).alias("r"),
        edge.alias("r_edge"),
        F.coalesce(F.sum("__m").over(upto), F.lit(0.0)).alias("m_enc"),
        "r_max",
    )


def log_profile(
    profiles: dict[str, DataFrame], *, on: Sequence[str], value: str, radius: str | None = None, base: str = "ln"
) -> DataFrame:
    """Full join of profile tables on radius (and groups) with log-scaled values side by side.

    ``radius`` names a join column whose logarithm is added too.  Non-positive values
    have no logarithm and give null.
    """
    scale = {"ln": F.log, "log10": F.log10}[base]
    logarithm = lambda v: F.when((v > 0) & all_finite(v), scale(v))
    out = None
    for name, df in profiles.items():
        part = df.select(*on, logarithm(F.col(value)).alias(f"{base}_{name}"))
        out = part if out is None else out.join(part, list(on), "full")
    return out if radius is None else out.withColumn(f"{base}_{radius}", logarithm(F.col(radius)))
