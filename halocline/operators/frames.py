"""Per-particle projections and filters."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions.units import DEFAULT_UNITS, UnitSystem
from halocline.operators.keys import attach

POS = ("x", "y", "z")
VEL = ("vx", "vy", "vz")


def unit_convert(
    df: DataFrame, kinds: Mapping[str, str], *, to_physical: bool = True, units: UnitSystem = DEFAULT_UNITS
) -> DataFrame:
    """Convert columns in place; ``kinds`` maps a column to length, velocity or mass."""
    change = units.to_physical if to_physical else units.from_physical
    return df.withColumns({c: change(F.col(c), k) for c, k in kinds.items()})


def cylindrical_kinematics(
    df: DataFrame,
    *,
    pos: Sequence[str] = POS,
    vel: Sequence[str] = VEL,
    acc: Sequence[str] | None = None,
    velocity_scale: float = 1.0,
) -> DataFrame:
    """Add r, R, v_phi, v_R, v_z with their squares (null velocities on the axis), and R.a."""
    x, y, z = (F.col(c) for c in pos)
    vx, vy, vz = (F.col(c) * velocity_scale for c in vel)
    R = F.sqrt(x * x + y * y)
    out = df.withColumns(
        {
            "r": F.sqrt(x * x + y * y + z * z),
            "R_cyl": R,
            "v_phi": F.try_divide(x * vy - y * vx, R),
            "v_R": F.try_divide(x * vx + y * vy, R),
            "v_z": vz,
        }
    ).withColumns({f"{c}_sq": F.col(c) * F.col(c) for c in ("v_phi", "v_R", "v_z")})
    if acc is not None:
        out = out.withColumn("R_dot_a", x * F.col(acc[0]) + y * F.col(acc[1]))
    return out


def frame_shift(
    df: DataFrame,
    offset: Sequence[float] = (0.0, 0.0, 0.0),
    boost: Sequence[float] = (0.0, 0.0, 0.0),
    *,
    scale_factor: float = 1.0,
    mass: str = "mass",
    pos: Sequence[str] = POS,
    vel: Sequence[str] = VEL,
    units: UnitSystem = DEFAULT_UNITS,
    mass_unit_msun: float = 1.0e10,
) -> DataFrame:
    """Shift positions, boost velocities (km/s over a^1.5) and rescale the mass unit."""
    a15 = scale_factor**1.5
    change = {c: F.col(c) + d for c, d in zip(pos, offset)}
    change |= {c: F.col(c) * units.velocity_kms / a15 + b / a15 for c, b in zip(vel, boost)}
    change[mass] = F.col(mass) / (mass_unit_msun / units.mass_msun)
    return df.withColumns(change)


# bounds are moved by a little more than rounding can move a radius
LOOSE = 1e-12


def _within(cols: Sequence[str], reach: float) -> Column:
    """Every coordinate is between -reach and reach: a plain comparison that a parquet scan can skip by."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.col(c) <= reach * (1 + LOOSE)) & (F.col(c) >= -reach * (1 + LOOSE))
    return ok


def _beyond(cols: Sequence[str], radius: float) -> Column:
    """Some coordinate is as far out as the farthest of a point at ``radius`` has to be."""
    least = radius / math.sqrt(len(cols)) * (1 - LOOSE)
    ok = F.lit(False)
    for c in cols:
        ok = ok | (F.col(c) >= least) | (F.col(c) <= -least)
    return ok


def annulus_filter(df: DataFrame, lo: float = 2.6, hi: float = 2.8, *, pos: Sequence[str] = POS) -> DataFrame:
    """Rows with lo < R < hi.

    Bounds on the coordinates themselves, which follow from it, let a scan skip what lies elsewhere in files that are laid out by
    place (:func:`halocline.sources.text.write_particles`).
    """
    x, y = F.col(pos[0]), F.col(pos[1])
    R = F.sqrt(x * x + y * y)
    if hi > 0:
        df = df.filter(_within(pos[:2], hi))
    if lo > 0:
        df = df.filter(_beyond(pos[:2], lo))
    return df.filter((R > lo) & (R < hi))


def sphere_filter(df: DataFrame, radius: float, *, pos: Sequence[str] = POS) -> DataFrame:
    """Rows strictly inside a sphere about the origin; a scan may skip what lies outside its box."""
    x, y, z = (F.col(c) for c in pos)
    df = df.filter(_within(pos, abs(radius)))
    return df.filter(x * x + y * y + z * z < radius * radius)


def min_count_filter(df: DataFrame, count_col: str = "n", more_than: int = 10) -> DataFrame:
    """Bins with more than ``more_than`` members."""
    return df.filter(F.col(count_col) > more_than)


def recenter(
    df: DataFrame,
    *,
    mass: str = "mass",
    pos: Sequence[str] = POS,
    vel: Sequence[str] | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Move each group's centre of mass (and optionally mean velocity) to zero."""
    cols = [*pos, *(vel or ())]
    m = F.col(mass)
    means = df.groupBy(*group_cols).agg(
        *[F.try_divide(F.sum(m * F.col(c)), F.sum(m)).alias(f"__mean_{c}") for c in cols]
    )
    out = attach(df, means, group_cols)
    return out.withColumns({c: F.col(c) - F.coalesce(F.col(f"__mean_{c}"), F.lit(0.0)) for c in cols}).drop(
        *[f"__mean_{c}" for c in cols]
    )


# ---- component tables ----------------------------------------------------------

def union_components(parts: Mapping[str, DataFrame], component_col: str = "component") -> DataFrame:
    """One table from per-component tables, each tagged with its name."""
    tagged = [df.withColumn(component_col, F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def replace_component(
    df: DataFrame, component: str, external: DataFrame, component_col: str = "component"
) -> DataFrame:
    """Drop one component and put the rows of ``external`` in its place."""
    kept = df.filter(~F.col(component_col).eqNullSafe(F.lit(component)))
    return kept.unionByName(external.withColumn(component_col, F.lit(component)))
