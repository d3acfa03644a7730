"""Mass-weighted moments per group.  All aggregates combine map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.operators.frames import POS, VEL
from halocline.operators.keys import attach


def total_mass(df: DataFrame, *, mass: str = "mass", group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.sum(mass).alias("total_mass"))


def center_of_mass(
    df: DataFrame, *, mass: str = "mass", pos: Sequence[str] = POS, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Columns ``com_x``, ...; null for a massless group."""
    m = F.col(mass)
    return df.groupBy(*group_cols).agg(
        *[F.try_divide(F.sum(m * F.col(c)), F.sum(m)).alias(f"com_{c}") for c in pos]
    )


def velocity_dispersion(
    df: DataFrame, *, mass: str = "mass", vel: Sequence[str] = VEL, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Mass-weighted dispersion about the mean velocity, with N and total mass.

    Two passes (means first, then squared offsets), which stays exact for cold
    groups with a large bulk velocity.
    """
    m = F.col(mass)
    means = df.groupBy(*group_cols).agg(
        *[F.try_divide(F.sum(m * F.col(c)), F.sum(m)).alias(f"__mean_{c}") for c in vel]
    )
    both = attach(df.select(*group_cols, mass, *vel), means, group_cols)

    def sigma(c: str):
        d = F.col(c) - F.col(f"__mean_{c}")
        return F.sqrt(F.try_divide(F.sum(m * d * d), F.sum(m))).alias(f"sigma_{c}")

    return both.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.sum(m).alias("total_mass"), *[sigma(c) for c in vel]
    )


def component_summary(
    df: DataFrame,
    *,
    mass: str = "mass",
    vel: Sequence[str] = VEL,
    component_col: str = "component",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """N, mass and dispersions per component (and group)."""
    return velocity_dispersion(df, mass=mass, vel=vel, group_cols=[*group_cols, component_col])


def frame_means(
    df: DataFrame, *, pos: Sequence[str] = POS, vel: Sequence[str] = VEL, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Plain averages of positions and velocities, for checking a frame."""
    return df.groupBy(*group_cols).agg(*[F.avg(c).alias(f"mean_{c}") for c in [*pos, *vel]])


def expected_mass_check(
    df: DataFrame,
    expected: DataFrame,
    *,
    group_cols: Sequence[str] = ("component",),
    mass: str = "mass",
    order_cols: Sequence[str] = ("particle_id", "mass"),
    tolerance: float = 0.05,
) -> DataFrame:
    """First particle's mass times the declared count against the model mass.

    ``expected`` holds ``declared_n`` and ``model_mass`` per group.  A group without particles, or
    one that nothing is expected of, has a row that isn't ``within``.
    """
    first = df.groupBy(*group_cols).agg(
        F.min_by(mass, F.struct(*order_cols)).alias("first_mass"), F.count(F.lit(1)).alias("n")
    )
    both = first.join(expected, list(group_cols), "full").withColumn("n", F.coalesce("n", F.lit(0)))
    implied = F.col("first_mass") * F.col("declared_n")
    off = F.abs(F.try_divide(implied, F.col("model_mass")) - 1.0)
    return both.withColumn("implied_mass", implied).withColumn(
        "within", F.coalesce(off <= tolerance, F.lit(False))
    )
