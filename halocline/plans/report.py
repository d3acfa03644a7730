"""Summary tables of a galaxy's particles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.operators.curves import linear_resample, particle_rotation_curve
from halocline.operators.moments import component_summary
from halocline.operators.profiles import radial_profile_disk
from halocline.storage import materialise


def galaxy_report(
    particles: DataFrame,
    *,
    component_col: str = "component",
    group_cols: Sequence[str] = (),
    curve_stop: float = 100.0,
    curve_points: int = 500,
    checks: DataFrame | None = None,
    **curve_options,
) -> DataFrame:
    """Long table ``(section, group columns, component, item, metric, value)``.

    Sections: ``summary`` (n, mass, dispersions), ``profile`` (radial bins),
    ``curve`` (rotation curve on a grid) and, when ``checks`` (a consistency
    report) is given, ``check`` with 1 for passed rules.  Each section is run and stored on its own, so the driver holds the
    plan and the broadcasts of one section at a time.
    """
    g = [*group_cols, component_col]

    def long(df: DataFrame, section: str, item, metrics: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        rows = df.select(*g, item.cast("string").alias("item"), F.explode(pairs).alias("p"))
        return materialise(rows.select(F.lit(section).alias("section"), *g, "item", "p.metric", "p.value"), f"report-{section}")

    summary = component_summary(particles, component_col=component_col, group_cols=group_cols)
    profile = radial_profile_disk(particles, group_cols=g)
    curve = particle_rotation_curve(particles, group_cols=g, **curve_options)
    grid = linear_resample(curve, start=0.0, stop=curve_stop, num=curve_points, group_cols=g)
    out = long(summary, "summary", F.lit("all"), ["n", "total_mass", "sigma_vx", "sigma_vy", "sigma_vz"])
    out = out.unionByName(
        long(profile, "profile", F.col("bin"), ["n", "sigma_z", "sigma_vz", "mean_vphi", "sigma_vR", "surface_density"])
    )
    out = out.unionByName(long(grid.withColumnRenamed("y", "v"), "curve", F.col("i"), ["v"]))
    if checks is not None:
        rows = checks.select(
            F.lit("check").alias("section"),
            *[c for c in checks.columns if c not in ("rule", "passed", "observed", "detail")],
            F.col("rule").alias("item"),
            F.lit("passed").alias("metric"),
            F.col("passed").cast("int").cast("double").alias("value"),
        )
        # checks carry the columns that name their model
        out = out.unionByName(materialise(rows, "report-check"), allowMissingColumns=True)
    return out
