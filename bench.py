"""Time the headline queries once each (after a warm-up) and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from halocline.queries import raw_queries

HEADLINE = (
    "cylindrical_kinematics",
    "recenter",
    "component_summary",
    "velocity_dispersion",
    "radial_profile_disk",
    "map_2d_profile",
    "enclosed_mass",
    "particle_rotation_curve",
    "combined_rotation_curve",
    "assign_ids",
    "component_subsample",
    "center_on_core",
    "nfw_fit",
    "spline_coefficients",
    "spline_lookup",
    "density_field",
    "analytic_field",
    "harmonic_interpolate",
    "evaluate_force",
    "rotation_decomposition",
    "multipole_potential",
    "grid_lookup_bilinear",
    "scan_particles",
    "ingest_harmonics",
    "consistency_report",
    "halo_from_particles",
    "galaxy_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = raw_queries()
    names = sys.argv[1:] or HEADLINE
    registered["total_mass"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
