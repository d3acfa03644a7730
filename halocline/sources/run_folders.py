"""Checks of run folders from what is in them: names by a listing without contents, faults of files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.sources.listing import list_files

MISSING = "missing"


def artifact_listing(spark: SparkSession, path: str, *, run_pattern: str = r"([^/]+)/[^/]+$", name_pattern: str = r"([^/]+)$") -> DataFrame:
    """(model_id, name, bytes) of the files under ``path`` (globs allowed); no file is opened, and empty ones aren't listed."""
    found = list_files(spark, path)
    files = found.files if found else spark.read.format("binaryFile").load(path).select("path", "length")
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    return files.select(part(run_pattern).alias("model_id"), part(name_pattern).alias("name"), F.col("length").alias("bytes"))


def folder_problems(runs: DataFrame, listing: DataFrame, required: Sequence[str], *faults: tuple[str, DataFrame]) -> DataFrame:
    """(model_id, name, problem): required files of ``runs`` that are missing, which an empty one counts as, and the faults found in others.

    ``faults`` are pairs of a file's name and a table (model_id, fault) as ingest gives it; a file may be a folder of parts.  A run of which nothing is listed lacks everything; runs that aren't asked for have no row.
    """
    wanted = runs.select("model_id", F.explode(F.array(*[F.lit(n) for n in required])).alias("name"))
    # names of files pack so well that the planner would take a million of them for small enough to gather on the driver
    seen = listing.select("model_id", "name").distinct().hint("merge")
    asked = runs.select("model_id").hint("merge")
    out = wanted.join(seen, ["model_id", "name"], "left_anti").select("model_id", "name", F.lit(MISSING).alias("problem"))
    for name, found in faults:
        broken = found.select("model_id", F.lit(name).alias("name"), F.col("fault").alias("problem"))
        out = out.unionByName(broken.join(asked, "model_id", "left_semi"))
    return out
