"""One job over many run folders: the small tables beside the coefficients.

Every reader takes a path or glob such as ``runs/*/masses`` and keys its rows by the
folder name, so a thousand runs are one Spark job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.sources.harmonic_files import MODEL_FROM_FOLDER
from halocline.sources.listing import whole_files
from halocline.sources.text import numbers, uncommented

FREQUENCY_COLUMNS = (
    "R", "omega_h", "nu_h", "sigma_d", "v_circ_total", "v_circ_bulge", "nu_b", "psi_midplane", "d2psi_dr2",
)
GAS_NORM_COLUMNS = ("R", "value", "second_derivative", "constant")
MASS_ORDER = ("disk", "bulge", "halo")
MANIFEST_SCHEMA = (
    "struct<model:string,grid:struct<dr:double,nr:int,lmax:int>,"
    "halo:struct<r_outer_kpc:double,v0_100kms:double,a_kpc:double>,"
    "disk:map<string,double>,"
    "disk_kinematics:struct<sigma_r0:double,sigma_r_scale:double,n_radial_steps:int,n_iterations:int>>"
)


def _files(spark: SparkSession, path, key_pattern: str) -> DataFrame:
    return whole_files(spark, path).select(F.regexp_extract("file", key_pattern, 1).alias("model_id"), "value")


def _lines() -> Column:
    return F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")


def _require(ok: Column, message: str, value: Column, type_name: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(type_name))


def read_frequency_tables(spark: SparkSession, path, *, key_pattern: str = MODEL_FROM_FOLDER) -> DataFrame:
    """Nine-number rows; lines starting with ``#`` and shorter rows are skipped."""
    rows = _files(spark, path, key_pattern).select("model_id", F.explode(_lines()).alias("line"))
    rows = rows.filter(~F.col("line").startswith("#")).select("model_id", numbers(F.col("line")).alias("v"))
    return rows.filter(F.size("v") >= 9).select(
        "model_id", *[F.col("v")[i].alias(c) for i, c in enumerate(FREQUENCY_COLUMNS)]
    )


def read_disk_corrections(spark: SparkSession, path, *, key_pattern: str = MODEL_FROM_FOLDER) -> DataFrame:
    """Rows ``(model_id, R, f_d, f_sz)`` with the header's ``sigma_r0, sigma_r_scale, n_declared``."""
    files = _files(spark, path, key_pattern).select("model_id", _lines().alias("__l"))
    head = numbers(uncommented(F.get("__l", F.lit(0))))
    files = files.withColumn(
        "__h", _require(F.size(head) >= 3, "invalid correction header", head, "array<double>")
    )
    rows = files.select(
        "model_id", "__h", F.explode(F.slice("__l", F.lit(2), F.size("__l"))).alias("line")
    ).withColumn("v", numbers(uncommented(F.col("line"))))
    return rows.filter(F.size("v") >= 3).select(
        "model_id",
        F.col("__h")[0].alias("sigma_r0"),
        F.col("__h")[1].alias("sigma_r_scale"),
        F.col("__h")[2].cast("int").alias("n_declared"),
        *[F.col("v")[i].alias(c) for i, c in enumerate(("R", "f_d", "f_sz"))],
    )


def read_component_masses(spark: SparkSession, path, *, key_pattern: str = MODEL_FROM_FOLDER) -> DataFrame:
    """Rows ``(model_id, component, mass, radius)`` from three ordered lines; fewer is an error."""
    files = _files(spark, path, key_pattern).select("model_id", _lines().alias("__l"))
    lines = _require(F.size("__l") >= 3, "a mass table needs three lines", F.col("__l"), "array<string>")
    rows = files.select("model_id", F.posexplode(F.slice(lines, 1, 3)).alias("i", "line"))
    v = numbers(F.col("line"))
    names = F.array(*[F.lit(c) for c in MASS_ORDER])
    return rows.select(
        "model_id", F.get(names, F.col("i")).alias("component"), v[0].alias("mass"), v[1].alias("radius")
    )


def read_scalars(spark: SparkSession, path, name: str, *, key_pattern: str = MODEL_FROM_FOLDER) -> DataFrame:
    """The first number of each file as column ``name``."""
    v = numbers(F.col("value"))
    return _files(spark, path, key_pattern).select("model_id", v[0].alias(name))


def read_gas_norms(spark: SparkSession, path, *, key_pattern: str = MODEL_FROM_FOLDER) -> DataFrame:
    """Four-number spline rows; the third is the stored second derivative."""
    rows = _files(spark, path, key_pattern).select("model_id", F.explode(_lines()).alias("line"))
    rows = rows.withColumn("v", numbers(F.col("line"))).filter(F.size("v") >= 4)
    return rows.select("model_id", *[F.col("v")[i].alias(c) for i, c in enumerate(GAS_NORM_COLUMNS)])


def parse_manifest(json: Column, schema: str = MANIFEST_SCHEMA) -> Column:
    """Struct of a run manifest, or of JSON of another given schema; null where malformed."""
    return F.from_json(json, schema)


def read_manifests(spark: SparkSession, path, *, key_pattern: str = MODEL_FROM_FOLDER) -> DataFrame:
    """One struct row per manifest: ``model, grid, halo, disk, disk_kinematics``."""
    files = _files(spark, path, key_pattern)
    return files.select("model_id", parse_manifest(F.col("value")).alias("m")).select("model_id", "m.*")
