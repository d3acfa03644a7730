"""Batch ingest of multipole coefficient files into a catalog and long rows.

A file has six numeric header lines and a line of six component flags, each
possibly behind ``#`` and with label lines between; then, after the output
marker, three blocks (density, potential, radial force) of nr+1 rows
``r c_0 c_2 ...``.  Each file is one input row, opened up with array functions,
so many files are read in parallel without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.operators.models import absent, component
from halocline.sources.listing import whole_files
from halocline.sources.text import numbers, uncommented
from halocline.storage import materialise

# Fixed value: text on the line that ends the header.
MARKER = "OUTPUT FROM"

MODEL_FROM_FOLDER = r"([^/]+)/[^/]+$"


NO_MARKER, BAD_HEADER, BAD_ROWS = "no coefficient block marker", "unexpected coefficient file header", "wrong number of coefficient rows"


def _parsed(spark: SparkSession, path: str | Sequence[str], key_pattern: str) -> DataFrame:
    """(model_id, file, fault, header lines, flags, rows) of every file; ``fault`` is null where the file is sound."""
    lines = F.split("value", r"\r?\n")
    out = whole_files(spark, path).select(F.regexp_extract("file", key_pattern, 1).alias("model_id"), "file", lines.alias("__lines"))
    marker = F.array_position(F.transform("__lines", lambda s: s.contains(MARKER)), True)
    out = out.withColumn("__mark", marker.cast("int"))
    # without a marker there is neither a header nor a block
    marked = F.when(F.col("__mark") > 0, F.col("__mark")).otherwise(F.size("__lines") + 1)
    lost = F.col("__mark") <= 0
    out = out.withColumn("__lost", lost)
    values = lambda part: F.filter(F.transform(part, lambda s: numbers(uncommented(s))), lambda v: F.size(v) > 0)
    is_flags = lambda v: (F.size(v) == 6) & F.forall(v, lambda x: x.isin(-1.0, 0.0, 1.0))
    out = out.withColumn("__mark", marked)
    out = out.withColumn("__head", values(F.slice("__lines", F.lit(1), F.col("__mark") - 1)))
    out = out.withColumns(
        {
            "__flags": F.filter("__head", is_flags),
            "__h": F.filter("__head", lambda v: ~is_flags(v)),
            "__rows": F.filter(
                values(F.slice("__lines", F.col("__mark") + 1, F.size("__lines"))), lambda v: F.size(v) >= 2
            ),
        }
    )
    rows = (F.coalesce(_value(0, 7).cast("int"), F.lit(0)) + 1) * 3
    fault = F.when(F.col("__lost"), NO_MARKER).when(F.size("__h") < 6, BAD_HEADER).when(F.size("__rows") != rows, BAD_ROWS)
    return out.select(
        "model_id",
        "file",
        fault.alias("fault"),
        "__h",
        F.coalesce(
            F.get(F.col("__flags"), F.size("__flags") - 1),
            F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]),
        ).alias("__f"),
        "__rows",
    )


def _sound(files: DataFrame, *faults: str) -> DataFrame:
    """The files, with an error for the first that has one of ``faults``."""
    raised = F.raise_error(F.concat(F.col("fault"), F.lit(": "), F.col("file"))).cast("array<array<double>>")
    return files.withColumn("__h", F.when(F.col("fault").isin(*faults), raised).otherwise(F.col("__h")))


def _value(line: int, pos: int) -> Column:
    return F.coalesce(F.get(F.get(F.col("__h"), F.lit(line)), F.lit(pos)), F.lit(0.0))


def read_harmonic_catalog(
    spark: SparkSession, path: str | Sequence[str], *, isolated_halo: bool = False, key_pattern: str = MODEL_FROM_FOLDER
) -> DataFrame:
    """Catalog row per file; the first disk may have five or seven numbers."""
    return _catalog(_sound(_parsed(spark, path, key_pattern), NO_MARKER, BAD_HEADER), isolated_halo)


def ingest_harmonics(
    spark: SparkSession, path: str | Sequence[str], *, isolated_halo: bool = False, key_pattern: str = MODEL_FROM_FOLDER
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, coefficient rows, faults) of many files, each parsed once.

    A broken file doesn't fail the job: it has a row (model_id, file, fault) among the faults and none in the other two.
    """
    files = materialise(_parsed(spark, path, key_pattern), "harmonic-files")
    sound = files.filter(F.col("fault").isNull())
    return _catalog(sound, isolated_halo), _coefficients(sound), files.filter(F.col("fault").isNotNull()).select("model_id", "file", "fault")


def _catalog(files: DataFrame, isolated_halo: bool) -> DataFrame:
    on = lambda i: F.col("__f")[i] != 0.0
    halo_on = F.lit(True) if isolated_halo else on(4)
    v = _value
    return files.select(
        "model_id",
        component("halo", r_outer=v(0, 0), v0=v(0, 1), a=v(0, 2), dr_trunc=12.0, cusp=1.0, enabled=halo_on).alias("halo"),
        component(
            "disk", mass=v(2, 0), scale_length=v(2, 1), outer_radius=v(2, 3), scale_height=v(2, 2),
            trunc_width=v(2, 4), hole_radius=v(2, 5), core_radius=v(2, 6), enabled=on(0),
        ).alias("disk"),
        component(
            "disk2", mass=v(3, 0), scale_length=v(3, 1), outer_radius=v(3, 3), scale_height=v(3, 2),
            trunc_width=v(3, 4), enabled=on(1),
        ).alias("disk2"),
        component(
            "gas", mass=v(4, 0), scale_length=v(4, 1), outer_radius=v(4, 2), z_scale=v(4, 3), trunc_width=v(4, 4),
            rz_scale=v(4, 5), z_max=v(4, 6), gamma=v(4, 7), enabled=on(2),
        ).alias("gas"),
        component("bulge", n_sersic=v(0, 3), ppp=0.0, v0=v(0, 4), a=v(0, 5), enabled=on(3)).alias("bulge"),
        component("black_hole", mass=v(5, 2), enabled=on(5)).alias("black_hole"),
        component("grid", dr=v(0, 6), nr=v(0, 7), lmax=v(0, 8)).alias("grid"),
        absent("kinematics").alias("kinematics"),
        v(1, 0).alias("psi0"),
        v(1, 1).alias("halo_const"),
        v(1, 2).alias("bulge_const"),
        v(5, 0).alias("psic"),
        (v(1, 0) - v(5, 1)).alias("psid"),
    )


def read_harmonics(
    spark: SparkSession, path: str | Sequence[str], *, key_pattern: str = MODEL_FROM_FOLDER
) -> DataFrame:
    """Long coefficient rows ``(model_id, l, ir, r, adens, apot, fr)``; a wrong row count is an error.

    Rows shorter than the number of orders are padded with zeros.
    """
    return _coefficients(_sound(_parsed(spark, path, key_pattern), NO_MARKER, BAD_HEADER, BAD_ROWS))


def _coefficients(files: DataFrame) -> DataFrame:
    files = files.select("model_id", _value(0, 7).cast("int").alias("__nr"), _value(0, 8).cast("int").alias("__lmax"), "__rows")
    shells = files.select(
        "model_id",
        "__lmax",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("__nr")),
                lambda i: F.struct(
                    i.alias("ir"),
                    F.get(F.col("__rows"), i).alias("a"),
                    F.get(F.col("__rows"), i + F.col("__nr") + 1).alias("p"),
                    F.get(F.col("__rows"), i + (F.col("__nr") + 1) * 2).alias("f"),
                ),
            )
        ).alias("s"),
    )
    orders = F.explode(F.sequence(F.lit(0), F.floor(F.col("__lmax") / 2).cast("int"))).alias("k")
    at = lambda name: F.coalesce(F.get(F.col(f"s.{name}"), F.col("k") + 1), F.lit(0.0))
    return shells.select("model_id", "s", orders).select(
        "model_id",
        (F.col("k") * 2).alias("l"),
        F.col("s.ir").alias("ir"),
        F.get(F.col("s.a"), F.lit(0)).alias("r"),
        at("a").alias("adens"),
        at("p").alias("apot"),
        at("f").alias("fr"),
    )
