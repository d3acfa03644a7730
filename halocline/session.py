"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Fixed value: longest method in bytes that the JVM compiles.
JIT_METHOD_LIMIT = 8000

SETTINGS = {
    # A span whose generated method is too long for the JIT compiler runs interpreted, ten
    # times slower.  Above this limit Spark runs it operator by operator with split methods.
    "spark.sql.codegen.hugeMethodLimit": str(JIT_METHOD_LIMIT),
    # Splitting a skewed partition is worth an extra shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Run folders are very many files of some kilobytes: a task may read a few hundred of them, and list a few hundred folders.
    "spark.sql.files.openCostInBytes": str(1 << 16),
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}
DEFAULTS = {
    "spark.sql.codegen.hugeMethodLimit": "65535",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    "spark.sql.files.openCostInBytes": str(4 << 20),
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` where the session still has Spark's defaults."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key) in (DEFAULTS[key], f"{DEFAULTS[key]}b"):
            spark.conf.set(key, value)
    return spark
