"""Shared scratch storage: where lineage is cut and intermediate tables live.

A cluster names its shared folder in ``spark.checkpoint.dir``.  Tables written
there survive the loss of any executor, and reading them back gives the planner
their true size, so Spark itself decides whether a join may broadcast them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

# private folders of local sessions; removed when the interpreter ends
_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; a private one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.TemporaryDirectory(prefix="halocline-")
    return _local_dirs[sc.applicationId].name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has used before."""
    return f"{shared_dir(spark)}/halocline/{name}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, for tasks that write files themselves, and the path there."""
    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path.removeprefix('file:').lstrip('/')}")


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder (at ``path``, if given) and read it back."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`materialise` wrote, once nothing reads it any more."""
    if f"{shared_dir(spark)}/halocline/" not in path:
        raise ValueError(f"{path} is not one of the library's own tables")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
