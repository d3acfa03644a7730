"""Files of very many run folders, listed and read by tasks.

Spark's own text source lists on the driver, which holds every file for each reader and plans a piece of
a task for it.  Here tasks walk the folders, the list is a table, and tasks open the files of its rows.  What
a path means is what it means to Spark's source: globs, hidden and empty files, folders ``key=value``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.storage import filesystem, materialise, scratch_path

# A task goes into so many folders below one that it was given; others are dealt out anew.
LISTINGS = 256
# What a task hands on at once.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20

# Of a file, or of a folder yet to be listed, whose length is null: ``step`` counts up to 0 at what the path ``of`` names, ``keys`` are names of ``key=value`` folders below it.
ROWS = "path string, length bigint, step int, of int, keys string"
# Endings of files that Spark unpacks and Arrow doesn't, and what Java leaves as it is in the path of a URI.
PACKED, PLAIN = r"\.(deflate|lz4|snappy)$", "/_-!.~'()*:@&=+$,;"


class Listing(NamedTuple):
    files: DataFrame  # path, length
    count: int
    bytes: int
    packed: bool  # some have to be unpacked by Spark


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _split(path: str) -> tuple[str, str]:
    """``file:/a/b`` to (``file:``, ``/a/b``), ``hdfs://host/a`` to (``hdfs://host``, ``/a``)."""
    scheme, _, rest = path.partition(":")
    if not rest.startswith("//"):
        return f"{scheme}:", rest
    host, slash, tail = rest[2:].partition("/")
    return f"{scheme}://{host}", slash + tail


def _at(path: str, opened: dict[str, tuple[FileSystem, str]]) -> tuple[FileSystem, str]:
    """The file system of a qualified path, and the path there."""
    base, tail = _split(path)
    if base not in opened:
        opened[base] = filesystem(f"{base}/")
    fs, root = opened[base]
    return fs, root.rstrip("/") + tail or "/"


def _url(path: str) -> str:
    """The path as Spark's ``_metadata.file_path`` gives it."""
    base, tail = _split(path)
    return base + "".join(c if ord(c) > 127 and c.isprintable() else quote(c, safe=PLAIN) for c in tail)


def _patterns(spark: SparkSession, path: str) -> list[tuple[str, list[tuple[str, bool]]]]:
    """(where to begin, parts of the path below as (name, is no pattern)) for each path without slashes in braces."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    given = hadoop.Path(path)
    fs = given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    base, tail = _split(given.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
    if not set(tail) & set("{}[]*?\\"):
        return [(base, [(tail.strip("/"), True)])]
    found = []
    for one in hadoop.GlobExpander.expand(tail):
        parts: list[tuple[str, bool]] = []
        for part in one.strip("/").split("/"):
            glob = hadoop.GlobPattern(part)
            if glob.hasWildcard():
                parts.append((glob.compiled().pattern(), False))
                continue
            name = re.sub(r"\\(.)", r"\1", part)
            if parts and parts[-1][1]:
                name = f"{parts.pop()[0]}/{name}"
            parts.append((name, True))
        found.append((base, parts))
    return found


def _walker(parts: list[list[tuple[str, bool]]]):
    """A function over batches of :data:`ROWS` of folders that gives the files in them, and folders that it left."""

    def entries(row: tuple, opened: dict) -> Iterator[tuple]:
        """(path, length or null, step, of, keys) of what the folder ``row`` leads to."""
        path, _, step, of, keys = row
        fs, at = _at(path, opened)
        if step < 0 and parts[of][step][1]:
            below = f"{path}/{parts[of][step][0]}"
            seen = [(below, fs.get_file_info(_at(below, opened)[1]))]
        else:
            seen = [(f"{path}/{i.base_name}", i) for i in fs.get_file_info(FileSelector(at, allow_not_found=True))]
            if step < 0:
                match = re.compile(parts[of][step][0], re.S).fullmatch
                seen = [x for x in seen if match(x[1].base_name)]
            else:
                seen = [x for x in seen if not _hidden(x[1].base_name)]
        for below, info in seen:
            if info.type == FileType.Directory:
                key, is_key, _ = info.base_name.partition("=")
                yield below, None, step + 1, of, f"{keys}/{key}" if is_key and step >= 0 else keys
            elif info.type == FileType.File and step >= -1 and not _hidden(info.base_name):
                yield below, info.size, max(step, 0), of, keys

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        out: list[tuple] = []
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                todo, left = [row], LISTINGS
                while todo:
                    left -= 1
                    for entry in entries(todo.pop(), opened):
                        if entry[1] is None and len(todo) < left:
                            todo.append(entry)
                            continue
                        out.append(entry)
                        if len(out) == BATCH_ROWS:
                            yield _batch(out, schema)
                            out = []
        if out:
            yield _batch(out, schema)

    return walk


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=schema.names)


def list_files(spark: SparkSession, path: str | Sequence[str]) -> Listing | None:
    """The files that Spark's text source would read, as a table in the shared folder that tasks have written.

    Folders are listed level by level, each by one task, which goes on into the first few below it.  The driver sees one row of sums a
    level.  Null where only Spark's source will do: file systems Arrow doesn't know, no files at all, folders it can't tell the partitions of.
    """
    paths = [path] if isinstance(path, str) else list(path)
    patterns = [(i, *p) for i, one in enumerate(paths) for p in _patterns(spark, one)]
    try:
        for _, base, _ in patterns:
            filesystem(f"{base}/")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    walk = _walker([parts for _, _, parts in patterns])
    seeds = [(base, None, -len(parts), i, "") for i, (_, base, parts) in enumerate(patterns)]
    todo = spark.createDataFrame(seeds, ROWS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels, sums = [], []
    while True:
        levels.append(scratch_path(spark, "listing"))
        level = materialise(todo.mapInArrow(walk, ROWS), "listing", levels[-1])
        file, full, direct = F.col("length").isNotNull(), F.col("length") > 0, F.col("step") == 0
        size = lambda which: F.coalesce(F.sum(F.when(which, F.col("length"))), F.lit(0))
        below = F.when(file & ~direct, F.col("keys"))
        sums.append(
            level.agg(
                F.count_if(~file).alias("folders"),
                F.array(F.count_if(full & direct), size(direct)).alias("direct"),
                F.array(F.count_if(full & ~direct), size(~direct)).alias("deep"),
                F.min(below).alias("least"),
                F.max(below).alias("most"),
                F.coalesce(F.max(file & F.col("path").rlike(PACKED)), F.lit(False)).alias("packed"),
                F.collect_set("of").alias("of"),
            ).first()
        )
        if not (folders := sums[-1].folders):
            break
        todo = level.filter(~file).repartition(min(tasks, -(-folders // LISTINGS)), "path")

    keys = {k for s in sums for k in (s.least, s.most) if k is not None}
    if len(keys) > 1 or {patterns[i][0] for s in sums for i in s.of} != set(range(len(paths))):
        return None
    # files beside folders with keys don't count, and without keys those below don't
    (count, size), (others, _) = ([sum(x) for x in zip(*(s[name] for s in sums))] for name in (("deep", "direct") if any(keys) else ("direct", "deep")))
    if not count or others and any(keys) and (len(patterns) > 1 or len(patterns[0][2]) > 1):
        return None
    files = spark.read.schema(ROWS).parquet(*levels).filter(F.col("length") > 0)
    if others:
        files = files.filter(F.col("step") > 0 if any(keys) else F.col("step") == 0)
    files = files.select("path", "length")
    if any(keys) and len(patterns) > 1:
        files = files.distinct()
    return Listing(files, count, size, any(s.packed for s in sums))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: dict = {}
    names, values, size = [], [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "value": pa.array(values, pa.binary())})

    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = _at(path, opened)
            with fs.open_input_stream(at) as stream:
                names.append(_url(path))
                values.append(stream.read())
            size += len(values[-1])
            if len(names) == BATCH_ROWS or size >= BATCH_BYTES:
                yield done()
                names, values, size = [], [], 0
    if names:
        yield done()


def whole_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, value) of every file under ``path``, each one row, like Spark's text source with ``wholetext``."""
    found = list_files(spark, path)
    if found is None or found.packed:
        return spark.read.text(path if isinstance(path, str) else list(path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    # as many tasks as Spark's source would take
    conf = spark._jsparkSession.sessionState().conf()
    cost = max(conf.filesOpenCostInBytes(), 1)
    total = found.bytes + found.count * cost
    tasks = max(math.ceil(total / conf.filesMaxPartitionBytes()), min(spark.sparkContext.defaultParallelism, math.ceil(total / cost)))
    rows = found.files.select("path").repartition(min(tasks, found.count), "path").mapInArrow(_contents, "file string, value binary")
    return rows.select("file", F.col("value").cast("string").alias("value"))
