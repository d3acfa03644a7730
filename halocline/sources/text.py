"""Numeric text tables: particles, observed curves, potential grids."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.operators.keys import lookup_join
from halocline.operators.ordering import first_in_order
from halocline.storage import filesystem, materialise

PARTICLE_COLUMNS = ("mass", "x", "y", "z", "vx", "vy", "vz")

# Fixed value: what counts as a number in these files.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]|[nN][aA][nN])$"

# Component files of a model folder, in loading order; the
# external halo comes last and takes the place of the sampled one.
COMPONENT_FILES = {"disk": "disk", "halo": "halo", "bulge": "bulge", "gasdisk": "gasdisk", "Xhalo": "halo"}


def tokens(line: Column) -> Column:
    """Whitespace-separated tokens of a line."""
    return F.filter(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), lambda t: t != "")


def numbers(line: Column) -> Column:
    """The line's numbers, or an empty array when any token is not a number."""
    toks = tokens(line)
    ok = F.forall(toks, lambda t: t.rlike(NUMBER))
    return F.when(ok, F.transform(toks, lambda t: t.try_cast("double"))).otherwise(
        F.array().cast("array<double>")
    )


def without_comment(line: Column) -> Column:
    """Everything before the first ``#``."""
    return F.substring_index(line, "#", 1)


def uncommented(line: Column) -> Column:
    """The line without a leading ``#``."""
    return F.trim(F.regexp_replace(F.trim(line), r"^#", ""))


def _leading_numbers(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of ``lines`` whose ``line`` is all numbers, and enough of them, with the first as columns.

    Most lines are decided by casts alone.  A cast is more generous than the token
    pattern only where there is a type suffix, hexadecimal or a spelled-out value, so
    the pattern is tried only on lines with one of their letters.  The row is made by a
    generator: a filter would be pushed below the split and repeat it.
    """
    width = len(names)
    plain = F.lit(True)
    for letter in "dDfFxXnNiI":
        plain = plain & ~F.col("line").contains(letter)
    rows = lines.select("*", plain.alias("__plain"), F.split(F.btrim("line", F.lit(" \t\r\n\f")), r"\s+").alias("__t"))
    toks = F.col("__t")
    values = F.struct(*[F.get(toks, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])
    rest = F.slice(toks, width + 1, 1 << 30)
    sound = (F.size(toks) == width) | F.forall(rest, lambda t: t.try_cast("double").isNotNull())
    sound = sound & (F.col("__plain") | F.forall(toks, lambda t: t.rlike(NUMBER)))
    row = F.when((F.size(toks) >= width) & sound, F.array(values))
    kept = [c for c in lines.columns if c != "line"]
    out = rows.select(*kept, F.inline_outer(row))
    for n in names:
        out = out.filter(F.col(n).isNotNull())
    return out


SPLIT, LINE = "__split", "__line"


def lines_in_place(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines ``value`` with their ``file``, the byte their split of it begins at, and a number that ascends in the split.

    A split is read front to back by one task, and files are split like those of any Spark text source; (file, split, line) is the order of
    lines in the file, however it is split.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias(SPLIT),
        F.monotonically_increasing_id().alias(LINE),
        "value",
    )


def scan_particles(
    spark: SparkSession, path: str | Sequence[str], component: str | None = None, *, first: int | None = None
) -> DataFrame:
    """Particle rows of text files or folders, with the file they came from.

    Text after ``#`` is cut, rows need at least seven numbers and use the first
    seven; short rows, and with them the two-number count header, are dropped.
    ``first`` keeps that many particles of every file, those that come first in it.
    """
    if first is None:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    else:
        lines = lines_in_place(spark, path)
    kept = [c for c in lines.columns if c != "value"]
    out = _leading_numbers(lines.select(*kept, without_comment(F.col("value")).alias("line")), PARTICLE_COLUMNS)
    if first is not None:
        out = first_in_order(out, [SPLIT, LINE], F.lit(first), group_cols=["file"]).drop(SPLIT, LINE)
    return out if component is None else out.withColumn("component", F.lit(component))


def load_components(
    spark: SparkSession, path: str, files: Mapping[str, str] = COMPONENT_FILES
) -> DataFrame:
    """Component files found under ``path`` (globs allowed), tagged by file name.

    Where two files give the same component in one folder, the later entry of
    ``files`` replaces the earlier one.
    """
    at = f"{path}/{{{','.join(files)}}}*"
    known = list(files)

    def tagged(rows: DataFrame) -> DataFrame:
        # a component may be one text file or a folder of part files
        last, pair = F.substring_index("file", "/", -1), F.substring_index("file", "/", -2)
        parent = F.substring_index(pair, "/", 1)
        name = F.when(last.isin(known), last).when(parent.isin(known), parent)
        tail = F.when(last.isin(known), last).otherwise(pair)
        folder = F.substring(F.col("file"), F.lit(1), F.length("file") - F.length(tail) - 1)
        component, order = F.lit(None).cast("string"), F.lit(None).cast("int")
        for i, (source, comp) in enumerate(files.items()):
            component = F.when(name == source, comp).otherwise(component)
            order = F.when(name == source, i).otherwise(order)
        out = rows.withColumns({"folder": folder, "component": component, "__order": order})
        return out.filter(F.col("__order").isNotNull())

    # a listing without contents decides which sources count: at most len(files) rows per folder, stored so that the join knows its size
    listed = tagged(spark.read.format("binaryFile").load(at).select(F.col("_metadata.file_path").alias("file")))
    best = listed.groupBy("folder", "component").agg(F.max("__order").alias("__order"))
    chosen = listed.join(best, ["folder", "component", "__order"], "left_semi").select("file", "folder", "component")
    chosen = materialise(chosen, "component-files")
    # names are told apart once for each file, and lines of files that don't count aren't parsed
    lines = spark.read.text(at).select(F.col("_metadata.file_path").alias("file"), without_comment(F.col("value")).alias("line"))
    kept = _leading_numbers(lookup_join(lines, chosen, ["file"], null_safe=False), PARTICLE_COLUMNS)
    return kept.select("folder", "component", *PARTICLE_COLUMNS)


def scan_rotation_curve(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Observed curves ``R_kpc, V_kms, sigma_kms``: rows with at least three tokens.

    A row whose first three tokens are not numbers is an error.
    """
    toks = tokens(F.col("value"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), toks.alias("t"))
    names = ("R_kpc", "V_kms", "sigma_kms")
    return lines.filter(F.size("t") >= 3).select(
        "file", *[F.col("t")[i].cast("double").alias(n) for i, n in enumerate(names)]
    )


GRID_COLUMNS = ("r", "z", "psi", "f_r", "f_z")
# what a line is to the blocks of a file
ROW, BLANK = 1, 0


def _numbered_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks begun so far in each line's split, by rows that follow a blank line of it; ``open``: still the first block.

    The first rows of a split may go on with the block that the split before ends in.
    """
    where, begun, last = None, 0, None  # last: the latest line that counts, a row or a blank
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        split = list(zip(batch.column("file").to_pylist(), batch.column(SPLIT).to_pylist()))
        kinds = batch.column("kind").to_numpy()
        blocks, opens = np.empty(n, np.int64), np.empty(n, bool)
        for i, (here, kind) in enumerate(zip(split, kinds)):
            if here != where:
                where, begun, last = here, 0, None
            if kind == ROW and last == BLANK:
                begun += 1
            last = kind
            blocks[i], opens[i] = begun, begun == 0
        extra = [pa.array(blocks), pa.array(opens)]
        names = [*batch.schema.names, "block", "open"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)


def scan_potential_grid(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows ``(file, block, r, z, psi, f_r, f_z)`` of grids whose blocks are parted by blank lines.

    Rows have at least five numbers; other lines neither count nor part blocks, and blank lines without rows
    between them part blocks once.  A block may run over any number of splits: each split counts the blocks that begin in it, and a table with one
    row for each split tells how many began before and whether its first rows go on with one of them.
    """
    lines = lines_in_place(spark, path)
    blank = F.length(F.btrim("value", F.lit(" \t\r\n\f\x0b"))) == 0
    lines = lines.withColumn("v", F.when(~blank, numbers(F.col("value")))).drop("value")
    lines = lines.filter(F.col("v").isNull() | (F.size("v") >= len(GRID_COLUMNS)))
    values = [F.get("v", F.lit(i)).alias(n) for i, n in enumerate(GRID_COLUMNS)]
    lines = lines.select("file", SPLIT, LINE, F.when(F.col("v").isNull(), BLANK).otherwise(ROW).alias("kind"), *values)
    schema = T.StructType([*lines.schema.fields, T.StructField("block", T.LongType()), T.StructField("open", T.BooleanType())])
    stored = materialise(lines.mapInArrow(_numbered_blocks, schema), "grid-lines")

    row = F.col("kind") == ROW
    splits = stored.groupBy("file", SPLIT).agg(
        F.max(F.when(row, F.col("block"))).alias("begun"),
        F.max(F.when(row, F.col("open"))).alias("open"),
        F.max_by("kind", LINE).alias("ends"),
    )
    # a file has as many rows here as it has splits
    order = Window.partitionBy("file").orderBy(SPLIT)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # rows of a split that come before any blank line open a block unless the line before them, splits back, is a row
    opens = F.coalesce(F.col("open"), F.lit(False)) & (F.coalesce(F.lag("ends").over(order), F.lit(BLANK)) == BLANK)
    splits = splits.withColumn("opens", opens.cast("long"))
    splits = splits.withColumn("began", F.coalesce(F.sum(F.coalesce("begun", F.lit(0)) + F.col("opens")).over(before), F.lit(0)))
    rows = lookup_join(stored.filter(row), splits.select("file", SPLIT, "opens", "began"), ["file", SPLIT], null_safe=False)
    block = F.col("began") + F.col("opens") + F.col("block") - 1
    return rows.select("file", block.cast("int").alias("block"), *GRID_COLUMNS)


# ---- sinks -------------------------------------------------------------------

BITS = 10  # of a coordinate in the order of places


def place_code(pos: Sequence[str], scale: float) -> Column:
    """Number of a point along a Z-shaped curve through space: near points mostly have near numbers.

    Coordinates are squeezed to a finite range by their arc tangent over ``scale``, so no extent has to be known; null counts as the origin.
    """
    bits = []
    for axis, c in enumerate(pos):
        share = F.atan(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / scale) / math.pi + 0.5
        cell = F.least(F.floor(share * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
        bits += [F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long")), b * len(pos) + axis) for b in range(BITS)]
    return sum(bits[1:], bits[0])


def write_particles(
    df: DataFrame,
    path: str,
    *,
    component_col: str = "component",
    mode: str = "errorifexists",
    pos: Sequence[str] = ("x", "y", "z"),
    scale: float = 10.0,
    rows_per_page: int = 1024,
) -> None:
    """Parquet partitioned by component, so a component is read without touching the others, and laid out by place within it.

    One exchange by range of (component, place) gives every file a region of space, and sorted pages narrow ranges of the coordinates, so
    spatial filters skip files, row groups and pages.
    """
    code = "__place"
    rows = df.withColumn(code, place_code(pos, scale))
    rows = rows.repartitionByRange(component_col, code).sortWithinPartitions(component_col, code).drop(code)
    rows.write.mode(mode).option("parquet.page.row.count.limit", rows_per_page).partitionBy(component_col).parquet(path)


def particle_line(cols: Sequence[str] = PARTICLE_COLUMNS) -> Column:
    """One fixed-width text line (12.5E) of the particle columns."""
    return F.format_string(" ".join(["%12.5E"] * len(cols)), *[F.col(c) for c in cols])


def write_particle_text(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.select(particle_line().alias("value")).write.mode(mode).text(path)


# Fixed value: Spark's folder name of a null key.
NULL_KEY = "__HIVE_DEFAULT_PARTITION__"


def write_keyed_text(lines: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], *, line: str = "line") -> None:
    """One text file for each value of ``keys``, in folders ``key=value``, with its lines in order.

    Lines are sorted and tasks write each file as its lines pass by, so that no file is held whole; a partitioned write of Spark's spends many times
    longer on opening very many small files than on their lines.  A task that runs again writes the same files anew.
    Keys are numbers or plain names.
    """
    value = lambda k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(NULL_KEY))
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), value(k)) for k in keys])
    fs, at = filesystem(path)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(path)
        current, out, empty, files = None, None, False, 0
        for batch in batches:
            for name, rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), itemgetter(0)):
                if name != current:
                    if out:
                        out.write(b"\n" * empty)
                        out.close()
                    fs.create_dir(f"{at}/{name}", recursive=True)
                    current, out, empty, files = name, fs.open_output_stream(f"{at}/{name}/part-0.txt"), True, files + 1
                data = "".join([f"{text}\n" for _, text in rows if text is not None])
                out.write(data.encode())
                empty = empty and not data
        if out:
            out.write(b"\n" * empty)
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    # a set number of tasks, as Spark would merge those of few bytes but many files
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select(folder.alias("__folder"), *order, F.col(line).alias("__line")).repartition(tasks, "__folder")
    rows.sortWithinPartitions("__folder", *order, "__line").select("__folder", "__line").mapInArrow(write, "files long").agg(F.sum("files")).first()


def write_curve_table(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Profiles and curves as parquet or headed csv."""
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)
