"""Small helpers the operators of this package share."""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The separators between words, in SQL and for bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling.

    A table may hold further columns, also ones that differ only in case or repeat a name; the
    first column of each exact name counts.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one buffer, and the offsets of its values (nulls are empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser, fixed constants)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer used.

    Spark removes them when the driver's garbage collector finds their owner gone, which a driver
    with little to do may put off until the disks of the executors are full.  The end of a query reaches
    Spark's listeners, which hold it too, a moment after its result; hence the pauses.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text in DuckDB, bit by bit (3988292384 is the reflected polynomial, a fixed value)."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT for c in regexp_extract_all({text}, '.')]), lambda r, b: "
        "list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    )
