"""Shards by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets that fit in memory.  Pass two sorts each
bucket, so that the outcome doesn't depend on the order of arrival, and shuffles it by Fisher-Yates.
The buckets' running counts turn positions into one gapless order of all records, which is dealt
over the shards in turn: the law of the shards is ``rows``, their counts are at most one apart.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from halocline.llm.frames import pick, utf8_size
from halocline.storage import materialise

RECORD_BYTES = 16
BUCKET_BYTES = 8 << 20
COUNTS_PER_BLOCK = 1024


def _fisher_yates(n: int, seed: int) -> np.ndarray:
    """A random order of n records; numpy's permutation is the Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def _bucket_starts(counts: DataFrame) -> DataFrame:
    """(bucket, before): records in smaller buckets, by sums over blocks of buckets."""
    blocks = counts.withColumn("block", F.floor(F.col("bucket") / COUNTS_PER_BLOCK))
    totals = blocks.groupBy("block").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = blocks.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return within.join(starts, "block").select("bucket", (F.col("start") + F.col("inside")).alias("before"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Equal rows are told apart by the input partition they come from, so even a row repeated without end is
    scattered; null doc_id or text hash like any value; an empty table gives no rows.  Columns of the
    input that are called ``shard`` or ``slot`` in any case are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("shard", "slot")]
    names = [docs.columns[i] for i in kept]
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in kept])
    key, text = f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"
    rows = rows.withColumn("tie", F.xxhash64(F.lit(seed + 1), key, text))
    total = rows.agg(F.sum(utf8_size(F.col(text)) + RECORD_BYTES).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    spread = F.xxhash64(F.lit(seed), key, "tie", F.spark_partition_id())
    stored = materialise(rows.withColumn("bucket", F.pmod(spread, F.lit(buckets))), "scattered")
    starts = _bucket_starts(stored.groupBy("bucket").agg(F.count("*").alias("n")))
    schema = T.StructType([*[f for f in stored.schema.fields if f.name not in ("tie", "bucket")], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle(table: pa.Table) -> pa.Table:
        bucket, before = table["bucket"][0].as_py(), table["before"][0].as_py()
        table = table.sort_by([("tie", "ascending"), (key, "ascending")])
        order = before + np.arange(table.num_rows)
        dealt = table.take(pa.array(_fisher_yates(table.num_rows, zlib.crc32(f"{seed}/{bucket}".encode()))))
        dealt = dealt.append_column("shard", pa.array((order % shards).astype(np.int32)))
        dealt = dealt.append_column("slot", pa.array(order // shards))
        return dealt.select([f.name for f in schema.fields])

    out = stored.join(starts, "bucket").groupBy("bucket").applyInArrow(shuffle, schema)
    return out.toDF(*names, "shard", "slot")


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: its size, checksum and place, for checking the law of the shards."""
    placed = shard_documents(pick(docs, "doc_id", "text"), shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id",
        (utf8_size(F.col("text")) + RECORD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
