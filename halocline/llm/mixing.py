"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a seeded order and form one stream of words, cut into blocks of equal
length; a second pass over the source follows the first.  Slots of the schedule are golden-ratio
points, mapped through the sources' cumulative targets, so any stretch of the schedule holds the sources
in proportion.  The k-th slot of a source takes its k-th block.  All of it is DataFrame work: sums per
(source, part of the order) replace windows over whole sources, so a source with most rows is split.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halocline.llm.frames import WORD_PATTERN, pick, word_count
from halocline.storage import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 128
# 2^31 divided by the golden ratio, made odd so that every point comes once in 2^31 slots (fixed value).
GOLDEN, POINTS = 1327217885, 1 << 31
CELLS = 4096
SLOTS_PER_PART = 4096
ORDER_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Targets by source from (source, source_size): (sid, source, source_size, target, low, high).

    Sources by code point, null last, weigh ``weights`` in turn.  A target stops at twice its source's
    size; with the sources in order of the level at which they fill up, the level of the rest is known in
    closed form, the same as resharing round by round.  ``low`` and ``high`` bound the source's points.
    """
    named = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(EPOCHS))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    total = F.sum("source_size").over(everyone) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    named = named.withColumn("level", level).withColumn("fills", F.col("level") * F.col("weight") >= F.col("cap"))
    # the first source that doesn't fill up sets the level of all from it on
    open_level = F.min(F.when(~F.col("fills"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level")))).over(everyone)
    named = named.withColumn("target", F.when(F.col("fills"), F.col("cap")).otherwise(open_level["level"] * F.col("weight")))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = F.sum("target").over(upto)
    whole = F.sum("target").over(everyone)
    named = named.withColumn("high", F.when(whole > 0, F.floor(cumulated / whole * POINTS)).otherwise(F.lit(0)).cast("long"))
    return named.select("sid", "source", "source_size", "target", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0)).alias("low"), "high")


def schedule(spark: SparkSession, targets: DataFrame, words: float, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, sid, block): which block of which source each slot takes; ``words`` is the sum of targets.

    It runs a little longer than the targets ask for; each source stops at its own target.  Sources that got fewer
    slots than their targets have blocks take further slots behind it, one for each missing block.
    """
    n = math.ceil(1.02 * words / block_words) + 64 if words else 0
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", (F.col("slot") % POINTS) * GOLDEN % POINTS)
    width = POINTS // CELLS
    cells = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    ranges = targets.where("high > low").select("sid", "low", "high", cells.alias("cell"))
    drawn = slots.withColumn("cell", F.floor(F.col("point") / width)).join(ranges, "cell").where("point >= low AND point < high")
    drawn = drawn.select("slot", "sid", F.floor(F.col("slot") / SLOTS_PER_PART).alias("part"))
    counts = drawn.groupBy("sid", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("sid", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot"))
    drawn = drawn.withColumn("inside", inside).join(before, ["sid", "part"]).select("slot", "sid", (F.col("before") + F.col("inside") - 1).alias("block"))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = targets.join(got, "sid", "left").select("sid", F.coalesce("got", F.lit(0)).alias("got"), F.ceil(F.floor("target") / block_words).alias("asked")).where("got < asked")
    ahead = F.coalesce(F.sum(F.col("asked") - F.col("got")).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = short.withColumn("ahead", ahead).withColumn("block", F.explode(F.sequence(F.col("got"), F.col("asked") - 1)))
    return drawn.union(short.select((F.col("ahead") + F.col("block") - F.col("got") + n).alias("slot"), "sid", "block"))


def _ordered(base: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's first word in its source's stream (``start``), and what its source may take."""
    rows = base.join(targets.select("sid", F.col("source").alias("named"), "source_size", "target"), F.col("source").eqNullSafe(F.col("named")))
    rows = rows.withColumn("part", F.substring("order", 1, ORDER_DIGITS))
    upto = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    sums = sums.select("sid", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("sid", "part").orderBy("order", "size")
    rows = rows.withColumn("nth", F.row_number().over(within))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(sums, ["sid", "part"]).withColumn("start", F.col("before") + F.col("inside"))
    return rows.withColumn("most", F.floor("target")).drop("named", "inside", "before")


def _base(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, h, source, size, order) of all rows, texts left behind; stored, as three steps read it."""
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return materialise(docs.select("doc_id", F.xxhash64("text").alias("h"), "source", word_count(F.col("text")).alias("size"), order.alias("order")), "mix-rows")


def mix_pieces(docs: DataFrame, seed: int = 23, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes, one row per document and piece; documents not taken have one row without words.

    ``slot`` is the place in the schedule, ``first`` and ``words`` the stretch of the document's words.
    A null text has no words; null sources form one source; equal rows count as often as they come; an
    empty table gives no rows.  Documents of one order key (equal doc_id) stand by size.
    """
    base = _base(pick(docs, "doc_id", "source", "text"), seed)
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes), "mix-targets")
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = schedule(base.sparkSession, targets, words, block_words)
    rows = _ordered(base, targets)
    passes = F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)]))
    rows = rows.withColumn("epoch", passes).withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size"))
    rows = rows.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("most")))
    spans = F.when(F.col("end") > F.col("at"), F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("end") - 1) / block_words)))
    rows = rows.withColumn("block", F.explode_outer(spans))
    joined = rows.join(slots, ["sid", "block"], "left")
    first = F.greatest(F.col("at"), F.col("block") * block_words)
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    taken = F.when(F.col("slot").isNotNull(), last - first).otherwise(F.lit(0))
    return joined.select(
        "doc_id", "sid", "part", "nth", "source", "size", "source_size", "target", "slot", "epoch", (first - F.col("at")).alias("first"), taken.alias("words")
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document: how many of its words the mix takes, repeats counted."""
    keys = ["sid", "part", "nth", "doc_id", "size", "source_size", "target"]
    taken = mix_pieces(docs).groupBy(*keys).agg(F.sum("words").alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: int = 23) -> DataFrame:
    """``docs`` as the mix holds them: a row once for each pass whose schedule reaches its first word.

    All columns are kept.  Rows with equal doc_id and text come equally often, as often as the one of them
    that comes most.
    """
    base = _base(pick(docs, "doc_id", "source", "text"), seed)
    targets = materialise(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = schedule(base.sparkSession, targets, words).groupBy("sid").agg(F.count("*").alias("blocks"))
    rows = _ordered(base, targets).join(slots, "sid", "left")
    reach = F.least(F.col("most"), F.coalesce(F.col("blocks"), F.lit(0)) * BLOCK_WORDS)
    times = sum(((F.col("start") + e * F.col("source_size")) < reach).cast("int") for e in range(EPOCHS))
    times = rows.groupBy("doc_id", "h").agg(F.max(times).alias("times")).where("times > 0")
    at = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*at)
    key, text = f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"
    wide = wide.withColumn("h", F.xxhash64(text))
    kept = wide.join(times.withColumnRenamed("doc_id", "named").withColumnRenamed("h", "hashed"), F.col(key).eqNullSafe(F.col("named")) & (F.col("h") == F.col("hashed")))
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return kept.select(*at).toDF(*docs.columns)


MIX_SQL = f"""
WITH base AS (SELECT doc_id, source, md5('23/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
    CAST(coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM sizes),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 2e0 AS cap FROM named),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5e0
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
opened AS (SELECT arg_min(level, (cap / weight, sid)) AS level FROM levels WHERE level * weight < cap),
aimed AS (SELECT sid, source, source_size,
    CASE WHEN level * weight >= cap THEN cap ELSE (SELECT level FROM opened) * weight END AS target FROM levels),
ranged AS (SELECT *, CASE WHEN sum(target) OVER () > 0 THEN CAST(floor(sum(target) OVER (ORDER BY sid) / sum(target) OVER () * {POINTS}e0) AS BIGINT) ELSE 0 END AS high FROM aimed),
bounds AS (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM ranged),
slots AS (SELECT i AS slot, i % {POINTS} * {GOLDEN} % {POINTS} AS point
    FROM range((SELECT CAST(ceil(1.02e0 * sum(target) / {BLOCK_WORDS}) AS BIGINT) + 64 FROM aimed)) r(i)),
drawn AS (SELECT sid, count(*) AS got FROM slots JOIN bounds ON point >= low AND point < high GROUP BY sid),
filled AS (SELECT sid, unnest(range(greatest(coalesce(got, 0), CAST(ceil(floor(target) / {BLOCK_WORDS}e0) AS BIGINT)))) AS block FROM aimed LEFT JOIN drawn USING (sid)),
placed AS (SELECT b.doc_id, b.size, a.sid, a.source_size, a.target, row_number() OVER (ORDER BY a.sid, ord, size) AS nth,
    coalesce(sum(size) OVER (PARTITION BY a.sid ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM base b JOIN aimed a ON b.source IS NOT DISTINCT FROM a.source),
passed AS (SELECT *, start + epoch * source_size AS pos, least(start + epoch * source_size + size, floor(target)) AS stop FROM placed, range(2) e(epoch)),
cut AS (SELECT *, unnest(CASE WHEN stop > pos THEN range(CAST(floor(pos / {BLOCK_WORDS}) AS BIGINT), CAST(floor((stop - 1) / {BLOCK_WORDS}) AS BIGINT) + 1) ELSE [CAST(-1 AS BIGINT)] END) AS block FROM passed)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN r.block IS NULL THEN 0
    ELSE least(stop, (c.block + 1) * {BLOCK_WORDS}) - greatest(pos, c.block * {BLOCK_WORDS}) END) AS BIGINT) AS taken
FROM cut c LEFT JOIN filled r ON c.sid = r.sid AND c.block = r.block GROUP BY nth, doc_id, size, source_size, target
"""
