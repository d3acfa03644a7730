"""URL verdicts by rules, and by a Bloom filter cascade where no rule fits.

Hosts on a list are encoded exactly: level one holds the listed keys, level two the unlisted keys that
level one takes for listed, level three the listed keys that level two takes for unlisted, and so on until no
key of the universe is mistaken.  The universe is every key of the corpus, so a lookup needs no join:
a key is listed when the first level that denies it is an even one.  Keys are dealt by hash into parts of bounded
size, each with a cascade of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.frames import mix64, pick
from halocline.storage import materialise

# The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Words of a host's labels that put it on the list (fixed values).
LISTED_WORDS = ("adult", "bets", "casino", "pills", "porn", "loans", "spam", "warez")
KEYS_PER_PART = 200_000
MAX_LEVELS = 64
BROADCAST_BYTES = 64 << 20
CASCADE = "part int, level int, bits binary, hashes int"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def listed_hosts(keys: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """The keys one of whose dot- or dash-separated parts is a listed word."""
    return keys.where(F.arrays_overlap(F.split("key", "[.-]"), F.array(*[F.lit(w) for w in words])))


def _size(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hashes of a filter for n keys."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return (bits + 63) // 64 * 64, max(1, round(-math.log2(rate)))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """Bit numbers of each key in one level; every level hashes anew."""
    with np.errstate(over="ignore"):
        a, b = mix64(h1 + np.uint64(level)), mix64(h2 ^ np.uint64(level * 0x9E3779B9)) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)])


def _holds(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def _build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[bytes, int]]:
    """The levels of one part: (bits, hashes)."""
    inside, outside, levels = listed, ~listed, []
    while inside.any():
        if len(levels) == MAX_LEVELS:
            raise ValueError("two keys, one of them listed, agree in 128 bits of hash")
        n, out = int(inside.sum()), int(outside.sum())
        rate = min(0.5, max(2**-20, math.sqrt(0.5) * n / max(out, 1))) if not levels else 0.5
        m, k = _size(n, rate)
        bits = np.zeros(m // 8, np.uint8)
        at = _places(h1[inside], h2[inside], len(levels), k, m).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        levels.append((bits.tobytes(), k))
        mistaken = outside.copy()
        mistaken[outside] = _holds(bits, _places(h1[outside], h2[outside], len(levels) - 1, k, m)) if out else False
        inside, outside = mistaken, inside
    return levels


def _cascade(table: pa.Table) -> pa.Table:
    part = table["part"][0].as_py()
    h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    levels = _build(h1, h2, table["listed"].to_numpy(zero_copy_only=False))
    rows = [{"part": part, "level": i, "bits": b, "hashes": k} for i, (b, k) in enumerate(levels)]
    return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("level", pa.int32()), ("bits", pa.binary()), ("hashes", pa.int32())]))


def _hashes(df: DataFrame, parts: int) -> DataFrame:
    df = df.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit(7), "key"))
    return df.withColumn("part", F.pmod(F.xxhash64("h2", "h1"), F.lit(parts)).cast("int"))


def build_cascade(universe: DataFrame, listed: DataFrame, keys_per_part: int = KEYS_PER_PART) -> tuple[DataFrame, int]:
    """Cascades of the distinct ``key`` values of ``universe`` and those in ``listed``, and the number of parts.

    Null keys are left out; a listed key that isn't in the universe joins it.
    """
    marked = universe.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True).alias("listed")))
    keys = materialise(marked.where("key IS NOT NULL").groupBy("key").agg(F.bool_or("listed").alias("listed")), "url-keys")
    parts = max(1, math.ceil(keys.count() / keys_per_part))
    hashed = _hashes(keys, parts).select("part", "h1", "h2", "listed")
    return materialise(hashed.groupBy("part").applyInArrow(_cascade, CASCADE), "url-cascade"), parts


def listed_by_cascade(df: DataFrame, cascade: DataFrame, parts: int, column: str = "listed") -> DataFrame:
    """``df`` with a boolean column: whether its ``key``, one of the universe, is listed; a null key isn't.

    The cascades go to the tasks in groups of parts whose bits are within ``BROADCAST_BYTES``; with more
    parts, each group of parts filters the rows that fall into it.
    """
    weights = cascade.groupBy("part").agg(F.sum(F.octet_length("bits")).alias("n")).orderBy("part").toLocalIterator()
    groups: list[tuple[int, int]] = []  # first part and bytes of each group
    for row in weights:
        if not groups or groups[-1][1] + row["n"] > BROADCAST_BYTES:
            groups.append((row["part"], 0))
        groups[-1] = (groups[-1][0], groups[-1][1] + row["n"])
    bounds = [0, *[first for first, _ in groups[1:]], parts]
    rows = _hashes(df, parts)
    pieces = []
    for low, high in zip(bounds, bounds[1:]):
        own = cascade.where(F.col("part").between(low, high - 1)).orderBy("part", "level").collect()
        levels: dict[int, list[tuple[bytes, int]]] = {}
        for r in own:
            levels.setdefault(r["part"], []).append((bytes(r["bits"]), r["hashes"]))
        shared = df.sparkSession.sparkContext.broadcast(levels)
        pieces.append(rows.where(F.col("part").between(low, high - 1)).withColumn(column, _lookup(shared)("part", "h1", "h2") & F.col("key").isNotNull()))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.union(p)
    return out.drop("part", "h1", "h2")


def _lookup(shared):
    @F.pandas_udf("boolean")
    def lookup(part, h1, h2):
        import pandas as pd

        part, h1, h2 = part.to_numpy(), h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)
        verdict = np.zeros(len(part), bool)
        for p in np.unique(part):
            left = np.flatnonzero(part == p)
            answer = np.zeros(len(left), bool)
            going = np.arange(len(left))
            for i, (bits, k) in enumerate(shared.value.get(int(p), [])):
                raw = np.frombuffer(bits, np.uint8)
                held = _holds(raw, _places(h1[left[going]], h2[left[going]], i, k, len(raw) * 8))
                answer[going] = (held) == (i % 2 == 0)
                going = going[held]
            verdict[left] = answer
        return pd.Series(verdict)

    return lookup


def judge_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path, fits no rule and isn't listed: allow.
    """
    urls = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("key"), path_of(F.col("url")).alias("path"))
    universe = urls.select("key")
    cascade, parts = build_cascade(universe, listed_hosts(universe))
    judged = listed_by_cascade(urls, cascade, parts).withColumn("fit", matching_rule(F.col("key"), F.col("path")))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", F.col("key").alias("host"), "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"))


def _rules_sql() -> str:
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return f"CASE {' '.join(cases)} END"


URL_SQL = rf"""
WITH urls AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fitted AS (SELECT *, {_rules_sql()} AS fit FROM urls)
SELECT page_id, host, path, CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2) END AS rule,
    CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1)
    WHEN len(list_intersect(regexp_split_to_array(host, '[.-]'), ['{"','".replace('"', "'").join(LISTED_WORDS)}'])) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM fitted
"""
