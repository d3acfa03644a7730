"""Near-duplicates by SimHash, found with a binary-trie self-join.

Fingerprints that differ in at most k bits agree in at least e of any k + e blocks of bits.  For each choice
of e blocks those bits are moved to the front and the fingerprints that share them form one trie, which
a task holds as a sorted array: a node is a stretch of it.  The join walks pairs of nodes from the root down, adds up the
bits in which the two paths differ, and drops a pair as soon as they are more than k.  Only links that
join something new leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.components import connected_components, local_components
from halocline.llm.frames import pick
from halocline.llm.resemblance import WORDS, similar_groups
from halocline.storage import materialise

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
MAX_DIFFERENCE = 3
TRIE_KEYS = 4096  # fingerprints in one trie; larger ones are joined piece by piece
KEYS_PER_PREFIX = 16  # how many random fingerprints may share the leading bits
FRONTIER = 1 << 20


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text: per bit, whether it is set in over half of the shingles' hashes."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint long) of every row; the long holds the 64 bits as they are."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = np.array([fingerprint(t, words) for t in part["text"].cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, length) of n blocks that part the fingerprint."""
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _front(values: np.ndarray, chosen: list[tuple[int, int]], rest: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with the chosen blocks moved to the front."""
    out = np.zeros_like(values)
    for first, length in [*chosen, *rest]:
        bits = (values >> np.uint64(BITS - first - length)) & np.uint64((1 << length) - 1)
        out = (out << np.uint64(length)) | bits
    return out


def trie_links(keys: np.ndarray, group: np.ndarray, side: np.ndarray, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all keys within ``limit`` bits of each other, per group.

    ``keys`` agree in their first ``depth`` bits within a group.  ``side`` is 0 for all of a group, or 0 and 1
    when only links between the two sides are wanted.
    """
    order = np.lexsort((keys, side, group))
    keys, group, side = keys[order], group[order], side[order]
    n = len(keys)
    # the roots: stretches of one group and side; pair a root with itself, or with its group's other side
    new = np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])] if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], n]
    same = np.r_[group[starts][1:] == group[starts][:-1], False] if n else np.zeros(0, bool)
    paired = np.r_[False, same[:-1]] if n else np.zeros(0, bool)
    cross = np.flatnonzero(same)
    alone = np.flatnonzero(~same & ~paired & (side[starts] == 0)) if n else np.zeros(0, np.int64)
    todo = [(depth, np.r_[starts[alone], starts[cross]], np.r_[ends[alone], ends[cross]], np.r_[starts[alone], starts[cross + 1]] if len(cross) else starts[alone], np.r_[ends[alone], ends[cross + 1]] if len(cross) else ends[alone], np.zeros(len(alone) + len(cross), np.int8))]
    labels, links = np.arange(n), ([], [])
    ones: dict[int, np.ndarray] = {}
    while todo:
        bit, la, ha, lb, hb, err = todo.pop()
        if len(la) > FRONTIER:
            half = len(la) // 2
            todo.append((bit, la[half:], ha[half:], lb[half:], hb[half:], err[half:]))
            todo.append((bit, la[:half], ha[:half], lb[:half], hb[:half], err[:half]))
            continue
        # pairs of single keys are compared outright
        single = (ha - la == 1) & (hb - lb == 1)
        i, j = la[single], lb[single]
        close = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= limit)
        i, j = i[close], j[close]
        apart = labels[i] != labels[j]
        if apart.any():
            i, j = i[apart], j[apart]
            labels = local_components(n, i, j, labels)
            links[0].append(i)
            links[1].append(j)
        go = ~single
        la, ha, lb, hb, err = la[go], ha[go], lb[go], hb[go], err[go]
        if not len(la):
            continue
        # nothing is to be found in a pair of nodes whose keys are all connected already
        changes = np.r_[0, np.cumsum(labels[1:] != labels[:-1])]
        known = (changes[ha - 1] == changes[la]) & (changes[hb - 1] == changes[lb]) & (labels[la] == labels[lb])
        if known.any():
            go = ~known
            la, ha, lb, hb, err = la[go], ha[go], lb[go], hb[go], err[go]
            if not len(la):
                continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((keys >> np.uint64(BITS - 1 - bit)) & np.uint64(1)).astype(np.int64)]
        s = ones[bit]
        ma, mb = ha - (s[ha] - s[la]), hb - (s[hb] - s[lb])
        own = (la == lb) & (ha == hb)
        other = ~own
        parts = [
            (la, ma, lb, mb, err),
            (ma, ha, mb, hb, err),
            (la, ma, mb, hb, err + 1),
            (ma[other], ha[other], lb[other], mb[other], err[other] + 1),
        ]
        la, ha, lb, hb, err = (np.concatenate([p[k] for p in parts]) for k in range(5))
        alive = (ha > la) & (hb > lb) & (err <= limit) & ~((la == lb) & (ha == hb) & (ha - la == 1))
        if alive.any():
            todo.append((bit + 1, la[alive], ha[alive], lb[alive], hb[alive], err[alive].astype(np.int8)))
    i = np.concatenate([*links[0], np.zeros(0, np.int64)]).astype(np.int64)
    j = np.concatenate([*links[1], np.zeros(0, np.int64)]).astype(np.int64)
    return order[i], order[j]


def fingerprint_links(distinct: DataFrame, n: int, limit: int = MAX_DIFFERENCE, trie_keys: int = TRIE_KEYS) -> DataFrame:
    """Links (a, b) that connect all of the ``n`` distinct ``fingerprint`` values within ``limit`` bits.

    More fingerprints take more blocks and so longer common prefixes; the links are the same.  A trie of more than
    ``trie_keys`` fingerprints is parted by hash, and each pair of its parts is a task of its own.
    """
    exact = 1
    while exact < 4 and n > KEYS_PER_PREFIX << math.floor(exact * BITS / (limit + exact)):
        exact += 1
    blocks = _blocks(limit + exact)
    choices = list(combinations(range(len(blocks)), exact))
    plans = [([blocks[i] for i in c], [b for i, b in enumerate(blocks) if i not in c]) for c in choices]

    def prefix(chosen):
        parts = [F.shiftrightunsigned("fingerprint", BITS - a - k).bitwiseAND(F.lit((1 << k) - 1)) for a, k in chosen]
        out = parts[0]
        for p, (_, k) in zip(parts[1:], chosen[1:]):
            out = F.shiftleft(out, k).bitwiseOR(p)
        return out

    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("plan"), prefix(chosen).alias("prefix")) for i, (chosen, _) in enumerate(plans)]))
    rows = distinct.select("fingerprint", tries.alias("t")).select("fingerprint", "t.plan", "t.prefix")
    sizes = rows.groupBy("plan", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    large = sizes.where(F.col("n") > trie_keys).withColumn("pieces", F.ceil(F.col("n") / trie_keys))
    rows = rows.join(large.select("plan", "prefix", "pieces"), ["plan", "prefix"], "left").na.fill(1, ["pieces"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("pieces")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    rows = rows.select("fingerprint", "plan", "prefix", low.alias("low"), high.alias("high"), (F.col("own") != low).cast("int").alias("side"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        values = table["fingerprint"].to_numpy().view(np.uint64)
        side, plan = table["side"].to_numpy(), table["plan"].to_numpy()
        names = np.stack([table[c].to_numpy() for c in ("prefix", "low", "high")])
        found = []
        for p, (chosen, rest) in enumerate(plans):
            at = np.flatnonzero(plan == p)
            if len(at) < 2:
                continue
            sort = at[np.lexsort(names[:, at])]
            group = np.r_[0, np.cumsum((names[:, sort[1:]] != names[:, sort[:-1]]).any(axis=0))]
            i, j = trie_links(_front(values[sort], chosen, rest), group, side[sort], sum(k for _, k in chosen), limit)
            found.append((values[sort[i]], values[sort[j]]))
        a, b = (np.concatenate([*(f[k] for f in found), np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # a task holds some tens of thousands of fingerprints with their tries
    tasks = max(1, math.ceil(n * len(plans) / 65536))
    dealt = rows.repartition(max(tasks, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "plan", "prefix", "low", "high")
    return dealt.mapInArrow(join, "a long, b long")


def fingerprint_components(classes: DataFrame, limit: int = MAX_DIFFERENCE) -> DataFrame:
    """``classes``, a stored table of distinct ``fingerprint`` values, with the ``label`` of those linked within ``limit`` bits."""
    links = materialise(fingerprint_links(classes.select("fingerprint"), classes.count(), limit), "simhash-links")
    labels = connected_components(links)
    return classes.join(labels, F.col("fingerprint") == F.col("node"), "left").select(*classes.columns, F.coalesce("label", "fingerprint").alias("label"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, limit: int = MAX_DIFFERENCE) -> DataFrame:
    """(doc_id, fingerprint long, component_id): documents linked over fingerprints within ``limit`` bits.

    One row per row of ``docs``.  A null or empty text has fingerprint zero, linked like any other.  A null doc_id is
    linked, but no component is named after it; one of null ids only has a null component_id.
    """
    rows = materialise(fingerprints(docs, words), "simhash")
    classes = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-classes")
    named = fingerprint_components(classes, limit)
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = materialise(named.join(smallest, "label").select(F.col("fingerprint").alias("of"), "component_id"), "simhash-components")
    return rows.join(named, F.col("fingerprint") == F.col("of")).select("doc_id", "fingerprint", "component_id")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicate_groups(docs: DataFrame, words: int = WORDS, limit: int = MAX_DIFFERENCE) -> DataFrame:
    """(doc_id, h, label) of every row of ``docs``: ``h`` is the xxhash64 of its text, ``label`` names its group and is never null.

    Texts are linked by SimHash fingerprints of their five-word shingles within ``limit`` bits.  So few bits miss most of the
    texts that share only four fifths of their shingles; :func:`halocline.llm.resemblance.similar_groups` links these
    besides, and a group holds all that either connects.
    """
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    prints = materialise(fingerprints(texts, words).withColumnRenamed("doc_id", "h").distinct(), "simhash-texts")
    classes = materialise(prints.select("fingerprint").distinct(), "simhash-classes")
    near = prints.join(fingerprint_components(classes, limit).withColumnRenamed("label", "near"), "fingerprint").select("h", "near")
    found = materialise(similar_groups(docs), "simhash-similar")
    # a fingerprint's component ties the groups that its texts are in to the smallest of them
    tied = materialise(found.select("h", "label").distinct().join(near, "h").select("near", "label").distinct(), "simhash-ties")
    hubs = tied.groupBy("near").agg(F.min("label").alias("hub"))
    edges = tied.join(hubs, "near").where("hub <> label").select(F.col("label").alias("a"), F.col("hub").alias("b")).distinct()
    joined = connected_components(edges).withColumnRenamed("label", "smallest")
    return found.join(joined, F.col("label") == F.col("node"), "left").select("doc_id", "h", F.coalesce("smallest", "label").alias("label"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, as :func:`near_duplicate_groups` links them.

    The row with the smallest doc_id stays, a null id only if the group has no other; of unlike texts under that id one
    stays, of equal rows any one.  All columns are kept.
    """
    at = [f"c{i}" for i in range(len(docs.columns))]
    key, text = at[docs.columns.index("doc_id")], at[docs.columns.index("text")]
    wide = docs.toDF(*at).withColumn("h", F.xxhash64(text))
    found = materialise(near_duplicate_groups(wide.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))), "simhash-groups")
    # rows of one id and text are always of one group
    stays = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("s"))
    rows = found.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    same = F.col("s.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("s.h") == F.col("h"))
    chosen = materialise(stays.join(rows, same).select(F.col("doc_id").alias("named"), F.col("h").alias("hashed"), "n"), "simhash-stays")
    same = F.col(key).eqNullSafe(F.col("named")) & (F.col("h") == F.col("hashed"))
    once = wide.join(chosen.where("n = 1"), same, "left_semi")
    several = wide.join(chosen.where("n > 1"), same, "left_semi").dropDuplicates([key, "h"])
    return once.union(several).select(*at).toDF(*docs.columns)
