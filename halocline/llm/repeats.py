"""Substring dedup: words covered by a window that an earlier document has too.

A text's windows of 13 words are cut into super-k-mers: consecutive windows with the same minimiser, the
foremost of their words in an order that puts long words first, travel as one packed string to the minimiser's
bucket.  A bucket sorts its windows, finds the smallest document of each, and reports of each packed string
the windows that some document but the smallest has.  Documents look their packed strings up among those.

Equal packed strings are reduced to their smallest and largest document before they travel, so a passage
that very many documents share is a few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.frames import SEPARATORS, buffer_of, mix64, pick, release, utf8_size
from halocline.storage import materialise

WINDOW = 13
LONGEST = 256  # windows in one packed string
BLOCK_BYTES = 1 << 21  # text handled at once
BUCKET_BYTES = 4 << 20  # text whose windows one task sorts
ROWS_AT_ONCE = 8_192
# Odd multipliers of the rolling hashes, which only sort; equality is always checked.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    if base not in _powers or len(_powers[base]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base]


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of texts that stand end to end in ``raw``."""
    letter = ~_SPACE[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    before = inner[inner > 0] - 1
    last[before] = letter[before]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes that doesn't depend on where the word stands."""
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(raw))[: len(raw)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * _power(inverse, len(raw) + 1)[starts])


def _least(keys: np.ndarray) -> np.ndarray:
    """Smallest key of each window."""
    two = np.minimum(keys[:-1], keys[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    return np.minimum(eight[: len(keys) - WINDOW + 1], eight[WINDOW - 8 : WINDOW - 8 + len(keys) - WINDOW + 1])


def super_kmers(raw: np.ndarray, bounds: np.ndarray):
    """Of each packed string: text number, first word within the text, minimiser, bytes."""
    starts, ends, text = words_of(raw, bounds)
    if len(starts) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    lengths = ends - starts
    # long words come first in the order; they are rarer, so buckets stay small
    rank = np.uint64(15) - np.minimum(lengths, 15).astype(np.uint64)
    keys = (rank << np.uint64(60)) | (word_hashes(raw, starts, ends) >> np.uint64(4))
    least = _least(keys)
    inside = text[: len(least)] == text[WINDOW - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    run = np.cumsum(new)[at] - 1
    opened = np.flatnonzero(new)
    new[at] |= (at - opened[run]) % LONGEST == 0
    first = np.flatnonzero(new)
    final = np.r_[at[np.searchsorted(at, first[1:]) - 1], at[-1]] + WINDOW - 1
    # words joined by one space
    offsets = np.r_[0, np.cumsum(lengths + 1)]
    joined = np.full(int(offsets[-1]), 32, np.uint8)
    fill = np.ones(len(joined), bool)
    fill[offsets[1:] - 1] = False
    joined[fill] = raw[~_SPACE[raw]]
    data = joined.tobytes()
    packed = [data[a:b] for a, b in zip(offsets[first].tolist(), (offsets[final] + lengths[final]).tolist())]
    word_zero = np.searchsorted(text, np.arange(len(bounds) - 1))
    return text[first], first - word_zero[text[first]], least[first], packed


def _digests(packed: list[bytes]) -> np.ndarray:
    """128-bit names of packed strings, as two columns of longs."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(p) for p in packed]), np.int64).reshape(-1, 2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BLOCK_BYTES`` of text."""
    for batch in batches:
        size = np.cumsum(np.asarray(batch["size"]))
        low = 0
        while low < batch.num_rows:
            done = size[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(size, done + BLOCK_BYTES, "right")))
            yield batch.slice(low, high - low)
            low = high


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, packed, low, span): the packed strings of a block, equal ones as one row."""
    for block in _blocks(batches):
        text, _, least, packed = super_kmers(*buffer_of(block["text"]))
        if not packed:
            continue
        docs = np.asarray(block["doc_id"])[text]
        seen: dict[bytes, int] = {}
        at = np.fromiter((seen.setdefault(p, len(seen)) for p in packed), np.int64, len(packed))
        order = np.argsort(at, kind="stable")
        heads = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
        low, high = np.minimum.reduceat(docs[order], heads), np.maximum.reduceat(docs[order], heads)
        # half of the minimiser's bits, and the distance of the documents, are less to send
        bucket = (least[order[heads]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        rows = [bucket, list(seen), low, high - low]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int32(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "packed", "low", "span"])


def _shared_runs(packed: pa.Array, low: np.ndarray, high: np.ndarray):
    """Of packed strings of whole buckets: (string, first window, windows, smallest document) of shared windows."""
    raw, bounds = buffer_of(packed)
    starts, ends, text = words_of(raw, bounds)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = word_hashes(raw, starts, ends)
    n = len(starts) - WINDOW + 1
    window = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            window = window * np.uint64(STEP) + hashes[i : i + n]
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    at = at[np.argsort(window[at])]
    same = window[at[1:]] == window[at[:-1]]
    heads = np.flatnonzero(np.r_[True, ~same])
    owner = text[at]
    least, most = np.minimum.reduceat(low[owner], heads), np.maximum.reduceat(high[owner], heads)
    sizes = np.diff(np.r_[heads, len(at)])
    least = np.repeat(least, sizes)
    several = np.flatnonzero((sizes > 1) & (least[heads] < most))
    data = raw.tobytes()
    for h, size in zip(heads[several].tolist(), sizes[several].tolist()):
        own = at[h : h + size]
        spelled = [data[a:b] for a, b in zip(starts[own].tolist(), ends[own + WINDOW - 1].tolist())]
        if spelled.count(spelled[0]) < size:  # different windows of one hash
            smallest: dict[bytes, int] = {}
            for s, d in zip(spelled, low[text[own]].tolist()):
                smallest[s] = min(d, smallest.get(s, d))
            least[h : h + size] = [smallest[s] for s in spelled]
    shared = least < high[owner]
    at, least = at[shared], least[shared]
    order = np.argsort(at)
    at, least = at[order], least[order]
    owner = text[at]
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    zero = np.searchsorted(text, np.arange(len(packed)))
    return owner[first], at[first] - zero[owner[first]], np.diff(np.r_[first, len(at)]), least[first]


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of shared windows; rows come sorted by bucket, and whole buckets are handled some at a time."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        # a packed string comes once from each block of texts that has it
        table = table.append_column("high", pc.add(table["low"], table["span"]))
        table = table.group_by("packed").aggregate([("low", "min"), ("high", "max")])
        packed = table["packed"].combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        string, first, n, low = _shared_runs(packed, table["low_min"].to_numpy(), table["high_max"].to_numpy())
        names = np.unique(string)
        digests = _digests(packed.take(pa.array(names)).to_pylist())[np.searchsorted(names, string)]
        columns = [digests[:, 0], digests[:, 1], first.astype(np.int32), n.astype(np.int32), low]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "first", "n", "low"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < ROWS_AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        bucket = table["bucket"].to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut:
            yield solve(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        count = sum(b.num_rows for b in held)
    if count:
        yield solve(pa.Table.from_batches(held))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, doc_id, h, start): each packed string of each document."""
    for block in _blocks(batches):
        text, start, _, packed = super_kmers(*buffer_of(block["text"]))
        if packed:
            k = _digests(packed)
            docs, h = np.asarray(block["doc_id"])[text], np.asarray(block["h"])[text]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k[:, 0], k[:, 1], docs, h, start.astype(np.int32))], ["k1", "k2", "doc_id", "h", "start"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, h, start, words): stretches of words that an earlier document has too.

    ``h`` is the text's xxhash64, which tells rows of one doc_id apart; rows with a null doc_id or text have none.
    """
    rows = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text", utf8_size(F.col("text")).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    packed = rows.mapInArrow(_pack, "bucket int, packed binary, low long, span long")
    sorted_ = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    runs = materialise(sorted_.mapInArrow(_sort_buckets, "k1 long, k2 long, first int, n int, low long"), "repeat-runs")
    # the packed strings' shuffle is done with
    del packed, sorted_
    release(docs.sparkSession)
    found = rows.mapInArrow(_occurrences, "k1 long, k2 long, doc_id long, h long, start int")
    met = found.join(runs, ["k1", "k2"]).where("low < doc_id")
    return met.select("doc_id", "h", (F.col("start") + F.col("first")).alias("start"), (F.col("n") + WINDOW - 1).alias("words"))


def _remove(batches: Iterator[pa.RecordBatch], text: int, runs: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[bytes]]]:
    """Slices of a batch with, for each row, number of words, of removed words, and the text that is left."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            totals, removed, kept = [], [], []
            for data, spans in zip(part[text].cast(pa.binary()).to_pylist(), part[runs].to_pylist()):
                words = (data or b"").split()
                totals.append(len(words))
                if spans:
                    stays = np.ones(len(words), bool)
                    for s in spans:
                        stays[s["start"] : s["start"] + s["words"]] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words))
            yield part, totals, removed, kept


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's text without the repeated words, joined by one space.

    Null and empty texts have no words; a row with a null doc_id keeps all of its words and makes none of
    others repeated; equal doc_ids are never smaller than each other.
    """
    runs = repeated_runs(docs).groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.collect_list(F.struct("start", "words")).alias("runs"))
    rows = pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = rows.join(runs, (F.col("doc_id") == F.col("of")) & (F.col("h") == F.col("of_h")), "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, totals, removed, kept in _remove(batches, 1, 2):
            arrays = [part["doc_id"], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
