"""Groups of documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

MinHash signatures in bands give candidates: two texts at the threshold agree in none of the bands with a probability
of 6e-8.  Members of a band's bucket are tied to each other, so the candidates' components hold every similar
pair; inside a component the shingle sets themselves are compared.  A large component is cut into
pieces and each pair of pieces is compared on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.components import connected_components, local_components
from halocline.llm.frames import mix64, pick
from halocline.storage import materialise

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 42, 5
SEED = 42
PIECE_ROWS = 256  # texts in one piece of a component
PIECE_SHINGLES = 1 << 20
# odd multipliers, one for each hash function of a signature (fixed values)
FACTORS = mix64(np.arange(1, BANDS * BAND_ROWS + 1)) | np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a text of fewer words is one shingle, one without words has none."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """One hash for each band of the MinHash signature of a set of shingles."""
    lowest = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):
        lowest = np.minimum(lowest, (FACTORS[:, None] * own[None, at : at + 512]).min(axis=1))
    out = np.zeros(BANDS, np.uint64)
    for row in lowest.reshape(BANDS, BAND_ROWS).T:
        out = mix64(out ^ row)
    return out


def similar_links(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect all pairs of ``sets`` with a Jaccard similarity of at least 0.8.

    ``side`` is 0 for all, or 0 and 1 when only links between the sides are wanted.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if n < 2:
        return []
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    held = np.flatnonzero(sizes)
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    two, labels, links, anchor = bool(side.any()), np.arange(n), [], None
    for step, i in enumerate(held.tolist()):
        if step == 8:
            anchor = np.bincount(labels[held[:8]]).argmax()
        # a pair that is not connected has a member outside of the anchor's group
        if anchor is not None and labels[i] == labels[anchor]:
            continue
        mark[codes[starts[i] : ends[i]]] = True
        shared = np.zeros(n, np.int64)
        shared[held] = np.add.reduceat(mark[codes].view(np.int8), starts[held], dtype=np.int64)
        mark[codes[starts[i] : ends[i]]] = False
        # shared / (a + b - shared) >= 4 / 5, in whole numbers
        near = (shared > 0) & (9 * shared >= 4 * (sizes + sizes[i])) & (labels != labels[i])
        if two:
            near &= side != side[i]
        if near.any():
            j = np.flatnonzero(near)
            j = j[np.unique(labels[j], return_index=True)[1]]
            links.extend((i, k) for k in j.tolist())
            labels = local_components(n, np.full(len(j), i), j, labels)
    return links


def _signed(rows: DataFrame) -> DataFrame:
    """(doc_id, h, set, size, bands) of all rows: hashes of the text and of its set of shingles, number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t) for t in part["text"].cast(pa.binary()).to_pylist()]
                names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                signed = np.array([bands(s) for s in sets], np.uint64).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(signed))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["h"], pa.array(names), sizes, lists], ["doc_id", "h", "set", "size", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h long, set long, size long, bands array<long>")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) inside every group of a task's rows (set, side, text, and the group's label, low, high)."""
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    a, b = [], []
    if table is not None:
        names, side = table["set"].to_numpy(), table["side"].to_numpy()
        by = np.stack([table[c].to_numpy() for c in ("label", "low", "high")])
        order = np.lexsort(by)
        cuts = np.flatnonzero(np.r_[True, (by[:, order[1:]] != by[:, order[:-1]]).any(axis=0)])
        for own in np.split(order, cuts[1:]):
            if len(own) > 1:
                texts = table["text"].take(pa.array(own)).cast(pa.large_binary()).to_pylist()
                for i, j in similar_links([shingles(t) for t in texts], side[own]):
                    a.append(names[own[i]])
                    b.append(names[own[j]])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, h, label) of every row of ``docs``: ``h`` is the xxhash64 of its text, ``label`` names its group and is never null.

    Texts with equal sets of shingles are of one group, as are all without words.
    """
    texts = pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    signed = materialise(_signed(texts), "similar-rows")
    rows = signed.select("doc_id", "h", "set")
    # texts of one set have one signature; compared is the text of the smallest hash
    sets = materialise(signed.groupBy("set").agg(F.min("h").alias("h"), F.max("size").alias("size"), F.first("bands").alias("bands")), "similar-sets")
    spread = sets.where("size > 0").select("set", F.posexplode("bands").alias("band", "bucket"))
    hubs = spread.groupBy("band", "bucket").agg(F.min("set").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    tied = materialise(spread.join(hubs, ["band", "bucket"]).select("set", "hub"), "similar-ties")
    # each set goes to its smallest hub, and its other hubs go there too: two edges or so for each set, not one for each band
    lows = tied.groupBy("set").agg(F.min("hub").alias("low"))
    others = tied.join(lows, "set").select(F.col("hub").alias("a"), F.col("low").alias("b"))
    candidates = lows.select(F.col("set").alias("a"), F.col("low").alias("b")).union(others).where("a <> b").distinct()
    near = connected_components(candidates).join(sets.select("set", "h", "size"), F.col("node") == F.col("set")).select("set", "h", "size", "label")
    near = materialise(near, "similar-candidates")
    large = F.greatest(F.ceil(F.count("*") / PIECE_ROWS), F.ceil(F.sum("size") / PIECE_SHINGLES))
    pieces = near.groupBy("label").agg(large.alias("pieces"))
    near = near.join(pieces, "label").withColumn("own", F.pmod(F.xxhash64("set"), F.col("pieces")))
    # one text for each set, fetched by its hash
    source = texts.select("h", "text").join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    near = near.join(source, "h").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    near = near.select("set", "text", "label", low.alias("low"), high.alias("high"), (F.col("own") != low).cast("int").alias("side"))
    dealt = near.repartition("label", "low", "high")
    links = materialise(dealt.mapInArrow(_compare, "a long, b long"), "similar-links")
    labels = connected_components(links)
    return rows.join(labels, F.col("set") == F.col("node"), "left").select("doc_id", "h", F.coalesce("label", "set").alias("label"))
