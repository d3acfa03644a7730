"""Matroska columns: muxing bytes as 8-bit audio, and parsing files into packet tables.

The parser walks variable-length EBML elements, clusters, simple blocks with any kind of lacing, and cues.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm.frames import pick

FRAME = 192
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32
RATE = 8000
PAD = b"\x20"
# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUE_POINT, CUE_POSITIONS, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA0, 0xA1, 0xBB, 0xB7, 0xB3, 0xF7, 0xF1
SCALE, DURATION, NUMBER, UID, TYPE, CODEC, AUDIO, SAMPLING, CHANNELS, DEPTH = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
FRAME_MS = FRAME * 1000 // RATE
XIPH, FIXED, EBML_LACING = 1, 2, 3


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def _vint(value: int) -> bytes:
    """The shortest size field of a value (all ones is reserved for unknown sizes)."""
    n = max(1, -(-(value + 1).bit_length() // 7))
    return (value | 1 << 7 * n).to_bytes(n, "big")


def _element(number: int, body: bytes) -> bytes:
    return _id(number) + _vint(len(body)) + body


def _uint(number: int, value: int) -> bytes:
    return _element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(number: int, value: float) -> bytes:
    return _element(number, np.array(value, ">f8").tobytes())


HEAD = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
AUDIO_TRACK = _element(
    TRACKS,
    _element(
        TRACK,
        _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _float(SAMPLING, float(RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8)),
    ),
)


def pad_payload(data: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of the frame size."""
    size = max(FRAME, -(-len(data) // FRAME) * FRAME)
    return data.ljust(size, PAD)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit mono track; ``payload`` is a multiple of the frame size.

    Full blocks use fixed lacing; the last one of several frames uses EBML lacing, a single frame none.
    """
    frames = len(payload) // FRAME
    body = _element(INFO, _uint(SCALE, 1_000_000) + _float(DURATION, float(frames * FRAME_MS))) + AUDIO_TRACK
    parts, at, cues = [body], len(body), []
    per_cluster = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for start in range(0, frames, per_cluster):
        end = min(frames, start + per_cluster)
        blocks = [_uint(TIMESTAMP, start * FRAME_MS)]
        for first in range(start, end, FRAMES_PER_BLOCK):
            last = min(end, first + FRAMES_PER_BLOCK)
            n, data = last - first, payload[first * FRAME : last * FRAME]
            when = ((first - start) * FRAME_MS).to_bytes(2, "big", signed=True)
            if n == FRAMES_PER_BLOCK:
                lace, flags = bytes([n - 1]), FIXED
            elif n > 1:  # first size, then signed differences, all zero
                lace, flags = bytes([n - 1]) + _vint(FRAME) + b"\xbf" * (n - 2), EBML_LACING
            else:
                lace, flags = b"", 0
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + when + bytes([0x80 | flags << 1]) + lace + data))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start * FRAME_MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return HEAD + _element(SEGMENT, b"".join(parts))


def _read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length number and the offset after it; ``keep`` leaves the length marker in, as ids have it."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep else value & ((1 << 7 * n) - 1)), at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of the body, its end) of each element of a stretch; an unknown size reaches to its end."""
    while at < end:
        number, at = _read_vint(data, at, keep=True)
        width = 9 - data[at].bit_length() if at < end else 0
        size, at = _read_vint(data, at)
        stop = end if size == (1 << 7 * width) - 1 else at + size
        if stop > end:
            raise ValueError(f"the element at byte {at} is longer than its parent")
        yield number, at, stop
        at = stop


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, length) of each frame of a block whose lacing begins at ``at``."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACING:
        for i in range(n - 1):
            width = 9 - data[at].bit_length()
            value, at = _read_vint(data, at)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> dict:
    """Packets (track, timestamp, start, length, keyframe), cues (time, track, file offset) and cluster offsets."""
    found: dict = {"packets": [], "cues": [], "clusters": [], "codec": None}
    segment = 0

    def block(at: int, end: int, base: int, simple: bool) -> None:
        track, at = _read_vint(data, at)
        when, flags = base + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        frames = laced(data, at + 3, end, flags >> 1 & 3)
        found["packets"] += [(track, when + i * FRAME_MS, s, n, simple and flags >= 128) for i, (s, n) in enumerate(frames)]

    def walk(at: int, end: int, parent: dict) -> None:
        nonlocal segment
        before = at
        for number, start, stop in elements(data, at, end):
            if number == SEGMENT:
                segment = start
                walk(start, stop, {})
            elif number == CLUSTER:
                found["clusters"].append(before - segment)
                walk(start, stop, {"time": 0})
            elif number == TIMESTAMP:
                parent["time"] = int.from_bytes(data[start:stop], "big")
            elif number in (SIMPLE_BLOCK, BLOCK):
                block(start, stop, parent["time"], number == SIMPLE_BLOCK)
            elif number == CUE_POINT:
                point: dict = {}
                walk(start, stop, point)
                found["cues"].append((point.get(CUE_TIME), point.get(CUE_TRACK), segment + point.get(CUE_CLUSTER, 0)))
            elif number in PARENTS:
                walk(start, stop, parent)
            elif number in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                parent[number] = int.from_bytes(data[start:stop], "big")
            elif number == CODEC:
                found["codec"] = data[start:stop].decode("ascii", "replace")
            before = stop

    walk(0, len(data), {})
    return found


def mux_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a Matroska file; null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [v or b"" for v in part["text"].cast(pa.binary()).to_pylist()]
                media = pa.array([mux(pad_payload(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    docs = pick(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


PACKETS = "track int, timestamp long, start long, length long, keyframe boolean"


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet of every file: doc_id, track, timestamp in ms, byte range, keyframe, and the cue that leads to it.

    ``cue`` is the offset of the last cued cluster at or before the packet; a null file has no packets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, ids = [], []
                for i, data in enumerate(part["media"].to_pylist()):
                    if data is None:
                        continue
                    found = parse(data)
                    times = np.array([c[0] for c in found["cues"]] or [0])
                    places = [c[2] for c in found["cues"]] or [None]
                    for p in found["packets"]:
                        rows.append((*p, places[max(0, int(np.searchsorted(times, p[1], "right")) - 1)]))
                        ids.append(i)
                columns = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(ids, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    ["doc_id", "track", "timestamp", "start", "length", "keyframe", "cue"],
                )

    media = media.select("doc_id", "media")
    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {PACKETS}, cue long")


def media_features(data: bytes) -> tuple[bytes, str]:
    """The payload of a stored file and a line of features of its packets and samples."""
    found = parse(data)
    payload = b"".join([data[s : s + n] for _, _, s, n, _ in found["packets"]])
    samples = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    level = samples.astype(np.int64)
    sign = samples >= 0
    led = sum(data.startswith(_id(CLUSTER), place) for _, _, place in found["cues"])
    return payload, (
        f"codec={found['codec']};packets={len(found['packets'])};clusters={len(found['clusters'])};cues={led};"
        f"ms={found['packets'][-1][1] + FRAME_MS if found['packets'] else 0};mean={int(level.sum()) // max(1, len(level))};"
        f"energy={int((level * level).sum()) // max(1, len(level))};peak={int(abs(samples).max(initial=0))};crossings={int((sign[1:] != sign[:-1]).sum())}"
    )


def media_digest(docs: DataFrame) -> DataFrame:
    """One row per document: sizes, checksums and features of the stored file as it is read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for data in part["media"].to_pylist():
                    payload, feature = media_features(data)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                columns = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], NAMES)

    media = mux_documents(docs)
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
