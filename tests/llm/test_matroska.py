"""Matroska files: exact round trips and every kind of lacing."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halocline.llm import matroska as mk


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=2000), st.integers(1, 400))
def test_round_trip(data, times):
    payload = mk.pad_payload(data * times)
    assert len(payload) % 192 == 0 and payload[: len(data) * times] == data * times
    found = mk.parse(mk.mux(payload))
    media = mk.mux(payload)
    assert b"".join(media[s : s + n] for _, _, s, n, _ in found["packets"]) == payload
    assert [t for _, t, *_ in found["packets"]] == [24 * i for i in range(len(payload) // 192)]
    assert all(media.startswith(b"\x1f\x43\xb6\x75", place) for _, _, place in found["cues"])
    assert len(found["cues"]) == len(found["clusters"])


@pytest.mark.parametrize("value", [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**55])
def test_variable_length_numbers(value):
    assert mk._read_vint(mk._vint(value), 0) == (value, len(mk._vint(value)))


def file_of(*blocks):
    return mk.HEAD + mk._element(mk.SEGMENT, mk.AUDIO_TRACK + mk._element(mk.CLUSTER, mk._uint(mk.TIMESTAMP, 1000) + b"".join(blocks)))


def test_lacing_of_all_kinds():
    frames = [b"a" * 300, b"b" * 5, b"c" * 255, b"d" * 7]
    data = b"".join(frames)
    xiph = b"\x03" + b"\xff\x2d" + b"\x05" + b"\xff\x00" + data
    first, rest = mk._vint(300), (5 - 300, 255 - 5)
    signed = b"".join((d + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big") for d in rest)
    kinds = {1: xiph, 3: b"\x03" + first + signed + data, 2: b"\x02" + b"xyz", 0: b"whole"}
    want = {1: frames, 3: frames, 2: [b"x", b"y", b"z"], 0: [b"whole"]}
    for kind, body in kinds.items():
        media = file_of(mk._element(mk.SIMPLE_BLOCK, b"\x82\xff\xf6" + bytes([kind << 1]) + body))
        packets = mk.parse(media)["packets"]
        assert [media[s : s + n] for _, _, s, n, _ in packets] == want[kind]
        assert packets[0][:2] == (2, 990)


def test_block_groups_unknown_sizes_and_broken_files():
    group = mk._element(mk.BLOCK_GROUP, mk._element(mk.BLOCK, b"\x81\x00\x05\x00data"))
    body = mk._element(mk.CLUSTER, mk._uint(mk.TIMESTAMP, 7) + group)
    media = mk.HEAD + mk._id(mk.SEGMENT) + b"\x01" + b"\xff" * 7 + body
    (packet,) = mk.parse(media)["packets"]
    assert packet[:2] == (1, 12) and media[packet[2] :][: packet[3]] == b"data"
    for broken in (media[:-1], b"\x00" * 9, mk.HEAD + b"\x1f"):
        with pytest.raises((ValueError, IndexError)):
            mk.parse(broken)


def test_documents(documents):
    texts = [None, "", "héllo", "héllo", "x" * 60_000]
    got = {r.doc_id: r for r in mk.media_digest(documents(texts)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        media = mk.mux(payload)
        assert got[i][1:7] == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert f"packets={len(payload) // 192};" in got[i].feature
    assert got[2][1:] == got[3][1:]
    assert mk.media_digest(documents([])).collect() == []


def test_packet_table(documents):
    table = mk.packet_table(mk.mux_documents(documents(["a" * 192 * 600, None])))
    assert table.where("doc_id = 0").count() == 600 and table.where("doc_id = 1").count() == 1
    assert table.where("doc_id = 0").select("cue").distinct().count() == 3
    assert table.where("length <> 192 OR start <= cue OR track <> 1").isEmpty()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "t", 5, b"m")], "doc_id int, text string, n_bytes int, media binary")
    assert mk.media_digest(df).columns == mk.NAMES
    assert mk.media_digest(df).first().n_bytes == 1
