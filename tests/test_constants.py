"""Values that results depend on, written out here once more, so that a wrong one can't pass on both sides of a comparison."""

from __future__ import annotations

import pytest

from tessella.functions import blocks, entropy
from tessella.functions.script import PAIRS, SINGLES, normalize_text
from tessella.operators import audio, policy, visual
from tessella.sources import media, requests


def test_transliteration():
    assert PAIRS == {"3'": "غ", "7'": "خ", "2'": "خ", "9'": "ض"}
    assert normalize_text("3'arb 7abib 2'3 9alam") == "غارب حابيب خع صالام"
    assert normalize_text("cpvx 01") == "cpvx 01" and normalize_text("KALB") == normalize_text("kalb") == "كالب"
    assert (SINGLES["5"], SINGLES["6"], SINGLES["8"], SINGLES["e"], SINGLES["u"]) == ("خ", "ط", "ق", "ا", "و")


def test_transform_tables():
    assert list(blocks.ZIGZAG[:10]) == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and list(blocks.ZIGZAG[-4:]) == [47, 55, 62, 63] and sorted(blocks.ZIGZAG) == list(range(64))
    assert list(blocks.LUMINANCE[:8]) == [16, 11, 10, 16, 24, 40, 51, 61] and list(blocks.LUMINANCE[-8:]) == [72, 92, 95, 98, 112, 100, 103, 99]
    assert [int(v) for v in blocks.quant_table(100)[:3]] == [1, 1, 1] and [int(v) for v in blocks.quant_table(10)[:3]] == [80, 55, 50] and int(blocks.quant_table(1)[0]) == 255


def test_limits():
    assert visual.THRESHOLDS == {"STRICT": 0.25, "MODERATE": 0.45}
    assert (audio.MUSIC_BPM, audio.MUSIC_CONFIDENCE, audio.HIGH_RMS, audio.HOP) == (110.0, 0.15, 0.80, 512)
    assert (media.MOST_BYTES, requests.MOST_BYTES) == (128 * 1024 * 1024, 64 * 1024)
    assert (entropy.TOP, entropy.HALF, entropy.QUARTER, entropy.THREE_QUARTERS) == (0xFFFFFFFF, 0x80000000, 0x40000000, 0xC0000000)


def test_messages():
    assert policy.ERRORS["Overflow"] == "Bitstream write operation exceeded capacity" and policy.ERRORS["InvalidInput"] == "Invalid input parameters or buffer state"
    assert policy.VIOLATIONS[:3] == ("NONE", "PROFANITY_EXACT", "PROFANITY_SEMANTIC") and policy.PRESETS == ("STRICT", "MODERATE")


def test_bits():
    w = entropy.BitWriter()
    w.write(0b101, 3)
    w.write_bytes(b"\xff\x00")
    assert w.bytes() == bytes([0b10111111, 0b11100000, 0]) and w.n == 19
    small = entropy.BitWriter(1)
    with pytest.raises(OverflowError):
        small.write_bytes(b"ab")
    with pytest.raises(ValueError):
        small.write(1, 65)
    small.write(7, 0)
    assert small.bytes() == b""


def test_capacity(spark):
    from tessella.operators import codec

    data = bytes(range(64))
    whole = entropy.encode(data)
    assert entropy.encode(data, capacity=len(whole)) == whole
    with pytest.raises(OverflowError):
        entropy.encode(data, capacity=len(whole) - 1)
    frames = spark.createDataFrame([(1, 8, 8, 50, bytearray(64)), (2, 8, 8, 100, bytearray(bytes((k * 37) % 256 for k in range(64))))], "frame_id long, width int, height int, quality int, data binary")
    assert {r["frame_id"]: (r["error"], r["stream"] is None) for r in codec.encode_images(frames, capacity=10).collect()} == {1: (None, False), 2: ("Overflow", True)}


def test_interleaved_images(spark):
    from tessella.plans.engine import Engine

    rows = [(1, 2, 2, 3, bytearray([200, 120, 90] * 4)), (2, 2, 2, 3, bytearray(12)), (3, 2, 2, 3, bytearray(5))]
    images = spark.createDataFrame(rows, "image_id long, width int, height int, channels int, data binary")
    assert {r["image_id"]: r["violation_type"] for r in Engine.build(spark).moderate_images(images).collect()} == {1: "EXPLICIT_BODY", 2: "NONE", 3: "NONE"}
