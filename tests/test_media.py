from __future__ import annotations

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import blocks as B
from tessella.functions import entropy
from tessella.operators import audio, codec, visual


@given(st.binary(max_size=400), st.integers(1, 4))
@settings(max_examples=40, deadline=None)
def test_coder_round_trip(data, order):
    assert entropy.decode(entropy.encode(data, order), len(data), order) == data


def test_coder_sizes_of_zeros():
    assert [len(entropy.encode([0] * n)) for n in (1, 2, 3, 4, 5)] == [2, 2, 3, 4, 4]


def test_coder_rescales():
    data = bytes([1, 1, 1, 2] * 10_000)
    assert entropy.decode(entropy.encode(data), len(data)) == data


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 64)), max_size=20))
@settings(deadline=None)
def test_bits(fields):
    w = entropy.BitWriter()
    for value, n in fields:
        w.write(value, n)
    r = entropy.BitReader(w.bytes())
    assert [r.read(n) for _, n in fields] == [v & ((1 << n) - 1) for v, n in fields]


def test_bit_limits():
    w = entropy.BitWriter(1)
    for bits, error in ((65, ValueError), (9, OverflowError)):
        try:
            w.write(0, bits)
            raise AssertionError
        except error:
            pass


def test_quant_tables():
    assert B.quant_table(50).tolist() == B.LUMINANCE
    assert set(B.quant_table(100)) == {1} and B.quant_table(1).max() == 255 and B.quant_table(0).tolist() == B.quant_table(1).tolist()
    assert sorted(B.ZIGZAG) == list(range(64))


def test_rounding_and_folding():
    assert B.half_away(np.array([0.5, -0.5, 2.5, -2.5])).tolist() == [1, -1, 3, -3]
    assert [int(B.fold16(v)) for v in (0, -1, 1, -3, 32767, -32768)] == [0, 1, 2, 5, 65534, 65535]
    assert all(B.unfold16(int(B.fold16(v))) == v for v in range(-32768, 32768, 97))
    assert all(codec.unfold8(codec.fold8(v)) == v for v in range(-128, 128))
    assert B.wrap16(32767 - -32768) == -1


def test_transform_inverts():
    x = np.random.default_rng(0).integers(-128, 128, (20, 64)).astype(float)
    assert np.allclose(B.inverse(B.forward(x)), x, atol=1e-4)


def frame(seed: int, h: int = 16, w: int = 24) -> bytes:
    return np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8).tobytes()


def expected(data: bytes, w: int, h: int, q: int) -> bytes:
    b = B.split(np.frombuffer(data, np.uint8).reshape(h, w).astype(float)) - 128
    t = B.quant_table(q)
    return B.join(B.to_pixels(B.inverse(B.quantize(B.forward(b), t) * t) + 128), w).tobytes()


def test_frames_with_last_coefficient():
    for q in (1, 49, 50, 100):
        for data in (frame(q), bytes([128] * 384)):
            assert codec.decode_frame(codec.encode_frame(data, 24, 16, q), 24, 16, q) == expected(data, 24, 16, q)


def test_image_errors(spark):
    rows = [(1, 24, 16, 50, frame(1)), (2, 12, 16, 50, frame(1)), (3, 24, 16, 50, b"short"), (4, 0, 0, 50, b""), (5, 24, 16, 50, None)]
    got = {r["frame_id"]: r["error"] for r in codec.encode_images(spark.createDataFrame(rows, "frame_id long, width int, height int, quality int, data binary")).collect()}
    assert got == {1: None, 2: "InvalidInput", 3: "InvalidInput", 4: "InvalidInput", 5: "InvalidInput"}


@given(st.lists(st.integers(-32768, 32767), min_size=1, max_size=60), st.integers(1, 2))
@settings(max_examples=30, deadline=None)
def test_audio_round_trip(samples, channels):
    samples = (samples * channels)[: len(samples) // channels * channels or channels]
    data = np.array(samples, "<i2").tobytes()
    assert codec.decode_pcm(codec.encode_pcm(data, channels), len(samples) // channels, channels) == data


def test_audio_errors(spark):
    rows = [("a", 1, b"ab"), ("b", 2, b"ab"), ("c", 3, b"abcdef"), ("d", 1, b""), ("e", 1, None)]
    got = {r["clip_id"]: r["error"] for r in codec.encode_audio(spark.createDataFrame(rows, "clip_id string, channels int, data binary")).collect()}
    assert {k for k, v in got.items() if v is None} == {"a"}


def video(spark, n: int = 5):
    base = np.random.default_rng(3).integers(0, 256, (24, 32), dtype=np.uint8)
    rows = [(1, k, 0 if k == 0 else 1, 32, 24, 80, 4, np.roll(base, (k, 2 * k), (0, 1)).tobytes()) for k in range(n)]
    rows += [(2, 0, 1, 32, 24, 80, 4, base.tobytes()), (2, 1, 1, 12, 24, 80, 4, base.tobytes())]
    return spark.createDataFrame(rows, "video_id int, frame_no long, frame_type int, width int, height int, quality int, search_window int, data binary")


def test_video(spark):
    frames = video(spark)
    coded = codec.encode_video(frames).toPandas()
    assert coded[coded.video_id == 2].sort_values("frame_no")["error"].isna().tolist() == [True, False]
    assert coded[(coded.video_id == 2) & (coded.frame_no == 0)]["stream"].iloc[0][0] == 1
    for closed in (False, True):
        back = codec.decode_video(codec.encode_video(frames, closed)).toPandas()
        ok = back[back.video_id == 1].sort_values("frame_no")
        error = [np.abs(np.frombuffer(a, np.uint8).astype(int) - np.frombuffer(b, np.uint8)).mean() for a, b in zip(ok["data"], ok["decoded"], strict=True)]
        assert max(error) < (12 if closed else 20)


def test_video_stream_equals_batch(spark, tmp_path):
    from tessella.streaming import pipelines

    frames = video(spark)
    frames.write.parquet(str(tmp_path / "in"))
    stream = pipelines.encode_video_stream(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")))
    pipelines.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.video_id, r.frame_no): r.stream for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.video_id, r.frame_no): r.stream for r in codec.encode_video(frames).collect()}


def test_motion_takes_least_offsets():
    flat = np.full((24, 32), 7, np.uint8)
    assert B.best_vectors(flat, flat, 4)[0] == (0, 0, 0)
    assert B.best_vectors(flat, flat, 4)[5] == (-4, -4, 0)


def skin_image(n: int) -> tuple[list[int], list[int], list[int]]:
    return [200] * n + [0] * (100 - n), [120] * n + [0] * (100 - n), [90] * n + [0] * (100 - n)


def test_skin_thresholds(spark):
    rows = [(n, 10, 10, *skin_image(n)) for n in (24, 25, 44, 45)]
    masked = visual.skin_ratio(visual.skin_mask(spark.createDataFrame(rows, "image_id long, width int, height int, r array<int>, g array<int>, b array<int>")))
    rated = masked.selectExpr("image_id", "skin_ratio", "image_id = 24 as has_violation")
    strict = {r["image_id"]: (r["is_safe"], r["risk_score"], r["violation_type"]) for r in visual.moderate_image(rated).collect()}
    assert strict == {24: (False, 1.0, "OCR_PROFANITY"), 25: (False, 1.0, "EXPLICIT_BODY"), 44: (False, 1.0, "EXPLICIT_BODY"), 45: (False, 1.0, "EXPLICIT_BODY")}
    moderate = {r["image_id"]: r["is_safe"] for r in visual.moderate_image(rated.withColumn("has_violation", rated.image_id.isNull()), "MODERATE").collect()}
    assert moderate == {24: True, 25: True, 44: True, 45: False}
    blobs = [(n, bytes(np.array([r, g, b], np.uint8).T.ravel()), 10, 10, 3) for n, _, _, r, g, b in rows] + [(1, b"", 1, 1, 3), (2, b"abc", 1, 1, 1), (3, b"ab", 1, 1, 3)]
    got = {r["image_id"]: (r["skin_ratio"], r["error"]) for r in visual.blob_skin_ratio(spark.createDataFrame(blobs, "image_id long, data binary, width int, height int, channels int")).collect()}
    assert got == {24: (0.24, None), 25: (0.25, None), 44: (0.44, None), 45: (0.45, None), 1: (0.0, None), 2: (0.0, None), 3: (0.0, "InvalidInput")}


def flood(mask: np.ndarray, least: int):
    h, w = mask.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if mask[y, x] == 1 and (y, x) not in seen:
                todo, own = [(y, x)], set()
                while todo:
                    p = todo.pop()
                    if p in seen:
                        continue
                    seen.add(p)
                    own.add(p)
                    todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= p[0] + a < h and 0 <= p[1] + b < w and mask[p[0] + a, p[1] + b] == 1]
                if len(own) >= least:
                    ys, xs = [p[0] for p in own], [p[1] for p in own]
                    out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
    return out


@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.integers(1, 12), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_components(seed, h, w, least):
    mask = np.random.default_rng(seed).choice([0, 1, 2], (h, w), p=[0.5, 0.4, 0.1])
    assert visual.label_components(mask, least) == flood(mask, least)


def samples(spark, clips: dict[str, list[float]]):
    return spark.createDataFrame(pd.DataFrame([(k, i, float(v)) for k, s in clips.items() for i, v in enumerate(s)], columns=["clip_id", "i", "v"]), "clip_id string, i long, v double")


def test_corruption(spark):
    nan = float("nan")
    clips = {"a99": [nan] + [1.0] * 98, "b100": [nan] + [1.0] * 99, "c200": [nan, float("inf"), nan] + [1.0] * 197, "d": [nan], "e": [0.5, -0.5]}
    got = {r["clip_id"]: (r["is_corrupted"], r["rms"]) for r in audio.signal_quality(samples(spark, clips)).collect()}
    assert got == {"a99": (True, 0.0), "b100": (False, 1.0), "c200": (True, 0.0), "d": (True, 0.0), "e": (False, 0.5)}


def test_tempo(spark):
    rate = 8192
    beat = np.zeros(rate * 4)
    beat[:: 512 * 6] = 1.0
    clips = {"beat": np.repeat(np.tile([1.0] + [0.0] * 5, 11), 512)[: rate * 4].tolist(), "short": [1.0] * 100, "silent": [0.0] * rate}
    got = {r["clip_id"]: r for r in audio.tempo(samples(spark, clips), rate).collect()}
    assert got["beat"]["bpm"] == 60 * 16 / 6 and got["beat"]["music_detected"]
    assert got["short"]["bpm"] == 0.0 and got["silent"]["bpm"] == 0.0 and not got["silent"]["music_detected"]
    report = {r["clip_id"]: r["violation_type"] for r in audio.moderate_audio(samples(spark, clips), rate).collect()}
    assert report == {"beat": "MUSIC_DETECTED", "short": "NONE", "silent": "NONE"}
    assert {r["violation_type"] for r in audio.moderate_audio(samples(spark, clips), rate, "MODERATE").collect()} == {"NONE"}


def test_envelope_skips_nan(spark):
    s = [0.0] * 512 + [float("nan")] * 512 + [1.0] * 512 + [2.0] * 512 + [9.0] * 5
    got = [r["flux"] for r in audio.onset_envelope(samples(spark, {"a": s})).orderBy("frame").collect()]
    assert got == [0.0, 0.0, 0.0, 1.0]


def test_pcm16():
    assert audio.pcm16(b"\x00\x80\xff\x7f\x01").tolist() == [-1.0, 32767 / 32768]
