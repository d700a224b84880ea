from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from tessella.functions.script import normalize_text
from tessella.operators import audio, codec
from tessella.plans.engine import NO_FILE, OUTSIDE, Engine
from tessella.sources import lexicon, vocabulary


def test_serve(spark, tmp_path):
    (tmp_path / "media" / "sub").mkdir(parents=True)
    frame, pcm = bytes(range(256)) * 2, np.arange(-200, 200, dtype="<i2").tobytes()
    (tmp_path / "media" / "a.raw").write_bytes(frame)
    (tmp_path / "media" / "sub" / "b.pcm").write_bytes(pcm)
    (tmp_path / "lex.json").write_text(json.dumps(lexicon.NEUTRAL, ensure_ascii=False))
    (tmp_path / "model.bin").write_bytes(vocabulary.write_model(list(vocabulary.NEUTRAL.items()), 0.6))
    engine = Engine.build(spark, str(tmp_path / "lex.json"), ["", normalize_text("forbidden")], str(tmp_path / "model.bin"), media_root=str(tmp_path / "media"))
    cases = [
        {"action": "analyze_text", "text": "a forbidden word"},
        {"action": "analyze_text", "text": "fine"},
        {"action": "analyze_image", "file_path": "a.raw", "width": 16, "height": 32},
        {"action": "analyze_image", "file_path": "a.raw", "width": 16, "height": 33},
        {"action": "compress_image", "file_path": "a.raw", "width": 16, "height": 32, "quality_factor": 80},
        {"action": "compress_image", "file_path": "a.raw", "width": 16, "height": 16},
        {"action": "analyze_audio", "file_path": "sub/b.pcm", "sample_rate": 8000},
        {"action": "compress_audio", "file_path": "sub/b.pcm", "sample_rate": 8000, "channels": 2},
        {"action": "compress_audio", "file_path": "../lex.json", "sample_rate": 8000, "channels": 2},
        {"action": "resize", "file_path": "none"},
        {"action": "resize", "file_path": "a.raw"},
        {},
    ]
    rows = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cases)], "request_id long, value string")
    got = {r["request_id"]: json.loads(r["response"]) for r in engine.serve(rows).collect()}
    assert len(got) == len(cases)
    assert got[0]["result"]["violation_type"] == "PROFANITY_EXACT" and not got[0]["result"]["is_safe"]
    assert got[1]["result"]["is_safe"] and got[2]["result"]["is_safe"] and got[6]["result"]["is_safe"]
    assert got[3]["message"] == "invalid image dimensions or file size"
    assert got[4]["result"]["compressed_size"] == len(codec.encode_frame(frame, 16, 32, 80)) and got[4]["result"]["original_size"] == 512
    assert got[5]["result"]["compressed_size"] == len(codec.encode_frame(frame[:256], 16, 16, 50))
    assert got[7]["result"]["compressed_size"] == len(codec.encode_pcm(pcm, 2)) and got[7]["result"]["original_size"] == 800
    assert [got[k]["message"] for k in (8, 9, 10, 11)] == [OUTSIDE, NO_FILE, "unknown action: resize", "missing action"]


def test_build(spark, tmp_path, monkeypatch):
    assert Engine.build(spark, "").patterns == () and Engine.build(spark).with_keywords(["a", ""]).patterns == ("a",)
    (tmp_path / "bad.bin").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        Engine.build(spark, model=str(tmp_path / "bad.bin"))
    with pytest.raises(ValueError):
        Engine.build(spark).with_preset("LAX")
    monkeypatch.setenv("TESSELLA_PRESET", "MODERATE")
    assert Engine.from_environment(spark).preset == "MODERATE"


def test_clip_report_equals_the_table_form(spark):
    rng = np.random.default_rng(4)
    clips = {"noise": rng.standard_normal(9000), "beat": np.repeat(np.tile([1.0, 0, 0, 0, 0, 0], 4), 512), "short": np.ones(20), "bad": np.array([np.nan] * 5 + [1.0] * 95), "slow": np.repeat(rng.random(30), 512)}
    rows = pd.DataFrame([(k, i, float(x)) for k, v in clips.items() for i, x in enumerate(v)], columns=["clip_id", "i", "v"])
    samples = spark.createDataFrame(rows, "clip_id string, i long, v double")
    for preset in ("STRICT", "MODERATE"):
        for r in audio.moderate_audio(samples, 8000, preset).collect():
            want = audio.clip_report(clips[r["clip_id"]], 8000, preset)
            assert {k: r[k] for k in want if k not in ("risk_score", "bpm")} == {k: v for k, v in want.items() if k not in ("risk_score", "bpm")}
            assert abs(r["risk_score"] - want["risk_score"]) < 1e-9 and abs(r["bpm"] - want["bpm"]) < 1e-9


def test_images(spark):
    rows = [(1, 2, 2, [200] * 4, [120] * 4, [90] * 4), (2, 2, 2, [0] * 4, [0] * 4, [0] * 4)]
    images = spark.createDataFrame(rows, "image_id long, width int, height int, r array<int>, g array<int>, b array<int>")
    texts = spark.createDataFrame([(2, "scum")], "image_id long, extracted_text string")
    engine = Engine.build(spark, keywords=[normalize_text("scum")])
    assert {r["image_id"]: r["violation_type"] for r in engine.moderate_images(images, texts).collect()} == {1: "EXPLICIT_BODY", 2: "OCR_PROFANITY"}
    assert {r["image_id"]: r["is_safe"] for r in engine.moderate_images(images).collect()} == {1: False, 2: True}
