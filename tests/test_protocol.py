from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessella.operators import policy
from tessella.sources import media, requests


def test_routes(spark):
    cases = {
        "{}": "missing action",
        "no json": "missing action",
        '{"action": ""}': "missing action",
        '{"action": "analyze_text"}': "missing text",
        '{"action": "analyze_text", "text": "a \\u0041"}': None,
        '{"action": "unknown"}': "missing file_path",
        '{"action": "unknown", "file_path": "f"}': "unknown action: unknown",
        '{"action": "analyze_image", "file_path": "f", "width": 0, "height": 8}': "invalid image dimensions or file size",
        '{"action": "analyze_image", "file_path": "f", "width": 65536, "height": 1}': "invalid image dimensions or file size",
        '{"action": "analyze_image", "file_path": "f", "width": 8, "height": 8}': None,
        '{"action": "compress_image", "file_path": "f", "width": 8, "height": 9}': "invalid image compression parameters",
        '{"action": "compress_image", "file_path": "f", "width": 8, "height": 8, "quality_factor": 101}': "invalid image compression parameters",
        '{"action": "compress_image", "file_path": "f", "width": 8, "height": 8}': None,
        '{"action": "analyze_audio", "file_path": "f"}': "invalid audio sample rate or PCM16 file",
        '{"action": "compress_audio", "file_path": "f", "sample_rate": 8000, "channels": 3}': "invalid audio compression parameters",
        '{"action": "compress_audio", "file_path": "f", "sample_rate": 8000, "channels": 2}': None,
        '{"action": "analyze_text", "text": "' + "x" * 70_000 + '"}': "missing action",
    }
    rows = requests.route(requests.parse(spark.createDataFrame([(k,) for k in cases], "value string"))).collect()
    assert {r["value"]: r["error"] for r in rows} == cases


def test_file_sizes(spark):
    parsed = requests.parse(spark.createDataFrame([('{"action": "analyze_image", "file_path": "f", "width": 8, "height": 8}', 63), ('{"action": "analyze_audio", "file_path": "f", "sample_rate": 1}', 3)], "value string, size long"))
    assert [r["error"] for r in requests.route(parsed, F.col("size")).collect()] == ["invalid image dimensions or file size", "invalid audio sample rate or PCM16 file"]


def test_responses_are_json(spark):
    r = spark.createDataFrame([(False, 1.0, "PROFANITY_EXACT", 'a"\n')], "is_safe boolean, risk_score double, violation_type string, matched_pattern string")
    got = json.loads(r.select(requests.moderation_response(r)).first()[0])
    assert got["result"]["matched_pattern"] == 'a"\n' and got["status"] == "success"
    assert json.loads(r.select(requests.error_response(F.lit("x\\y"))).first()[0]) == {"status": "error", "message": "x\\y"}


def test_paths():
    assert media.inside("/data", "a/b.raw") and media.inside("/data", "/data/x")
    assert not media.inside("/data", "../x") and not media.inside("/data", "/etc/passwd") and not media.inside("/data", "") and not media.inside("/data", "/database")


def test_media_size_limit(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(b"12345")
    (tmp_path / "b.raw").write_bytes(b"1" * 50)
    assert [r["length"] for r in media.read_media(spark, str(tmp_path), "*.raw", most=10).collect()] == [5]


def test_messages_and_reports(spark):
    rows = policy.with_message(spark.createDataFrame([("Overflow",), ("Other",), (None,)], "error string")).collect()
    assert [r["message"] for r in rows] == [policy.ERRORS["Overflow"], "Unknown error", None]
    report = policy.content_report(spark.createDataFrame([(1, True, 0.0, "NONE")], "k int, is_safe boolean, risk_score double, violation_type string"), "k").first()
    assert report["visual"]["skin_percentage"] == 0.0 and not report["text"]["flagged"] and report["audio"]["bpm"] == 0.0
