"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

import json
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.script import normalize, tokens
from ..operators import audio, codec, policy, text, visual
from ..sources import lexicon, media, requests, tables, vocabulary
from ..streaming import pipelines
from .engine import VARIABLES, Engine
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}
PATTERNS = [p for ps in lexicon.NEUTRAL.values() for p in ps]
QUALITY = 50
LEAST_AREA = 4


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.load(spark, sf, "documents").select("doc_id", "text")


# Text.


@_query
def moderate_text(spark, sf):
    out = text.moderate_text(_docs(spark, sf), PATTERNS, vocabulary.neutral_scores(spark), vocabulary.NEUTRAL_THRESHOLD)
    return out.withColumn("risk_score", F.round("risk_score", 6))


@_query
def text_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(normalize(F.col("text")).cast("binary")).alias("normalized_md5"), F.length(normalize(F.col("text"))).alias("n_chars"))


@_query
def text_first_match(spark, sf):
    return text.with_first_match(_docs(spark, sf), PATTERNS).select("doc_id", "matched_pattern").where("matched_pattern is not null")


@_query
def text_all_matches(spark, sf):
    return text.all_matches(_docs(spark, sf), PATTERNS)


@_query
def text_contains_any(spark, sf):
    return _docs(spark, sf).select("doc_id", text.contains_any(normalize(F.col("text")), PATTERNS).alias("hit"))


@_query
def text_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "\n").cast("binary")).alias("tokens_md5"))


@_query
def semantic_score(spark, sf):
    return text.semantic_scores(_docs(spark, sf), vocabulary.neutral_scores(spark)).withColumn("score", F.round("score", 6))


@_query
def semantic_gate(spark, sf):
    scored = text.semantic_scores(_docs(spark, sf), vocabulary.neutral_scores(spark))
    return text.semantic_gate(scored, vocabulary.NEUTRAL_THRESHOLD).select("doc_id", "flagged", "category")


@_query
def text_token_retry(spark, sf):
    """Searching the tokens as well as the whole text changes nothing."""
    n = _docs(spark, sf).select("doc_id", normalize(F.col("text")).alias("n"))
    return n.select("doc_id", text.contains_any(F.col("n"), PATTERNS).alias("hit"), F.exists(tokens(F.col("n")), lambda t: text.contains_any(t, PATTERNS)).alias("token_hit"))


@_query
def lexicon_status(spark, sf):
    folder = _shared(spark, "lexicons")
    _write_bytes(spark, f"{folder}/good.json", json.dumps(lexicon.NEUTRAL, ensure_ascii=False).encode())
    _write_bytes(spark, f"{folder}/bad.json", b"no lexicon")
    cases = {"good": f"{folder}/good.json", "malformed": f"{folder}/bad.json", "missing": f"{folder}/none.json", "folder": folder, "empty": ""}
    size = lambda path: lexicon.read_lexicon(spark, path, tolerant=True).count()
    rows = [(k, ok, size(path) if ok else 0) for k, path in cases.items() for ok in [lexicon.load_status(spark, path)]]
    return spark.createDataFrame(rows, "name string, loaded boolean, n_patterns long")


@_query
def lexicon_keywords(spark, sf):
    added = lexicon.add_keywords(lexicon.from_dict(spark, lexicon.NEUTRAL), ["more", "", "yet more"])
    return added.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("pattern")), "|").alias("patterns"))


@_query
def lexicon_explode(spark, sf):
    return lexicon.explode_json(spark.createDataFrame([(json.dumps(lexicon.NEUTRAL),)], "value string"))


@_query
def ocr_moderate(spark, sf):
    turns = tables.load(spark, sf, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image_id"), F.col("text").alias("extracted_text"))
    return text.moderate_extracted(turns, PATTERNS, "image_id")


@_query
def violation_summary(spark, sf):
    docs = tables.load(spark, sf, "documents").select("doc_id", "text", "lang")
    found = text.with_first_match(docs, PATTERNS)
    hit = F.col("matched_pattern").isNotNull()
    reports = found.select("lang", (~hit).alias("is_safe"), F.when(hit, "PROFANITY_EXACT").otherwise("NONE").alias("violation_type"))
    return policy.violation_summary(reports, "lang")


# Images.


def _masks(spark, sf):
    return visual.skin_mask(tables.rgb_images(spark, sf))


@_query
def skin_pixels(spark, sf):
    return visual.skin_pixels(tables.pixels(tables.rgb_images(spark, sf)))


@_query
def skin_ratio(spark, sf):
    return visual.skin_ratio(_masks(spark, sf)).select("image_id", F.round("skin_ratio", 6).alias("skin_ratio"))


@_query
def skin_mask(spark, sf):
    return _masks(spark, sf).select("image_id", F.array_join("mask", "").alias("mask"))


@_query
def skin_components(spark, sf):
    return visual.components(_masks(spark, sf), LEAST_AREA).select("image_id", "x", "y", "width", "height", "pixel_count")


@_query
def exposure_ratio(spark, sf):
    masks = _masks(spark, sf)
    areas = masks.select("image_id", (F.col("width") * F.col("height")).alias("area"))
    return visual.exposure_ratio(visual.components(masks, LEAST_AREA), areas).withColumn("exposure_ratio", F.round("exposure_ratio", 6))


def _rated(spark, sf):
    docs = text.with_first_match(_docs(spark, sf), PATTERNS).select(F.col("doc_id").alias("image_id"), F.col("matched_pattern").isNotNull().alias("has_violation"))
    return visual.skin_ratio(_masks(spark, sf)).join(docs, "image_id", "left")


@_query
def moderate_image(spark, sf):
    out = visual.moderate_image(_rated(spark, sf))
    return out.withColumns({"risk_score": F.round("risk_score", 6), "skin_ratio": F.round("skin_ratio", 6)})


@_query
def moderate_image_moderate(spark, sf):
    out = visual.moderate_image(_rated(spark, sf), "MODERATE")
    return out.withColumns({"risk_score": F.round("risk_score", 6), "skin_ratio": F.round("skin_ratio", 6)})


@_query
def blob_skin_ratio(spark, sf):
    """Interleaved bytes; every tenth image is cut short, every eleventh has one channel."""
    images, k = tables.rgb_images(spark, sf), F.col("image_id")
    text_ = F.array_join(F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.concat(*(F.lpad(F.hex(p[c]), 2, "0") for c in "rgb"))), "")
    data = F.when(k % 10 == 9, F.substring(F.unhex(text_), 1, 100)).otherwise(F.unhex(text_))
    blobs = images.select("image_id", "width", "height", F.when(k % 11 == 10, 1).otherwise(3).alias("channels"), data.alias("data"))
    return visual.blob_skin_ratio(blobs).select("image_id", F.round("skin_ratio", 6).alias("skin_ratio"), "error")


# Audio.


def _events(spark, sf):
    """Event values as clips; some types hold enough bad samples to count as corrupted."""
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    bad = F.expr("event_id % 40 = 0 and length(event_type) % 2 = 0 or event_id % 400 = 0")
    return tables.load(spark, sf, "events").select(F.col("event_type").alias("clip_id"), i.cast("long").alias("i"), F.when(bad, F.lit(float("nan"))).otherwise(F.col("value") / 100).alias("v"))


@_query
def audio_corruption(spark, sf):
    return audio.signal_quality(_events(spark, sf)).select("clip_id", "n_samples", "n_invalid", "is_corrupted")


@_query
def audio_rms(spark, sf):
    return audio.signal_quality(tables.clips(spark, sf)).select("clip_id", F.round("rms", 6).alias("rms"))


def _short_clips(spark, sf):
    return tables.load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


@_query
def audio_dft(spark, sf):
    return audio.spectrum(_short_clips(spark, sf), "vec_id").withColumn("magnitude", F.round("magnitude", 4))


@_query
def spectral_centroid(spark, sf):
    return audio.spectral_centroid(_short_clips(spark, sf), tables.PCM_RATE, "vec_id").withColumn("centroid", F.round("centroid", 3))


@_query
def onset_envelope(spark, sf):
    return audio.onset_envelope(tables.clips(spark, sf)).withColumn("flux", F.round("flux", 6))


@_query
def autocorrelation(spark, sf):
    low, high = audio.lag_range(tables.PCM_RATE, 1 << 30)
    return audio.autocorrelation(audio.onset_envelope(tables.clips(spark, sf)), [0, *range(low, high + 1)]).withColumn("value", F.round("value", 6))


@_query
def bpm_detect(spark, sf):
    out = audio.tempo(tables.clips(spark, sf), tables.PCM_RATE)
    return out.select("clip_id", F.round("bpm", 4).alias("bpm"), F.round("confidence", 6).alias("confidence"), "music_detected")


@_query
def moderate_audio(spark, sf):
    out = audio.moderate_audio(tables.clips(spark, sf), tables.PCM_RATE)
    return out.withColumns({"risk_score": F.round("risk_score", 6), "bpm": F.round("bpm", 4)})


@_query
def moderate_audio_corrupted(spark, sf):
    """Of signals with bad samples, those with too many."""
    return audio.moderate_audio(_events(spark, sf), tables.PCM_RATE).where("corrupted")


@_query
def moderate_audio_moderate(spark, sf):
    """Signals at twice their level, loud enough for the preset that passes music."""
    loud = tables.clips(spark, sf).withColumn("v", F.col("v") * F.when(F.col("clip_id") == "A", 1.0).otherwise(2.0))
    out = audio.moderate_audio(loud, tables.PCM_RATE, "MODERATE")
    return out.withColumns({"risk_score": F.round("risk_score", 6), "bpm": F.round("bpm", 4)})


@_query
def pcm16_to_float(spark, sf):
    def run(batches):
        for rows in batches:
            yield rows.assign(v=[audio.pcm16(d).tolist() for d in rows["data"]])[["clip_id", "v"]]

    floats = tables.pcm_clips(spark, sf).select("clip_id", "data").mapInPandas(run, "clip_id string, v array<double>")
    return floats.select("clip_id", F.posexplode("v").alias("i", "v")).select("clip_id", F.col("i").cast("long").alias("i"), "v")


# Compression.


@_query
def quant_table(spark, sf):
    from ..functions.blocks import quant_table as table

    rows = [(q, k, int(v)) for q in (1, 10, 49, 50, 75, 100) for k, v in enumerate(table(q))]
    return spark.createDataFrame(rows, "quality int, k int, q int")


def _long(df: DataFrame, column: str, name: str, kind: str = "double") -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("k", name)).withColumn(name, F.col(name).cast(kind))


@_query
def image_blocks(spark, sf):
    return _long(tables.level_shifted(spark, sf), "block", "v", "int")


@_query
def dct_forward(spark, sf):
    return _long(codec.dct(tables.level_shifted(spark, sf)), "coefficients", "c")


def _quantized(spark, sf):
    return codec.quantize(codec.dct(tables.level_shifted(spark, sf)), QUALITY)


@_query
def dct_quantize(spark, sf):
    return _long(_quantized(spark, sf), "quantized", "q", "int")


def _zigzag(spark, sf):
    return _quantized(spark, sf).select("vec_id", "label", "quantized", codec.zigzag("quantized").alias("zz"))


@_query
def zigzag(spark, sf):
    return _long(_zigzag(spark, sf), "zz", "q", "int")


@_query
def zigzag_int(spark, sf):
    v = (F.col("event_id") * 7919 % 65536 - 32768).cast("int")
    return tables.load(spark, sf, "events").select("event_id", v.alias("v"), codec.fold16(v).alias("folded"), codec.unfold16(codec.fold16(v)).alias("unfolded"))


@_query
def dc_delta(spark, sf):
    return codec.dc_delta(_zigzag(spark, sf), "label", "vec_id").select("vec_id", F.col("dc_delta").cast("int").alias("dc_delta"))


@_query
def ac_rle(spark, sf):
    runs = _zigzag(spark, sf).select("vec_id", F.posexplode(codec.run_lengths("zz")).alias("n", "r"))
    return runs.select("vec_id", "n", F.col("r.run").cast("int").alias("run"), F.col("r.value").cast("int").alias("value"))


def _restored(spark, sf):
    q = _quantized(spark, sf).select("vec_id", "quantized")
    return codec.inverse_dct(codec.dequantize(q, QUALITY))


@_query
def dct_inverse(spark, sf):
    return _long(_restored(spark, sf), "block", "v")


@_query
def image_reconstruct(spark, sf):
    pixel = F.transform("block", lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(v + 128))))
    return _long(_restored(spark, sf).select("vec_id", pixel.alias("px")), "px", "px", "int")


@_query
def audio_dpcm(spark, sf):
    return codec.dpcm(tables.pcm_samples(spark, sf)).select("clip_id", "i", F.col("residual").cast("int").alias("residual"), F.col("folded").cast("int").alias("folded"))


@_query
def motion_search(spark, sf):
    return codec.motion(tables.frames(spark, sf)).drop("residual")


@_query
def motion_residual(spark, sf):
    m = codec.motion(tables.frames(spark, sf))
    return m.select("video_id", "frame_no", "block", F.posexplode("residual").alias("k", "residual"))


@_query
def ac_roundtrip(spark, sf):
    from ..functions import entropy

    def run(batches):
        for rows in batches:
            back = [entropy.decode(entropy.encode(d), len(d)) for d in rows["data"]]
            yield rows.assign(back=back, same=[a == b for a, b in zip(rows["data"], back, strict=True)])[["clip_id", "back", "same"]]

    rows = tables.pcm_clips(spark, sf).select("clip_id", "data").mapInPandas(run, "clip_id string, back binary, same boolean")
    return rows.select("clip_id", F.octet_length("back").cast("long").alias("n_bytes"), F.lower(F.md5("back")).alias("md5"), "same")


@_query
def image_encode(spark, sf):
    coded = codec.encode_images(tables.gray_frames(spark, sf))
    return coded.select("frame_id", F.octet_length("stream").alias("n_bytes"), F.md5("stream").alias("md5"), "error")


@_query
def image_roundtrip(spark, sf):
    coded = codec.encode_images(tables.gray_frames(spark, sf), decode=True)
    return coded.select(F.col("frame_id").alias("vec_id"), F.lower(F.hex("decoded")).alias("px_hex"))


@_query
def image_symbols(spark, sf):
    """What the coder is given for images of four blocks."""
    coded = codec.image_symbols(tables.frames(spark, sf), "video_id", "frame_no")
    return coded.select("video_id", "frame_no", F.octet_length("symbols").cast("long").alias("n_symbols"), F.md5("symbols").alias("md5"))


@_query
def image_blocks_roundtrip(spark, sf):
    """Images of four blocks, coded with differences of first values and decoded."""
    frames = tables.frames(spark, sf).withColumn("frame_id", F.col("video_id") * 1_000_000 + F.col("frame_no"))
    return codec.encode_images(frames, decode=True).select("frame_id", F.lower(F.hex("decoded")).alias("px_hex"))


def _stereo(spark, sf):
    return tables.pcm_clips(spark, sf).withColumn("channels", F.lit(2))


@_query
def audio_symbols(spark, sf):
    """What the coder is given for clips of two channels."""
    coded = codec.audio_symbols(_stereo(spark, sf))
    return coded.select("clip_id", F.octet_length("symbols").cast("long").alias("n_symbols"), F.md5("symbols").alias("md5"))


@_query
def audio_stereo_roundtrip(spark, sf):
    coded = codec.encode_audio(_stereo(spark, sf), decode=True)
    return coded.select("clip_id", F.octet_length("decoded").cast("long").alias("n_bytes"), F.md5("decoded").alias("md5"), "error")


@_query
def bit_stream(spark, sf):
    """Fields of 3, 13, 0 and 1 bits and a byte, written and read back; a writer of two bytes overflows with more than 16 bits."""
    from ..functions import entropy

    def run(batches):
        for rows in batches:
            out = []
            for e in rows["event_id"].tolist():
                w, fields = entropy.BitWriter(), ((e % 8, 3), (e * 7919 % 8192, 13), (5, 0), (e % 2, 1))
                for value, bits in fields:
                    w.write(value, bits)
                w.write_bytes(bytes([e % 256]))
                data, small, error = w.bytes(), entropy.BitWriter(2), None
                r = entropy.BitReader(data)
                back = [r.read(bits) for _, bits in fields if bits]
                try:
                    small.write(0, 9 + e % 10)
                    small.write(1, 1)
                except OverflowError as x:
                    error = str(x)
                out.append((e, data.hex(), *back, entropy.bits_to_bytes(w.n), error))
            yield pd.DataFrame(out, columns=["event_id", "hex", "a", "b", "c", "n_bytes", "error"])

    events = tables.load(spark, sf, "events").select("event_id")
    return events.mapInPandas(run, "event_id long, hex string, a long, b long, c long, n_bytes long, error string")


@_query
def audio_encode(spark, sf):
    coded = codec.encode_audio(tables.pcm_clips(spark, sf))
    return coded.select("clip_id", F.octet_length("stream").alias("n_bytes"), F.md5("stream").alias("md5"), "error")


@_query
def audio_roundtrip(spark, sf):
    coded = codec.encode_audio(tables.pcm_clips(spark, sf), decode=True)
    return coded.select("clip_id", F.octet_length("decoded").cast("long").alias("n_bytes"), F.md5("decoded").alias("md5"))


@_query
def video_encode(spark, sf):
    coded = codec.encode_video(tables.frames(spark, sf))
    return coded.select("video_id", "frame_no", F.octet_length("stream").alias("n_bytes"), F.md5("stream").alias("md5"), "error")


@_query
def video_roundtrip(spark, sf):
    coded = codec.decode_video(codec.encode_video(tables.frames(spark, sf)))
    return coded.select("video_id", "frame_no", F.md5("decoded").alias("md5"), F.octet_length("decoded").alias("n_bytes"))


@_query
def compression_report(spark, sf):
    return codec.compression_report(codec.encode_images(tables.gray_frames(spark, sf)), "frame_id")


# Protocol.


@_query
def request_route(spark, sf):
    return requests.route(requests.parse(tables.requests(spark, sf))).select("request_id", "action", "error")


@_query
def request_errors(spark, sf):
    routed = requests.route(requests.parse(tables.requests(spark, sf)))
    return routed.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


@_query
def report_json(spark, sf):
    found = text.moderate_text(_docs(spark, sf), PATTERNS)
    return found.select("doc_id", requests.moderation_response(found).alias("response"))


@_query
def serve(spark, sf):
    """Requests of all kinds through an engine configured by variables, with files, a lexicon, keywords and a model."""
    folder = _shared(spark, "serve")
    files = {"media/a.raw": bytes(384), "media/b.raw": bytes(64), "media/a.pcm": bytes(8), "lexicon.json": json.dumps(lexicon.NEUTRAL, ensure_ascii=False).encode()}
    files["model.bin"] = vocabulary.write_model([*vocabulary.NEUTRAL.items()], vocabulary.NEUTRAL_THRESHOLD)
    for name, data in files.items():
        _write_bytes(spark, f"{folder}/{name}", data)
    variables = {VARIABLES["dictionary"]: f"{folder}/lexicon.json", VARIABLES["model"]: f"{folder}/model.bin", VARIABLES["media"]: f"{folder}/media", VARIABLES["preset"]: "MODERATE"}
    engine = Engine.from_environment(spark, variables).with_keywords(["added"]).with_preset("STRICT")
    out = engine.serve(tables.requests(spark, sf))
    field = lambda p: F.get_json_object("response", f"$.{p}")
    return out.select(
        "request_id", field("status").alias("status"), field("message").alias("message"), field("result.is_safe").alias("is_safe"), field("result.violation_type").alias("violation_type"),
        field("result.is_completed").alias("is_completed"), field("result.original_size").cast("long").alias("original_size"), F.coalesce(field("result.compressed_size").cast("long") > 0, F.lit(False)).alias("has_size"),
    )


@_query
def error_messages(spark, sf):
    return policy.error_table(spark)


@_query
def model_vocab(spark, sf):
    folder = _shared(spark, "model")
    words = [*vocabulary.NEUTRAL.items()]
    _write_bytes(spark, f"{folder}/neutral.bin", vocabulary.write_model([*words, (words[0][0], [1, 1, 1, 1])], vocabulary.NEUTRAL_THRESHOLD))
    return vocabulary.read_model(spark, folder).select("word", F.concat_ws(",", F.transform("weights", lambda w: w.cast("string"))).alias("weights"), F.round("threshold", 4).alias("threshold"))


@_query
def media_files(spark, sf):
    folder = _shared(spark, "media")
    for k in range(5):
        _write_bytes(spark, f"{folder}/clip_{k}.pcm", bytes(range(k * 10 + 10)))
    return media.read_media(spark, folder, "*.pcm").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.md5("content").alias("md5"))


@_query
def requests_stream(spark, sf):
    folder = _shared(spark, "requests")
    tables.requests(spark, sf).repartition(4).write.parquet(f"{folder}/in")
    pipelines.run_available(pipelines.request_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("request_id", "action", "error")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or in a local session without it, where one machine does all, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{root.rstrip('/')}/{name}-{spark.sql('select uuid()').first()[0]}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
