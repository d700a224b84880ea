"""A configured engine: moderation of texts, images and audio, and requests to responses from end to end."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio, codec, policy, text, visual
from ..sources import lexicon, media, requests, vocabulary

#: Environment variables that from_environment() reads.
VARIABLES = {"dictionary": "TESSELLA_DICTIONARY", "model": "TESSELLA_MODEL", "media": "TESSELLA_MEDIA", "preset": "TESSELLA_PRESET"}
NO_FILE = "input file is missing or exceeds the size limit"
OUTSIDE = "file_path must be inside the media folder"
#: Files up to which only those that requests name are read.
MOST_NAMED = 10_000


@dataclass(frozen=True)
class Engine:
    """Patterns, an optional vocabulary with its threshold, a preset, and the folder of media files."""

    spark: SparkSession
    patterns: tuple[str, ...] = ()
    scores: DataFrame | None = None
    threshold: float = 0.5
    preset: str = "STRICT"
    media_root: str | None = None

    @classmethod
    def build(cls, spark: SparkSession, dictionary: str | None = None, keywords: list[str] = (), model: str | None = None, preset: str = "STRICT", media_root: str | None = None) -> Engine:
        """From paths; a dictionary that is missing is left out, a model that can't be used is an error."""
        if preset not in policy.PRESETS:
            raise ValueError(f"no such preset: {preset}")
        patterns = text.pattern_list(lexicon.read_lexicon(spark, dictionary, tolerant=True)) if lexicon.load_status(spark, dictionary) else []
        scores, threshold = None, 0.5
        if model:
            found = vocabulary.read_model(spark, model)
            first = found.first()
            if first is None:
                raise ValueError(f"not a vocabulary model: {model}")
            scores, threshold = vocabulary.word_scores(found), first["threshold"]
        return cls(spark, (*patterns, *(k for k in keywords if k)), scores, threshold, preset, media_root)

    @classmethod
    def from_environment(cls, spark: SparkSession, variables: Mapping[str, str] = os.environ) -> Engine:
        """From the variables named in VARIABLES; unset and empty ones are left out."""
        value = {k: variables.get(v) or None for k, v in VARIABLES.items()}
        return cls.build(spark, value["dictionary"], model=value["model"], preset=value["preset"] or "STRICT", media_root=value["media"])

    def with_keywords(self, words: list[str]) -> Engine:
        return replace(self, patterns=(*self.patterns, *(w for w in words if w)))

    def with_preset(self, preset: str) -> Engine:
        if preset not in policy.PRESETS:
            raise ValueError(f"no such preset: {preset}")
        return replace(self, preset=preset)

    def moderate_text(self, docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
        return text.moderate_text(docs, list(self.patterns), self.scores, self.threshold, key, column)

    def moderate_images(self, images: DataFrame, extracted: DataFrame | None = None, key: str = "image_id") -> DataFrame:
        """Images with arrays r, g, b, or with interleaved bytes (data, width, height, channels); extracted: (key, extracted_text) for those with text.

        Bytes too short for their image count as without skin; visual.blob_skin_ratio() names them.
        """
        if "data" in images.columns:
            rated = visual.blob_skin_ratio(images.withColumnRenamed(key, "image_id")).select(F.col("image_id").alias(key), F.coalesce("skin_ratio", F.lit(0.0)).alias("skin_ratio"))
        else:
            rated = visual.skin_ratio(visual.skin_mask(images)).select(key, "skin_ratio")
        if extracted is None:
            rated = rated.withColumn("has_violation", F.lit(False))
        else:
            rated = rated.join(text.moderate_extracted(extracted, list(self.patterns), key), key, "left")
        return visual.moderate_image(rated, self.preset, key)

    def moderate_audio(self, samples: DataFrame, rate: int) -> DataFrame:
        return audio.moderate_audio(samples, rate, self.preset)

    def serve(self, incoming: DataFrame) -> DataFrame:
        """(request_id, response) of requests (request_id, value): one JSON response each, an error where one can't be served.

        Images of requests have one channel, so they are never flagged for skin.
        """
        parsed = requests.parse(incoming.select("request_id", "value"))
        root, spark = self.media_root, self.spark
        if root is None:
            files = spark.createDataFrame([], "name string, length long, content binary")
        else:
            top = F.lit(root.rstrip("/").removeprefix("file://") + "/")
            path = F.regexp_replace("path", "^file:/*", "/")
            files = media.read_media(spark, root).select(F.replace(path, top, F.lit("")).alias("name"), "length", "content")
        outside = F.coalesce(F.col("file_path").rlike(r"(^|/)\.\.(/|$)|^/"), F.lit(False))
        needs_file = F.col("action").isNotNull() & (F.col("action") != "") & (F.col("action") != "analyze_text") & F.col("file_path").isNotNull() & (F.col("file_path") != "")
        wanted = parsed.withColumn("name", F.when(needs_file & ~outside, F.col("file_path")))
        sized = wanted.join(files.select("name", "length"), "name", "left")
        routed = requests.route(sized, F.col("length"))
        error = F.when(needs_file & outside, OUTSIDE).when(needs_file & F.col("length").isNull(), NO_FILE).otherwise(F.col("error"))
        routed = routed.withColumn("error", error)
        failed = routed.where("error is not null").select("request_id", requests.error_response(F.col("error")).alias("response"))
        good = routed.where("error is null")
        told = self.moderate_text(good.where("action = 'analyze_text'").select("request_id", "text"), "request_id")
        texts = told.select("request_id", requests.moderation_response(told).alias("response"))
        preset = self.preset

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out = [_media_response(r, preset) for r in rows.to_dict("records")]
                yield pd.DataFrame({"request_id": rows["request_id"], "response": out})

        work = good.where("action <> 'analyze_text'")
        if root is not None:
            files = self._contents(work, files)
        work = work.join(files.select("name", "content"), "name")
        columns = ["request_id", "action", "width", "height", "quality_factor", "sample_rate", "channels", "content"]
        kind = incoming.schema["request_id"].dataType.simpleString()
        served = work.select(*columns).mapInPandas(run, f"request_id {kind}, response string")
        return failed.unionByName(texts).unionByName(served)


    def _contents(self, work: DataFrame, files: DataFrame) -> DataFrame:
        """(name, content) of the files that requests name: these alone if they are few, else all below the root."""
        names = [r["name"] for r in work.select("name").distinct().limit(MOST_NAMED + 1).collect()]
        if not 0 < len(names) <= MOST_NAMED or any(c in n for n in names for c in "*?[]{}\\"):
            return files.select("name", "content")
        top = self.media_root.rstrip("/")
        read = self.spark.read.format("binaryFile").load([f"{top}/{n}" for n in names])
        path = F.regexp_replace("path", "^file:/*", "/")
        return read.select(F.replace(path, F.lit(top.removeprefix("file://") + "/"), F.lit("")).alias("name"), "content")


def _media_response(r: dict, preset: str) -> str:
    data = r["content"]
    if r["action"].startswith("analyze"):
        report = {"is_safe": True, "risk_score": 0.0, "violation_type": "NONE", "bpm": 0.0}
        if r["action"] == "analyze_audio":
            report |= audio.clip_report(audio.pcm16(data), int(r["sample_rate"]), preset)
        return json.dumps({"status": "success", "result": report})
    if r["action"] == "compress_image":
        w, h = int(r["width"]), int(r["height"])
        quality = 50 if pd.isna(r["quality_factor"]) else int(r["quality_factor"])
        size, stream = w * h, codec.encode_frame(data[: w * h], w, h, quality)
    elif data:
        size, stream = len(data), codec.encode_pcm(data, int(r["channels"]))
    else:
        return json.dumps({"status": "error", "message": policy.ERRORS["InvalidInput"]})
    report = {"is_completed": True, "original_size": size, "compressed_size": len(stream), "compression_ratio": len(stream) / size, "throughput_mbps": 0.0, "latency_ms": 0.0}
    return json.dumps({"status": "success", "result": report})
