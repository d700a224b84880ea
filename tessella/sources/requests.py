"""JSON requests: parsing, validation, routing, and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields and actions of requests, and below the texts of errors.
SCHEMA = "action string, text string, file_path string, width bigint, height bigint, quality_factor bigint, sample_rate bigint, channels bigint"
MOST_BYTES = 65_536
ACTIONS = ("analyze_text", "analyze_image", "analyze_audio", "compress_image", "compress_audio")


def parse(requests: DataFrame, column: str = "value") -> DataFrame:
    """Adds the fields of a request; longer ones than MOST_BYTES and malformed ones have none."""
    body = F.when(F.octet_length(column) <= MOST_BYTES, F.from_json(column, SCHEMA))
    return requests.withColumn("r", body).select(*requests.columns, "r.*")


def route(parsed: DataFrame, size: Column | None = None) -> DataFrame:
    """Adds error (null for a request that can be served); size: bytes of the file, if it is known.

    The file is looked for before the action is known to be one, so an unknown action
    without a file is reported for the file.
    """
    size = F.lit(None).cast("bigint") if size is None else size
    no = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    short = F.coalesce(size < F.col("width") * F.col("height"), F.lit(False))
    bad_image = no("width") | no("height") | (F.col("width") > 65535) | (F.col("height") > 65535) | short
    odd = lambda n: F.coalesce(size % n != 0, F.lit(False))
    quality = F.coalesce("quality_factor", F.lit(50))
    is_ = lambda a: F.col("action") == a
    error = (
        F.when(F.col("action").isNull() | is_(""), "missing action")
        .when(is_("analyze_text"), F.when(F.col("text").isNull(), "missing text"))
        .when(F.col("file_path").isNull() | (F.col("file_path") == ""), "missing file_path")
        .when(is_("analyze_image"), F.when(bad_image, "invalid image dimensions or file size"))
        .when(is_("analyze_audio"), F.when(no("sample_rate") | odd(F.lit(2)), "invalid audio sample rate or PCM16 file"))
        .when(is_("compress_image"), F.when(bad_image | (F.col("width") % 8 != 0) | (F.col("height") % 8 != 0) | ~quality.between(1, 100), "invalid image compression parameters"))
        .when(is_("compress_audio"), F.when(no("sample_rate") | no("channels") | (F.col("channels") > 2) | odd(2 * F.col("channels")), "invalid audio compression parameters"))
        .otherwise(F.concat(F.lit("unknown action: "), F.col("action")))
    )
    return parsed.withColumn("error", error)


def moderation_response(report: DataFrame) -> Column:
    """Valid JSON of a moderation report with columns is_safe, risk_score, violation_type, matched_pattern."""
    return F.to_json(F.struct(F.lit("success").alias("status"), F.struct("is_safe", "risk_score", "violation_type", F.coalesce("matched_pattern", F.lit("")).alias("matched_pattern")).alias("result")))


def error_response(message: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("status"), message.alias("message")))
