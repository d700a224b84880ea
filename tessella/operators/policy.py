"""Reports: schemas, presets, kinds of violation, error messages, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of violation and error messages.
VIOLATIONS = ("NONE", "PROFANITY_EXACT", "PROFANITY_SEMANTIC", "OCR_PROFANITY", "EXPLICIT_BODY", "CORRUPTED_AUDIO", "MUSIC_DETECTED", "HIGH_ENERGY_AUDIO")
ERRORS = {
    "None": "No error",
    "BufferTooSmall": "Destination buffer is too small",
    "InvalidInput": "Invalid input parameters or buffer state",
    "CorruptedData": "Corrupted bitstream or data structure",
    "HighEntropyRejected": "High entropy input rejected during pre-flight check",
    "AlignmentError": "Buffer does not satisfy required 64-byte alignment",
    "Overflow": "Bitstream write operation exceeded capacity",
}
PRESETS = ("STRICT", "MODERATE")

CONTENT_REPORT = "is_safe boolean, risk_score double, violation_type string, text struct<flagged:boolean, matched_pattern:string>, visual struct<flagged:boolean, skin_percentage:double>, audio struct<flagged:boolean, corrupted:boolean, bpm:double>"


def error_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERRORS.items()), "error string, message string")


def with_message(rows: DataFrame, error: str = "error") -> DataFrame:
    """Adds the message of an error code; an unknown code has "Unknown error", none has none."""
    known = F.create_map(*(F.lit(x) for pair in ERRORS.items() for x in pair))
    return rows.withColumn("message", F.when(F.col(error).isNotNull(), F.coalesce(F.element_at(known, F.col(error)), F.lit("Unknown error"))))


def content_report(rows: DataFrame, *keys: str) -> DataFrame:
    """The nested report of moderation rows; columns that a modality lacks count as clean."""
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in rows.columns else F.lit(other)
    kind = F.col("violation_type")
    text = F.struct(kind.isin("PROFANITY_EXACT", "PROFANITY_SEMANTIC", "OCR_PROFANITY").alias("flagged"), has("matched_pattern", "").alias("matched_pattern"))
    visual = F.struct((kind == "EXPLICIT_BODY").alias("flagged"), has("skin_ratio", 0.0).alias("skin_percentage"))
    audio = F.struct(has("flagged", False).alias("flagged"), has("corrupted", False).alias("corrupted"), has("bpm", 0.0).alias("bpm"))
    return rows.select(*keys, "is_safe", "risk_score", "violation_type", text.alias("text"), visual.alias("visual"), audio.alias("audio"))


def violation_summary(reports: DataFrame, *groups: str) -> DataFrame:
    """(groups, violation_type, n, n_unsafe)."""
    return reports.groupBy(*groups, "violation_type").agg(F.count("*").alias("n"), F.sum((~F.col("is_safe")).cast("long")).alias("n_unsafe"))
