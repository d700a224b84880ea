"""Audio moderation over samples (clip_id, i, v): corruption, level, spectrum, onsets, tempo and the verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Frame length, longest transform, tempo range, and limits of the verdict.
HOP, MOST_DFT = 512, 1024
SLOWEST, FASTEST = 60.0, 200.0
MUSIC_BPM, MUSIC_CONFIDENCE, HIGH_RMS = 110.0, 0.15, 0.80

_FINITE = "not isnan(v) and abs(v) < double('Infinity')"


def pcm16(data: bytes) -> np.ndarray:
    """Little-endian 16-bit samples as floats from -1 to 1; an odd last byte is left out."""
    return np.frombuffer(data, "<i2", len(data) // 2) / 32768


def signal_quality(samples: DataFrame) -> DataFrame:
    """(clip_id, n_samples, n_invalid, is_corrupted, rms): corrupted if over a hundredth of the samples (whole division) are not finite, or all are."""
    bad = f"v is null or not ({_FINITE})"
    out = samples.groupBy("clip_id").agg(
        F.count("*").alias("n_samples"),
        F.expr(f"count_if({bad})").alias("n_invalid"),
        F.expr(f"avg(case when {_FINITE} then v * v end)").alias("square"),
    )
    corrupted = (F.expr("n_invalid > n_samples div 100")) | (F.col("n_invalid") == F.col("n_samples"))
    return out.select("clip_id", "n_samples", "n_invalid", corrupted.alias("is_corrupted"), F.when(~corrupted, F.sqrt("square")).otherwise(0.0).alias("rms"))


def hann_dft(signal: np.ndarray) -> np.ndarray:
    """Magnitudes of the bins 0 to n/2 of the first samples under a Hann window."""
    x = signal[:MOST_DFT]
    n = len(x)
    if n == 1:
        return np.array([np.nan])
    return np.abs(np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))))


def _per_clip(clips: DataFrame, key: str, schema: str, rows_of) -> DataFrame:
    kind = clips.schema[key].dataType.simpleString()
    types = {"int": pa.int32(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, columns = [], [[] for _ in fields]
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = rows_of(s.values.to_numpy(zero_copy_only=False).astype(np.float64)) if s.is_valid and len(s.values) else []
                for r in got:
                    keys.append(k)
                    for c, v in zip(columns, r, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), *(pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True))], names=[key, *(n for n, _ in fields)])

    return clips.select(key, "samples").mapInArrow(run, f"{key} {kind}, {schema}")


def spectrum(clips: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, bin, magnitude) of clips (key, samples)."""
    return _per_clip(clips, key, "bin int, magnitude double", lambda s: list(enumerate(hann_dft(s).tolist())))


def centroid(magnitudes: np.ndarray, n: int, rate: float) -> float:
    m = magnitudes[1:]
    total = m.sum()
    return float((np.arange(1, len(magnitudes)) * (rate / n) * m).sum() / total) if total > 1e-6 else 0.0


def spectral_centroid(clips: DataFrame, rate: float, key: str = "clip_id") -> DataFrame:
    """(key, centroid): mean frequency by magnitude without bin 0; 0 for silence."""
    return _per_clip(clips, key, "centroid double", lambda s: [(centroid(hann_dft(s), min(len(s), MOST_DFT), rate),)])


def onset_envelope(samples: DataFrame, hop: int = HOP) -> DataFrame:
    """(clip_id, frame, flux): rise of the frames' RMS; a frame after or with a NaN has none, and a last short frame is dropped."""
    frames = samples.groupBy("clip_id", F.expr(f"i div {hop}").alias("frame")).agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("v") * F.col("v")) / hop).alias("energy")).where(f"n = {hop}")
    rise = F.col("energy") - F.lag("energy", 1, 0.0).over(Window.partitionBy("clip_id").orderBy("frame"))
    return frames.select("clip_id", "frame", F.when(F.isnan(rise) | (rise < 0), 0.0).otherwise(rise).alias("flux"))


def lag_range(rate: float, frames: int, hop: int = HOP) -> tuple[int, int]:
    per_second = rate / hop
    return max(1, int(per_second * 60 / FASTEST)), min(frames - 1, int(per_second * 60 / SLOWEST))


def autocorrelation(envelope: DataFrame, lags: list[int]) -> DataFrame:
    """(clip_id, lag, value) for the given lags: a join on equal frames, not on a range."""
    left = envelope.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).select("clip_id", "lag", (F.col("frame") + F.col("lag")).alias("frame"), F.col("flux").alias("a"))
    both = left.join(envelope.withColumnRenamed("flux", "b"), ["clip_id", "frame"])
    return both.groupBy("clip_id", "lag").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def tempo(samples: DataFrame, rate: int, hop: int = HOP) -> DataFrame:
    """(clip_id, bpm, confidence, music_detected).

    Clips shorter than a second or of fewer than ten frames have none.  The lag with
    the largest autocorrelation wins, of several the smallest.
    """
    envelope = onset_envelope(samples, hop)
    sizes = samples.groupBy("clip_id").agg(F.count("*").alias("n_samples"))
    per_second = rate / hop
    low, high = max(1, int(per_second * 60 / FASTEST)), int(per_second * 60 / SLOWEST)
    values = autocorrelation(envelope, [0, *range(low, high + 1)])
    best = values.groupBy("clip_id").agg(F.max(F.when(F.col("lag") == 0, F.col("value"))).alias("zero"), F.max(F.when(F.col("lag") > 0, F.struct("value", (-F.col("lag")).alias("minus")))).alias("top"))
    ready = F.expr(f"n_samples >= {rate} and n_samples div {hop} >= 10 and top.value > 0 and zero > 0")
    bpm = F.when(ready, F.lit(60.0 * per_second) / -F.col("top.minus")).otherwise(0.0)
    confidence = F.when(ready, F.least(F.lit(1.0), F.col("top.value") / F.col("zero"))).otherwise(0.0)
    out = sizes.join(best, "clip_id", "left").select("clip_id", bpm.alias("bpm"), confidence.alias("confidence"))
    return out.withColumn("music_detected", (F.col("bpm") > MUSIC_BPM) & (F.col("confidence") > MUSIC_CONFIDENCE))


def clip_report(v: np.ndarray, rate: int, preset: str = "STRICT") -> dict:
    """What moderate_audio() says about one clip, for clips that stay whole; an empty clip or no rate is safe."""
    report = {"is_safe": True, "risk_score": 0.0, "violation_type": "NONE", "flagged": False, "corrupted": False, "bpm": 0.0}
    if not len(v) or not rate:
        return report
    fine = np.isfinite(v)
    bad = int((~fine).sum())
    if bad > len(v) // 100 or bad == len(v):
        return report | {"is_safe": False, "violation_type": "CORRUPTED_AUDIO", "corrupted": True}
    frames = len(v) // HOP
    if len(v) < rate or frames < 10:
        return report
    energy = np.sqrt((v[: frames * HOP].reshape(frames, HOP) ** 2).sum(axis=1) / HOP)
    rise = np.diff(energy, prepend=0.0)
    flux = np.where(rise > 0, rise, 0.0)
    low, high = lag_range(rate, frames)
    zero = float(flux @ flux)
    values = [float(flux[:-k] @ flux[k:]) for k in range(low, high + 1)]
    if not values or max(values) <= 0 or zero <= 0:
        return report
    best = int(np.argmax(values))
    bpm, confidence = 60.0 * (rate / HOP) / (low + best), min(1.0, values[best] / zero)
    report["bpm"] = bpm
    rms = float(np.sqrt(np.mean(v[fine] ** 2)))
    if bpm > MUSIC_BPM and confidence > MUSIC_CONFIDENCE and (preset == "STRICT" or rms > HIGH_RMS):
        report |= {"is_safe": False, "risk_score": confidence, "violation_type": "MUSIC_DETECTED" if preset == "STRICT" else "HIGH_ENERGY_AUDIO", "flagged": True}
    return report


def moderate_audio(samples: DataFrame, rate: int, preset: str = "STRICT") -> DataFrame:
    """(clip_id, is_safe, risk_score, violation_type, flagged, corrupted, bpm); a corrupted clip is unsafe with risk 0 and without a tempo."""
    both = signal_quality(samples).join(tempo(samples, rate), "clip_id")
    bad = F.col("is_corrupted")
    music = ~bad & F.col("music_detected") & (F.lit(True) if preset == "STRICT" else F.col("rms") > HIGH_RMS)
    kind = "MUSIC_DETECTED" if preset == "STRICT" else "HIGH_ENERGY_AUDIO"
    return both.select(
        "clip_id",
        (~(bad | music)).alias("is_safe"),
        F.when(music, F.col("confidence")).otherwise(0.0).alias("risk_score"),
        F.when(bad, "CORRUPTED_AUDIO").when(music, kind).otherwise("NONE").alias("violation_type"),
        music.alias("flagged"),
        bad.alias("corrupted"),
        F.when(bad, 0.0).otherwise(F.col("bpm")).alias("bpm"),
    )
