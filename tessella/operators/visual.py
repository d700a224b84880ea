"""Image moderation: skin pixels, masks, connected components, exposure and the verdict.

Images are rows with their channels as arrays, or blobs of interleaved bytes; both
stay whole, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colour bounds and conversion weights.
LEAST_R, LEAST_G, LEAST_B, LEAST_SPREAD = 95, 40, 20, 15
CB = (128.0, -0.168736, -0.331264, 0.5)
CR = (128.0, 0.5, -0.418688, -0.081312)
CB_RANGE, CR_RANGE = (77, 127), (133, 173)
THRESHOLDS = {"STRICT": 0.25, "MODERATE": 0.45}
MIN_AREA = 20


def is_skin(r: Column, g: Column, b: Column) -> Column:
    """Cheap bounds first; the spread and order tests follow from r - g > 15 and r > b."""
    mix = lambda w: F.lit(w[0]) + F.lit(w[1]) * r + F.lit(w[2]) * g + F.lit(w[3]) * b
    cb, cr = mix(CB), mix(CR)
    return (r > LEAST_R) & (g > LEAST_G) & (b > LEAST_B) & (r - g > LEAST_SPREAD) & (r > b) & cb.between(*CB_RANGE) & cr.between(*CR_RANGE)


def skin_mask(images: DataFrame, name: str = "mask") -> DataFrame:
    """Adds the mask (array of 0 and 1) of images with arrays r, g, b."""
    at = lambda c, i: F.col(c)[i]
    return images.withColumn(name, F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: is_skin(at("r", i), at("g", i), at("b", i)).cast("int")))


def skin_ratio(masked: DataFrame, name: str = "skin_ratio") -> DataFrame:
    total = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return masked.withColumn(name, F.when(F.size("mask") > 0, total / F.size("mask")).otherwise(0.0))


def skin_pixels(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, n_pixels, n_skin) from exploded pixels (key, r, g, b): one shuffle with partial sums."""
    skin = is_skin(F.col("r"), F.col("g"), F.col("b"))
    return pixels.groupBy(key).agg(F.count("*").alias("n_pixels"), F.sum(skin.cast("long")).alias("n_skin"))


def blob_skin_ratio(images: DataFrame) -> DataFrame:
    """(image_id, skin_ratio, error) of blobs (data, width, height, channels).

    Empty data, no area and fewer than three channels give 0; data shorter than the
    area needs gives an InvalidInput error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ratios, errors = [], []
            for data, w, h, c in zip(rows["data"], rows["width"], rows["height"], rows["channels"], strict=True):
                ratio, error = 0.0, None
                if data and w > 0 and h > 0 and c >= 3:
                    if len(data) < w * h * c:
                        error = "InvalidInput"
                    else:
                        p = np.frombuffer(data, np.uint8, w * h * c).reshape(-1, c)[:, :3].astype(np.float64)
                        r, g, b = p.T
                        cb, cr = (k[0] + k[1] * r + k[2] * g + k[3] * b for k in (CB, CR))
                        skin = (r > LEAST_R) & (g > LEAST_G) & (b > LEAST_B) & (r - g > LEAST_SPREAD) & (r > b)
                        skin &= (cb >= CB_RANGE[0]) & (cb <= CB_RANGE[1]) & (cr >= CR_RANGE[0]) & (cr <= CR_RANGE[1])
                        ratio = float(skin.mean())
                ratios.append(ratio)
                errors.append(error)
            yield pd.DataFrame({"image_id": rows["image_id"], "skin_ratio": ratios, "error": errors})

    return images.select("image_id", "data", "width", "height", "channels").mapInPandas(run, "image_id long, skin_ratio double, error string")


def label_components(mask: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, pixels) of 8-connected components of ones, in order of their first pixel."""
    h, w = mask.shape
    label = np.where(mask == 1, np.arange(h * w).reshape(h, w), h * w)
    while True:
        wide = np.full((h + 2, w + 2), h * w)
        wide[1:-1, 1:-1] = label
        near = np.min([wide[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        after = np.where(mask == 1, near, h * w)
        flat = np.append(after.ravel(), h * w)
        after = flat[flat[after]]
        if (after == label).all():
            break
        label = after
    out = []
    for k in np.unique(label[label < h * w]):
        y, x = np.nonzero(label == k)
        if len(y) >= least:
            out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, len(y)))
    return out


def components(masks: DataFrame, least: int = MIN_AREA, key: str = "image_id") -> DataFrame:
    """(key, ordinal, x, y, width, height, pixel_count) of masks (key, width, height, mask); a mask of the wrong length has none."""
    kind = masks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, w, h, m in zip(rows[key], rows["width"], rows["height"], rows["mask"], strict=True):
                if m is not None and len(m) == w * h and w * h:
                    out += [(k, n, *c) for n, c in enumerate(label_components(np.asarray(m).reshape(h, w), least))]
            yield pd.DataFrame(out, columns=[key, "ordinal", "x", "y", "width", "height", "pixel_count"])

    return masks.select(key, "width", "height", "mask").mapInPandas(run, f"{key} {kind}, ordinal int, x int, y int, width int, height int, pixel_count long")


def exposure_ratio(found: DataFrame, areas: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, exposure_ratio): pixels of components over a hundredth of the area (whole division), over the area; areas: (key, area)."""
    large = found.join(areas, key).where("pixel_count > area div 100").groupBy(key).agg(F.sum("pixel_count").alias("n"))
    return areas.join(large, key, "left").select(key, F.when(F.col("area") > 0, F.coalesce("n", F.lit(0)) / F.col("area")).otherwise(0.0).alias("exposure_ratio"))


def moderate_image(rated: DataFrame, preset: str = "STRICT", key: str = "image_id") -> DataFrame:
    """(key, is_safe, risk_score, violation_type, skin_ratio) of rows (key, skin_ratio, has_violation); a violation in the extracted text prevails."""
    limit = THRESHOLDS[preset]
    skin, text = F.col("skin_ratio") >= limit, F.coalesce("has_violation", F.lit(False))
    return rated.select(
        key,
        (~(skin | text)).alias("is_safe"),
        F.when(text, 1.0).when(skin, F.least(F.lit(1.0), F.col("skin_ratio") / limit)).otherwise(0.0).alias("risk_score"),
        F.when(text, "OCR_PROFANITY").when(skin, "EXPLICIT_BODY").otherwise("NONE").alias("violation_type"),
        "skin_ratio",
    )
