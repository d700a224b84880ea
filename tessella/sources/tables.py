"""Media derived from the test tables, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PCM_RATE = 8000
IMAGE_SHIFT = (190, 120, 90)
SCALE = 256


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixel(v, shift: int, scale: int = SCALE):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(float(shift)) + F.lit(float(scale)) * v.cast("double")))).cast("int")


def gray_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, px): each vector of 64 values as an 8x8 gray block."""
    rows = load(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    return rows.select("vec_id", "label", F.transform("embedding", lambda v: _pixel(v, 128)).alias("px"))


def level_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_blocks(spark, sf_dir).select("vec_id", "label", F.transform("px", lambda v: (v - 128).cast("double")).alias("block"))


def rgb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, r, g, b): three vectors in a row as the channels of an 8x8 image; incomplete images are left out."""
    rows = load(spark, sf_dir, "embeddings").where("size(embedding) = 64").select(F.expr("vec_id div 3").alias("image_id"), F.expr("vec_id % 3").alias("c"), "embedding")
    channel = lambda k: F.max(F.when(F.col("c") == k, F.transform("embedding", lambda v: _pixel(v, IMAGE_SHIFT[k], 400))))
    images = rows.groupBy("image_id").agg(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b")).where("r is not null and g is not null and b is not null")
    return images.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), "r", "g", "b")


def pixels(images: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b)."""
    at = images.select("image_id", "width", F.posexplode(F.arrays_zip("r", "g", "b")).alias("k", "p"))
    return at.select("image_id", F.expr("k % width").alias("x"), F.expr("k div width").alias("y"), "p.r", "p.g", "p.b")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, i, v): the quantities of each return flag, in the order of all their columns, as a signal at PCM_RATE."""
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", *order)
    i = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(*order)) - 1
    return rows.select(F.col("l_returnflag").alias("clip_id"), i.cast("long").alias("i"), ((F.col("l_quantity") - 25.5) / 25.5).alias("v"))


def pcm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, i, s): events of each type in order, their values as 16-bit samples that wrap."""
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    s = F.pmod(F.floor(F.col("value") * 997), F.lit(65536)) - 32768
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("clip_id"), i.cast("long").alias("i"), s.cast("int").alias("s"))


def pcm_clips(spark: SparkSession, sf_dir: str, length: int = 256) -> DataFrame:
    """(clip_id, channels, data): the samples cut to clips of `length` as little-endian PCM16."""
    s = pcm_samples(spark, sf_dir).withColumn("part", F.expr(f"i div {length}"))
    u = F.pmod("s", F.lit(65536))
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    rows = s.select("clip_id", "part", "i", F.concat(byte(u % 256), byte(F.floor(u / 256))).alias("h"))
    joined = rows.groupBy("clip_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "").alias("h"))
    return joined.select(F.concat_ws(":", "clip_id", F.col("part").cast("string")).alias("clip_id"), F.lit(1).alias("channels"), F.unhex("h").alias("data"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_no, frame_type, width, height, quality, search_window, data): four vectors of a label in order make a 16x16 frame; every eighth is an I frame."""
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    blocks = gray_blocks(spark, sf_dir).select(F.col("label").alias("video_id"), n.alias("n"), "px").select("video_id", F.expr("cast(n div 4 as bigint)").alias("frame_no"), F.expr("n % 4").alias("tile"), "px")
    tiles = blocks.groupBy("video_id", "frame_no").agg(*(F.max(F.when(F.col("tile") == k, F.col("px"))).alias(f"t{k}") for k in range(4))).where("t3 is not null")
    rows = [F.slice(f"t{t + side}", y * 8 + 1, 8) for t in (0, 2) for y in range(8) for side in (0, 1)]
    text = F.array_join(F.transform(F.concat(*rows), lambda v: F.lpad(F.hex(v), 2, "0")), "")
    kind = F.when(F.col("frame_no") % 8 == 0, 0).otherwise(1)
    return tiles.select("video_id", "frame_no", kind.alias("frame_type"), F.lit(16).alias("width"), F.lit(16).alias("height"), F.lit(50).alias("quality"), F.lit(8).alias("search_window"), F.unhex(text).alias("data"))


def gray_frames(spark: SparkSession, sf_dir: str, quality: int = 50) -> DataFrame:
    """(frame_id, width, height, quality, data): each gray block as a frame of its own."""
    data = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return gray_blocks(spark, sf_dir).select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(quality).alias("quality"), data.alias("data"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, value): a JSON request for each event, of all actions, some of them faulty."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id") % 10
    number = lambda m: (F.col("event_id") % m).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit('{"action": "analyze_text", "text": "scum '), F.col("event_type"), F.lit('"}')))
        .when(k == 1, F.lit('{"action": "analyze_text"}'))
        .when(k == 2, F.concat(F.lit('{"action": "analyze_image", "file_path": "a.raw", "width": '), number(7), F.lit(', "height": 8}')))
        .when(k == 3, F.concat(F.lit('{"action": "analyze_audio", "file_path": "a.pcm", "sample_rate": '), number(3), F.lit("}")))
        .when(k == 4, F.concat(F.lit('{"action": "compress_image", "file_path": "a.raw", "width": 16, "height": '), number(24), F.lit("}")))
        .when(k == 5, F.concat(F.lit('{"action": "compress_audio", "file_path": "a.pcm", "sample_rate": 8000, "channels": '), number(4), F.lit("}")))
        .when(k == 6, F.lit('{"action": "analyze_image", "width": 8}'))
        .when(k == 7, F.lit('{"text": "no action"}'))
        .when(k == 8, F.lit('{"action": "resize", "file_path": "a.raw"}'))
        .otherwise(F.concat(F.lit('{"action": "compress_image", "file_path": "b.raw", "width": 8, "height": 8, "quality_factor": '), number(120), F.lit("}")))
    )
    return e.select(F.col("event_id").alias("request_id"), text.alias("value"))
