"""Media compression on Arrow batches: block transform, DPCM audio, motion-compensated video.

A row is a block, a clip or a frame; rows are coded on their own, or in the order of
a video's frames, so work spreads over rows and nothing but the rows of one video
ever meets in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import entropy

MOST_CHANNELS = 2
I_FRAME, P_FRAME = 0, 1


def map_blocks(df: DataFrame, column: str, function, out: str, kind: str) -> DataFrame:
    """Adds a column: the function of all 64-value arrays of a batch at once; other lengths and nulls give null."""
    schema = df.schema
    text = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"`{out}` array<{kind}>"])
    item = {"double": pa.float64(), "int": pa.int32()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column).to_pylist()
            good = [k for k, v in enumerate(values) if v is not None and len(v) == 64 and None not in v]
            result: list = [None] * len(values)
            if good:
                done = function(np.array([values[k] for k in good], dtype=np.float64))
                for k, r in zip(good, done, strict=True):
                    result[k] = r.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.list_(item))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, text)


def dct(df: DataFrame, column: str = "block", out: str = "coefficients") -> DataFrame:
    return map_blocks(df, column, B.forward, out, "double")


def quantize(df: DataFrame, quality: int, column: str = "coefficients", out: str = "quantized") -> DataFrame:
    table = B.quant_table(quality)
    return map_blocks(df, column, lambda x: B.quantize(x, table), out, "int")


def dequantize(df: DataFrame, quality: int, column: str = "quantized", out: str = "coefficients") -> DataFrame:
    table = B.quant_table(quality)
    return map_blocks(df, column, lambda x: x * table, out, "double")


def inverse_dct(df: DataFrame, column: str = "coefficients", out: str = "block") -> DataFrame:
    return map_blocks(df, column, B.inverse, out, "double")


def zigzag(column: str) -> F.Column:
    """A block's values in zig-zag order, inside the JVM."""
    return F.transform(F.array(*map(F.lit, B.ZIGZAG)), lambda i: F.get(F.col(column), i))


def unzigzag(column: str) -> F.Column:
    back = sorted(range(64), key=B.ZIGZAG.__getitem__)
    return F.transform(F.array(*map(F.lit, back)), lambda i: F.get(F.col(column), i))


def fold16(value: F.Column) -> F.Column:
    """Signed to unsigned 16-bit, small absolute values first."""
    v = value.cast("int")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 15)).bitwiseAND(F.lit(65535))


def unfold16(value: F.Column) -> F.Column:
    return F.shiftright(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1)))


def wrap16(value: F.Column) -> F.Column:
    return F.pmod(value + 32768, F.lit(65536)) - 32768


def dc_delta(df: DataFrame, group: str, order: str, column: str = "zz") -> DataFrame:
    """Adds the wrapped difference of each block's first value to that of the block before."""
    first = F.get(F.col(column), F.lit(0))
    return df.withColumn("dc_delta", wrap16(first - F.lag(first, 1, 0).over(Window.partitionBy(group).orderBy(order))))


def run_lengths(column: str = "zz") -> F.Column:
    """Array of (run, value) for the non-zero values after the first: gaps between their places."""
    places = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: F.get(F.col(column), i) != 0)
    before = lambda k: F.when(k == 0, 0).otherwise(F.get(places, k - 1))
    return F.transform(places, lambda p, k: F.struct((p - before(k) - 1).alias("run"), F.get(F.col(column), p).alias("value")))


# Frames.


def check_frame(data: bytes | None, width: int, height: int) -> str | None:
    if data is None or len(data) < width * height or width <= 0 or height <= 0 or width % 8 or height % 8:
        return "InvalidInput"
    return None


def frame_symbols(frame: np.ndarray, quality: int) -> list[int]:
    q = B.quantize(B.forward(B.split(frame.astype(np.float64)) - 128), B.quant_table(quality))[:, B.ZIGZAG]
    out, before = [], 0
    for z in q:
        out += B.block_symbols(z, before)
        before = int(z[0])
    return out


def encode_frame(data: bytes, width: int, height: int, quality: int = 50, capacity: int | None = None) -> bytes:
    return entropy.encode(frame_symbols(np.frombuffer(data, np.uint8, width * height).reshape(height, width), quality), capacity=capacity)


def image_symbols(frames: DataFrame, *keys: str) -> DataFrame:
    """(keys, symbols) of frames (keys, width, height, quality, data): the bytes that the coder is given, null for an unfit frame."""
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            symbols = [None if check_frame(d, w, h) else bytes(frame_symbols(np.frombuffer(d, np.uint8, w * h).reshape(h, w), q)) for d, w, h, q in zip(rows["data"], rows["width"], rows["height"], rows["quality"], strict=True)]
            yield rows[list(keys)].assign(symbols=symbols)

    return frames.select(*keys, "width", "height", "quality", "data").mapInPandas(run, f"{kinds}, symbols binary")


def _read_blocks(next_symbol, n: int, quality: int, vectors: list | None = None) -> np.ndarray:
    """Inverse-transformed blocks; with a list, motion vectors are read before each block and put there."""
    q, before, dx, dy = [], 0, 0, 0
    for _ in range(n):
        if vectors is not None:
            dx, dy = (wrap8(a + unfold8(next_symbol())) for a in (dx, dy))
            vectors.append((dx, dy))
        z = B.read_block(next_symbol, before)
        before = int(z[0])
        block = np.zeros(64)
        block[B.ZIGZAG] = z
        q.append(block)
    return B.inverse(np.array(q) * B.quant_table(quality))


def decode_frame(stream: bytes, width: int, height: int, quality: int = 50) -> bytes:
    blocks = _read_blocks(entropy.Decoder(stream), width * height // 64, quality)
    return B.join(B.to_pixels(blocks + 128), width).tobytes()


def encode_images(frames: DataFrame, decode: bool = False, capacity: int | None = None) -> DataFrame:
    """(frame_id, original_size, stream, error) of frames (frame_id, width, height, quality, data); decode adds `decoded`.

    A frame whose stream takes more than `capacity` bytes has none, and the error Overflow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                error = check_frame(r.data, r.width, r.height)
                try:
                    stream = None if error else encode_frame(r.data, r.width, r.height, r.quality, capacity)
                except OverflowError as e:
                    stream, error = None, str(e)
                out.append((r.frame_id, 0 if error else r.width * r.height, stream, error, decode_frame(stream, r.width, r.height, r.quality) if decode and stream is not None else None))
            frame = pd.DataFrame(out, columns=["frame_id", "original_size", "stream", "error", "decoded"])
            yield frame if decode else frame.drop(columns="decoded")

    return frames.select("frame_id", "width", "height", "quality", "data").mapInPandas(run, "frame_id long, original_size long, stream binary, error string" + ", decoded binary" * decode)


# Audio.


def pcm_symbols(samples: np.ndarray, channels: int) -> bytes:
    s = samples.astype(np.int64)
    before = np.concatenate([np.zeros(channels, np.int64), s])[: len(s)]
    u = B.fold16(B.wrap16(s - before))
    return np.stack([u >> 8, u & 255], axis=1).astype(np.uint8).tobytes()


def audio_symbols(clips: DataFrame) -> DataFrame:
    """(clip_id, symbols) of clips (clip_id, channels, data): the bytes that the coder is given, without an incomplete last sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            symbols = [pcm_symbols(np.frombuffer(d, "<i2", len(d) // (2 * c) * c), c) for d, c in zip(rows["data"], rows["channels"], strict=True)]
            yield rows[["clip_id"]].assign(symbols=symbols)

    return clips.select("clip_id", "channels", "data").mapInPandas(run, "clip_id string, symbols binary")


def encode_pcm(data: bytes, channels: int = 1) -> bytes:
    n = len(data) // (2 * channels) * channels
    return entropy.encode(pcm_symbols(np.frombuffer(data, "<i2", n), channels))


def decode_pcm(stream: bytes, n_samples: int, channels: int = 1) -> bytes:
    """The samples of all channels, n_samples each."""
    u = np.frombuffer(entropy.decode(stream, n_samples * channels * 2), np.uint8).reshape(-1, 2).astype(np.int64)
    u = u[:, 0] << 8 | u[:, 1]
    residual = B.wrap16((u >> 1) ^ -(u & 1)).reshape(-1, channels)
    return B.wrap16(residual.cumsum(axis=0)).astype("<i2").tobytes()


def encode_audio(clips: DataFrame, decode: bool = False) -> DataFrame:
    """(clip_id, stream, error) of clips (clip_id, channels, data); decode adds `decoded`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                good = r.data is not None and 1 <= r.channels <= MOST_CHANNELS and len(r.data) >= 2 * r.channels and len(r.data) % (2 * r.channels) == 0
                stream = encode_pcm(r.data, r.channels) if good else None
                out.append((r.clip_id, stream, None if good else "InvalidInput", decode_pcm(stream, len(r.data) // (2 * r.channels), r.channels) if decode and good else None))
            frame = pd.DataFrame(out, columns=["clip_id", "stream", "error", "decoded"])
            yield frame if decode else frame.drop(columns="decoded")

    return clips.select("clip_id", "channels", "data").mapInPandas(run, "clip_id string, stream binary, error string" + ", decoded binary" * decode)


def dpcm(samples: DataFrame, channels: int = 1) -> DataFrame:
    """(clip_id, i, residual, folded) of samples (clip_id, i, s), inside the JVM."""
    before = F.lag("s", 1, 0).over(Window.partitionBy("clip_id", F.pmod("i", F.lit(channels))).orderBy("i"))
    residual = wrap16(F.col("s") - before)
    return samples.select("clip_id", "i", residual.alias("residual")).withColumn("folded", fold16(F.col("residual")))


# Video.


def wrap8(x: int) -> int:
    return (x + 128) % 256 - 128


def fold8(x: int) -> int:
    return ((x << 1) ^ (x >> 7)) & 255


def unfold8(x: int) -> int:
    return wrap8((x >> 1) ^ -(x & 1))


def encode_video_frame(data: bytes, ref: bytes | None, kind: int, width: int, height: int, quality: int, window: int) -> bytes:
    """A type byte and the coded frame; a P frame without a reference is typed P and coded as an I frame."""
    if kind == I_FRAME or ref is None:
        return bytes([kind]) + encode_frame(data, width, height, quality)
    now, old = (np.frombuffer(x, np.uint8, width * height).reshape(height, width) for x in (data, ref))
    vectors = [(dx, dy) for dx, dy, _ in B.best_vectors(now, old, window)]
    q = B.quantize(B.forward(B.split(now.astype(np.float64)) - B.compensate(old, vectors)), B.quant_table(quality))[:, B.ZIGZAG]
    out, before, last = [], 0, (0, 0)
    for v, z in zip(vectors, q, strict=True):
        out += [fold8(wrap8(a - b)) for a, b in zip(v, last, strict=True)] + B.block_symbols(z, before)
        before, last = int(z[0]), v
    return bytes([kind]) + entropy.encode(out)


def decode_video_frame(stream: bytes, ref: bytes | None, width: int, height: int, quality: int) -> bytes:
    if stream[0] == I_FRAME or ref is None:
        return decode_frame(stream[1:], width, height, quality)
    vectors: list[tuple[int, int]] = []
    residual = _read_blocks(entropy.Decoder(stream[1:]), width * height // 64, quality, vectors)
    old = np.frombuffer(ref, np.uint8, width * height).reshape(height, width)
    return B.join(B.to_pixels(B.compensate(old, vectors) + residual), width).tobytes()


def encode_video(frames: DataFrame, closed_loop: bool = False) -> DataFrame:
    """Adds stream and error to frames (video_id, frame_no, frame_type, width, height, quality, search_window, data).

    The reference of a frame is the original frame before it, which is the frame before
    in its video, so frames are coded side by side.  closed_loop refers to the decoded
    frame instead and codes each video in order.
    """
    if closed_loop:
        return _in_order(frames, "stream binary, error string", _encode_closed)
    before = Window.partitionBy("video_id").orderBy("frame_no")
    fine = (F.octet_length("data") >= F.col("width") * F.col("height")) & (F.col("width") % 8 == 0) & (F.col("height") % 8 == 0) & (F.col("width") > 0) & (F.col("height") > 0)
    ref = F.last(F.when(fine, F.col("data")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))

    @F.pandas_udf("struct<stream binary, error string>")
    def code(data: pd.Series, ref: pd.Series, kind: pd.Series, w: pd.Series, h: pd.Series, q: pd.Series, window: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(data, ref, kind, w, h, q, window, strict=True):
            error = check_frame(row[0], row[3], row[4])
            old = row[1] if row[1] is not None and len(row[1]) >= row[3] * row[4] else None
            out.append((None if error else encode_video_frame(row[0], old, *row[2:]), error))
        return pd.DataFrame(out, columns=["stream", "error"])

    coded = frames.withColumn("ref", ref).withColumn("coded", code("data", "ref", "frame_type", "width", "height", "quality", "search_window"))
    return coded.select(*frames.columns, "coded.stream", "coded.error")


def _encode_closed(rows: pd.DataFrame) -> pd.DataFrame:
    ref, streams, errors = None, [], []
    for r in rows.itertuples(index=False):
        error = check_frame(r.data, r.width, r.height)
        stream = None if error else encode_video_frame(r.data, ref, r.frame_type, r.width, r.height, r.quality, r.search_window)
        ref = ref if error else decode_video_frame(stream, ref, r.width, r.height, r.quality)
        streams.append(stream)
        errors.append(error)
    return rows.assign(stream=streams, error=errors)


def _decode_order(rows: pd.DataFrame) -> pd.DataFrame:
    ref, out = None, []
    for r in rows.itertuples(index=False):
        frame = None if r.stream is None else decode_video_frame(r.stream, ref, r.width, r.height, r.quality)
        ref = ref if frame is None else frame
        out.append(frame)
    return rows.assign(decoded=out)


def _in_order(frames: DataFrame, added: str, function) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema), added])
    return frames.groupBy("video_id").applyInPandas(lambda rows: function(rows.sort_values("frame_no", kind="stable")), schema)


def decode_video(coded: DataFrame) -> DataFrame:
    """Adds decoded; a frame's reference is the decoded frame before it."""
    return _in_order(coded, "decoded binary", _decode_order)


def motion(frames: DataFrame, window: int = 8) -> DataFrame:
    """(video_id, frame_no, block, dx, dy, sad, residual) of the blocks of all frames but a video's first."""
    ref = F.lag("data").over(Window.partitionBy("video_id").orderBy("frame_no"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                now, old = (np.frombuffer(x, np.uint8, r.width * r.height).reshape(r.height, r.width) for x in (r.data, r.ref))
                best = B.best_vectors(now, old, window)
                rest = B.split(now.astype(np.int64)) - B.compensate(old.astype(np.int64), [v[:2] for v in best])
                out += [(r.video_id, r.frame_no, k, *v, d.tolist()) for k, (v, d) in enumerate(zip(best, rest, strict=True))]
            yield pd.DataFrame(out, columns=["video_id", "frame_no", "block", "dx", "dy", "sad", "residual"])

    pairs = frames.withColumn("ref", ref).where("ref is not null")
    return pairs.select("video_id", "frame_no", "width", "height", "data", "ref").mapInPandas(run, "video_id int, frame_no long, block int, dx int, dy int, sad long, residual array<int>")


def compression_report(coded: DataFrame, key: str, original_size: str = "original_size", compressed: str = "stream") -> DataFrame:
    """(key, is_completed, original_size, compressed_size, compression_ratio, throughput_mbps, latency_ms); the last two are never measured and stay 0."""
    before, after = F.col(original_size), F.octet_length(compressed).cast("long")
    ratio = F.when(before > 0, after / before).otherwise(0.0)
    return coded.select(key, F.col(compressed).isNotNull().alias("is_completed"), before.alias("original_size"), after.alias("compressed_size"), ratio.alias("compression_ratio"), F.lit(0.0).alias("throughput_mbps"), F.lit(0.0).alias("latency_ms"))
