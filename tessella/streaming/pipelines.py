"""The same operators on unbounded inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import codec
from ..sources import requests


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Requests (request_id, value) of Parquet files as they come, parsed and routed; admission is by files a trigger."""
    source = spark.readStream.schema("request_id long, value string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return requests.route(requests.parse(source))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what there is as Parquet, exactly once, and ends."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class ReferenceFrames(StatefulProcessor):
    """Keeps one reference frame for each video and codes frames as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ref = handle.getValueState("ref", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ref = self.ref.get()[0] if self.ref.exists() else None
        frames = pd.concat(list(rows)).sort_values("frame_no", kind="stable")
        out = []
        for r in frames.itertuples(index=False):
            error = codec.check_frame(r.data, r.width, r.height)
            stream = None if error else codec.encode_video_frame(r.data, ref, r.frame_type, r.width, r.height, r.quality, r.search_window)
            ref = ref if error else r.data
            out.append((int(r.video_id), int(r.frame_no), stream, error))
        if ref is not None:
            self.ref.update((ref,))
        yield pd.DataFrame(out, columns=["video_id", "frame_no", "stream", "error"])

    def close(self) -> None:
        pass


def encode_video_stream(frames: DataFrame) -> DataFrame:
    """(video_id, frame_no, stream, error) of a stream of frames; needs the RocksDB state store."""
    return frames.groupBy("video_id").transformWithStateInPandas(ReferenceFrames(), "video_id int, frame_no long, stream binary, error string", "append", "none")
