"""Scratch tables in the cluster's shared folder and other small Spark helpers."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only in a local session without a shared folder, where one machine does all, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/tessella"
#: Rows up to which a table of single ids, or of pairs, is broadcast: some 25 MB as a hash table.
BROADCAST_IDS, BROADCAST_PAIRS = 1_000_000, 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, read from the session; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_SHARED


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet below the shared folder; it goes when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tessella-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path).getParent()
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path).getParent()
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


class Table:
    """A DataFrame written once to the shared folder, so that its lineage is cut and survives lost executors; its rows are counted meanwhile."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.rows: int = seen.get["rows"] if "rows" in seen.get else self.df.count()

    def hinted(self) -> DataFrame:
        """The rows, broadcast if they are few enough for their one or two columns of ids; else joins shuffle."""
        limit = BROADCAST_IDS if len(self.df.columns) == 1 else BROADCAST_PAIRS
        return F.broadcast(self.df) if self.rows <= limit else self.df

    def drop(self) -> None:
        drop_path(self.spark, self.path)

    def settle(self) -> Table:
        """Frees the shuffle files of finished steps, which Spark keeps until the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
        return self


def columns_or_null(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types; extra columns are left out, whatever their names."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that long texts travel in, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def long_array(values) -> str:
    """SQL for a constant array of longs, folded once by the optimizer."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)" if len(values) else "cast(array() as array<bigint>)"


def range_of(key: str, bounds) -> str:
    """SQL for the number of ascending bounds that are <= key: a binary search inside the JVM."""
    if not len(bounds):
        return "0"
    steps = len(bounds).bit_length()
    table = long_array(bounds)
    mid = "cast((s.lo + s.hi) div 2 as int)"
    step = f"if(s.lo >= s.hi, s, if(b.t[{mid}] <= {key}, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})))"
    step = step.replace("b.t", table)
    return f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, i) -> {step}, s -> s.lo)"


def splitters(keys: list[int], weights: list[int], parts: int) -> list[int]:
    """Ascending distinct keys that cut a weighted sample into about `parts` equal ranges, each bound the first key of its range."""
    import numpy as np

    if parts <= 1 or not len(keys):
        return []
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    k, w = np.array(keys, dtype=np.int64)[order], np.cumsum(np.array(weights, dtype=np.float64)[order])
    at = np.searchsorted(w, w[-1] * np.arange(1, parts) / parts, side="right")
    return sorted({int(x) for x in k[np.minimum(at, len(k) - 1)]} - {int(k[0])})
