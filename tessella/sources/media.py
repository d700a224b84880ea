"""Media files below one root, as rows."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are left out.
MOST_BYTES = 134_217_728


def inside(root: str, name: str) -> bool:
    """Whether a path, taken from the root unless absolute, stays inside it."""
    if not name:
        return False
    root, path = posixpath.normpath(root), posixpath.normpath(posixpath.join(root, name))
    return path == root or path.startswith(root.rstrip("/") + "/")


def read_media(spark: SparkSession, root: str, pattern: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of files below the root of at most `most` bytes; longer ones are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") <= most)
