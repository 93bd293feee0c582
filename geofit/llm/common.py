"""Helpers shared by the operators: tables, staging in the shared folder, and text buffers in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a task turns into numpy arrays at a time (a longer text is taken alone).
TEXT_BLOCK = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one beside the warehouse's tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/staging").rstrip("/")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is written, not when the driver happens to collect
    its garbage: a job of many tables would hold the shuffles of all of them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The frame written as a table in the shared folder and read back: its lineage is cut, and a lost
    executor costs no more than a reread. Column names may clash with nothing, as the schema is the frame's."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with shuffles_released(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder: each is written once, read by all that need it, and dropped after its
    last reader has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        with shuffles_released(self.spark):
            df.write.option("compression", "zstd").parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def numbered(self, name: str, df: DataFrame, rid: str) -> DataFrame:
        """df with a row number in column `rid`, fixed by being written: read twice, a row has the same number, which
        monotonically_increasing_id alone does not promise for a frame that comes out of a shuffle."""
        return self.put(name, df.withColumn(rid, F.monotonically_increasing_id()))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow whose workers find this package, also when only the driver's path names it."""
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
    return df.mapInArrow(fn, schema)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string (UTF-8) or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset: column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = TEXT_BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of a byte block, from one pass of prefix sums.

    A span's hash is sum(v[byte] * B^k) over its bytes, k from 0, modulo 2^64, through a finaliser;
    equal bytes have equal hashes wherever they lie.
    """

    BASE = 0x9E3779B97F4A7C15 | 5
    VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    #: Powers that a worker keeps: those of a usual block. Those of a longer text are made for it and let go.
    KEPT = TEXT_BLOCK + 1
    _kept: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray):
        up, self.down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.VALUES[data] * up[: len(data)], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """B^k and B^-k for k below n (or more)."""
        if n <= cls.KEPT and cls._kept is not None:
            return cls._kept
        made = []
        for base in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
            p = np.full(max(n, cls.KEPT), base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n <= cls.KEPT:
            cls._kept = made[0], made[1]
        return made[0], made[1]

    def rolling(self, n: int) -> np.ndarray:
        """Hashes of all spans of n bytes, by start."""
        at = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:at]) * self.down[:at])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def run_bounds(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, also cut before the positions in `breaks`."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[breaks] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values, the position of one of each, and each element's place among them."""
    order = np.argsort(values)
    ranked = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(first) - 1
    return ranked[first], order[first], which
