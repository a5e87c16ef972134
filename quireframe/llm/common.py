"""What the operators of this subpackage share: table access, shared storage, text bytes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import store
from ..sources.store import drop, exists, fresh_path  # noqa: F401  for the operators

#: Words of documents: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20
#: Seconds after which a worker gives memory back.
TIDY_S = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read back; texts go through Python in small batches on the way."""
    lean(df.sparkSession)
    return store.written(df, what, codec)


def lean(spark: SparkSession) -> None:
    """Rows go to Python in batches of so many bytes, so that long texts do not pile up in a worker; less stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)\s*b?", spark.conf.get(key))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """run over batches; what a worker holds without need goes back to the system now and then, and when its task ends."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for batch in run(batches):
            yield batch
            if time.monotonic() - last > TIDY_S:
                batch = None
                give_back()
                last = time.monotonic()
        give_back()

    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """The name, longer where a column of df has it already, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_views(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column as one array, and where each row starts in it (n+1)."""
    arr = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    starts = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, starts.astype(np.int64)


def row_runs(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows, together about `most` bytes long; a longer row stands alone."""
    n, i = len(starts) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Recent:
    """A bounded memory in two generations: when the younger is full, it becomes the older, and what is used again moves back."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
