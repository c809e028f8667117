"""Shared helpers: table access, words, indexes of strings, work folders."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
#: ``bytes.split()`` cuts at exactly these; in Java's and DuckDB's expressions the class is written out.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder for one job's tables in the shared folder the session names.

    Only a local master may go without ``spark.checkpoint.dir``.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="heliopath-")
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here."""
    at = f"{work_dir(df.sparkSession)}/table"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def tasks_for(df: DataFrame, rows: int, rows_each: int) -> int:
    """So many partitions that each gets about ``rows_each`` rows, two per core at least."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / rows_each))


LOADED = []  # what this worker process keeps from one task to the next


def per_worker(load):
    """One loaded value for each worker process, which serves its tasks until another operator lets it go."""
    kept = lru_cache(maxsize=1)(load)
    LOADED.append(kept)
    return kept


def let_go(*but):
    """Frees what earlier operators, ``but`` those named, keep in this worker process: Spark uses one for all jobs of a session.

    Freed memory goes back to the system where the C library can do that, so that idle workers leave it to the JVM.
    """
    import ctypes

    import pyarrow as pa

    for kept in LOADED:
        if kept not in but:
            kept.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Index(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n

    def numbers(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def texts_of(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def starts_of(lengths: Iterable[int]) -> np.ndarray:
    """0 and the running totals."""
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int64)


def sums_between(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values of each run; empty runs give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def parts_of(batch, most_bytes: int = 8_000_000, text: int = 1):
    """Slices of an Arrow batch with few enough bytes in its text column, the second if not told."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_count(column):
    """Column: number of words of a text, null counting as empty."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
