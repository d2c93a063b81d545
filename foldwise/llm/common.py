"""Helpers shared by the training-data operators: white space, written tables, and hashed words in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.sources.tables import shared_path

#: Characters that separate words, for Spark's trim and for its regular expressions.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = "[ \\t\\n\\x0B\\f\\r]+"

_WRITTEN: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate to the folder that all executors share and read it again; that cuts its lineage."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the intermediates written so far; call it once the results that read them are written."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unwrite(spark: SparkSession, path: str) -> None:
    """Delete one intermediate that nothing will read any more."""
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def last_written() -> str:
    return _WRITTEN[-1]


#: Bits of a filter of hashes.
FILTER_BITS = 1 << 24


def hash_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A filter with a bit for the hashes (long) of a column: FILTER_BITS bits, packed, whatever the number of rows. It lets through all of
    them, and others the more the fuller it is."""
    bits = hashes.select(F.expr(f"pmod({column}, {FILTER_BITS}L)").alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for w in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        out[w["w"]] = w["bits"]
    return out


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.int64) % FILTER_BITS
    return (packed[at >> 6] >> (at & 63) & 1).astype(bool)


def remember(path: str) -> str:
    """Add a folder of files to what forget() deletes."""
    _WRITTEN.append(path)
    return path


#: Rows of an Arrow batch in steps whose rows are whole texts or sets.
BATCH_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run in it sends Python batches of at most so many rows; the JVM and the Python worker both hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# ---- texts of an Arrow batch as one run of bytes ----------------------------------

#: Bytes of texts that are worked on at once; a Python worker holds many times that.
BLOCK_BYTES = 1 << 19


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds) of consecutive rows with about `most` bytes at once; a longer text is a block of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def is_space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


SPACE, LOWER = is_space(), lower_ascii()
BASE = 0x9E3779B97F4A7C15 | 1


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n. Only tables for blocks of the usual size are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    with np.errstate(over="ignore"):
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[:1] = 1
            made.append(np.multiply.accumulate(x, out=x))
    if n <= 1 << 22:
        _POWERS[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of the input."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, independent of where it stands."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0], x = 0, total[1:]
        x[:] = data
        x += np.uint64(1)
        x *= up[:-1]
        np.cumsum(x, out=x)
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: runs of bytes other than white space, never across rows."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1:], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, A-Z taken as a-z."""
    start, end, row = word_spans(data, bounds)
    return span_hashes(LOWER[data], start, end), row


# ---- files in the shared folder ------------------------------------------------------

def file_system(uri: str):
    """The file system of a URI or absolute path, and the path in it. Any scheme that pyarrow knows."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def one_file_each(manifest: DataFrame, n: int) -> DataFrame:
    """Deal out a table of n files so that each is read by a task of its own."""
    return manifest.repartition(max(1, n))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_columns(df: DataFrame, keep: list[str], more: str) -> str:
    """Schema of the columns `keep` of df and some more."""
    return ", ".join([*(f"{quoted(c)} {df.schema[c].dataType.simpleString()}" for c in keep), more])
