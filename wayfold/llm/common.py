"""Shared helpers: the shared folder, written intermediates, file access and text hashing kernels."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one kernel call works on at a time (a longer single text is one call).
CHUNK_BYTES = 2 << 20
#: What a batch of whole texts on its way to Python holds at most (a longer single text is one batch). Each task keeps
#: several copies of a batch outside the heap: Arrow vectors in the JVM, the batch and its texts in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's later queries, where the session does not set its own bounds."""
    for key, value in BATCH.items():
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (tests) gets a folder of its own; on a cluster that is an error, as
    other machines could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark).rstrip('/')}/wayfold/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write df; the shuffle files of this one execution go when it ends, as the table takes their place."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) for a URI of the shared folder: local, HDFS or an object store."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: repeated attempts of a task write the same bytes and the last rename stands."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(temp) as out:
        out.write(data)
    fs.move(temp, path)


def text_column(batch: pa.RecordBatch, name: str) -> pa.LargeBinaryArray:
    """A string column as bytes with 64-bit offsets, nulls as empty."""
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.large_string()).cast(pa.large_binary())


def byte_view(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column; text k is bytes[offsets[k]:offsets[k + 1]]."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges (a, b) of at most `most` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if _POWERS["n"] < n + 1:
        size = max(n + 1, CHUNK_BYTES + 4096)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _POWERS.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hash of any byte range of a buffer in constant time."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bound): byte ranges of the words [^\\x20\\x09-\\x0D]+; words of text k are bound[k]:bound[k + 1]."""
    inside = ~_BLANK[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        firsts = offsets[:-1]
        before[firsts[firsts < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        lasts = offsets[1:] - 1
        after[lasts[lasts >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


_STEP = (np.random.default_rng(77).integers(0, 2**64, 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles, A-Z folded; the whole sequence where there are fewer words."""
    start, end, bound = words_of(data, offsets)
    word = Rolling(data, _BYTE_FOLDED).ranges(start, end)
    n = len(word)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += word[k : k + len(rolled)] * _STEP[k]
    rolled = mix(rolled + np.uint64(width))
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(word[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
