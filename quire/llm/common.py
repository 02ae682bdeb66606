"""What the operators of this subpackage share: reading tables, cutting lineage, and byte-level text kernels.

The kernels work on whole Arrow string columns as flat numpy byte arrays, a few megabytes at a time, so that
Python's cost is per batch and not per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel works on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 18


def trim() -> None:
    """Gives free memory back: idle workers keep theirs beside those at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where there is no glibc
        ctypes.CDLL(None).malloc_trim(0)


#: What modules remember in a worker from one task to the next; another module's task clears it.
REMEMBERED: dict[str, dict] = {}


def forget_others(module: str) -> None:
    for name, memory in REMEMBERED.items():
        if name != module:
            memory.clear()


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives its memory back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(f.__module__)
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def lean_group(f: Callable[[pa.Table], pa.Table]):
    """A function for applyInArrow that gives its memory back after each group."""

    def run(table: pa.Table) -> pa.Table:
        forget_others(f.__module__)
        try:
            return f(table)
        finally:
            trim()

    return run


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By application, the folder that stands in for spark.checkpoint.dir in a session of one process.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a session of one process gets a folder of its own; a cluster is refused, as its machines share none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    return _own_dirs[context.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns that clash with `names` put under other names, and a function that brings back docs' columns as they were."""
    lower = {n.lower() for n in names}
    hidden = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in lower}

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns))

    return docs.withColumnsRenamed(hidden), back


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(df: DataFrame, size: int) -> int:
    """How many buckets a table's data is dealt into: as many as the session has shuffle partitions, or more where a bucket would else hold more than `size` of the table's bytes, as the optimizer estimates them."""
    estimated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(-(-estimated // size), 1 << 20) if estimated < 1 << 60 else 1)


def crc_rest(column: str, modulus: int):
    """crc32 of the id as text, modulo: the split into held-out and training rows. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copies where there are no nulls; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n or at is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes; a row is never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `size` bytes of a text column: what is made of a piece is sent on before the next."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        for i, j in slices(offsets, size):
            yield batch.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: An odd multiplier for the rolling hash of bytes modulo 2**64, and its inverse.
BASE = 0xA24BAED4963EE407
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as every slice needs about as many."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if len(out) > 8 * SLICE_BYTES:
            return out[:n]
        have = _powers[base] = out
    return have[:n]


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


BYTE_VALUES = byte_values()


class Rolling:
    """Hashes of any substrings of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers(BASE, len(data)), out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of data[start:end], mixed with the length."""
        got = (self.sums[end] - self.sums[start]) * powers(BASE_INVERSE, len(self.sums))[start]
        return mix(got + (end - start).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))

    def grams(self, k: int) -> np.ndarray:
        """Of every k bytes in turn."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * powers(BASE_INVERSE, n)) if n > 0 else np.empty(0, np.uint64)


#: White space of the word definition [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: What the word definition [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ leaves out of lower-cased text.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


#: Which bytes of eight belong to a span that has n left, as a mask of the little-endian number.
LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of data[start:end] each, eight bytes at a time with a mix after each: no polynomial, whose differences some texts cancel."""
    left = ends - starts
    out = left.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    if not len(left):
        return out
    at8, at, rows = eights(data), starts, None
    while True:
        got = at8[at] & LEFT[np.minimum(left, 8)]
        if rows is None:
            out = mix(out ^ got * np.uint64(0xC2B2AE3D27D4EB4F))
        else:
            out[rows] = mix(out[rows] ^ got * np.uint64(0xC2B2AE3D27D4EB4F))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rows = more if rows is None else rows[more]
        left, at = left[more] - 8, at[more] + 8


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of the lower-cased slice, and how many words begin before each row: (hashes, starts, ends, first)."""
    low = LOWER[data]
    inside = ~breaks[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[edge] = inside[edge]
    stops = np.zeros(len(data) + 1, bool)
    stops[:-1] = ~inside
    stops[1:-1] &= inside[:-1]
    stops[0] = False
    if len(data):
        stops[-1] = inside[-1]
        edge = edge[edge > 0]
        stops[edge] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return spans_hash(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingle(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in turn (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xAF251AF3B0F025B5) + hashes[i : i + n]
    return mix(out)


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word, its row, from the words that begin before each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
