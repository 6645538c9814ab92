"""Shared pieces of the training-data operators: the shared folder, Arrow text access, vectorised hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once by the vectorised kernels, in bytes; a single longer text is one chunk.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker, about; a single longer row is one batch.
BATCH_BYTES = 2 << 20


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one in local mode (as
    in tests); executors on other machines would not see that, so elsewhere it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def cut(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later stages do not depend on executors that ran it.

    keep: gets the folder's name, so that drop() can remove it when it is no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that cut() wrote, by Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- memory of executors
def small_batches(spark: SparkSession) -> None:
    """Let the session deal rows to Python in batches of BATCH_BYTES, unless it was given a size of its own. Spark's batches
    of up to 64 MB are held three times (in a worker, and on their way there in buffers that double as they fill), and the
    executor's allocator keeps that for good."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give memory that is free back to the system. Workers are kept for later tasks, and what the allocators hold would
    count against the executor all that time."""
    import ctypes

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if release is not None:
        release(0)


def tidy(run):
    """A function of Arrow batches that trims memory when it ends."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return outer


# ---------------------------------------------------------------- Arrow text
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and n + 1 offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about limit bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with about limit bytes of the text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for lo, hi in chunks(offsets, limit):
        yield batch.slice(lo, hi - lo)


# ---------------------------------------------------------------- hashing
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """b**i and b**-i modulo 2**64 for i < n, for an odd b."""
    if not _POWERS or len(_POWERS[0]) < n:
        base, size = 0xD1342543DE82EF95, max(n, CHUNK_BYTES + 4096)
        inverse = pow(base, -1, 1 << 64)
        factors = np.ones((2, size), np.uint64)
        factors[0, 1:], factors[1, 1:] = base, inverse
        _POWERS[:] = np.cumprod(factors, axis=1, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums s and inverse powers p, so that (s[j] - s[i]) * p[i] is a hash of data[i:j]."""
    up, down = powers(len(data) + 1)
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(byte_values()[data] * up[:-1], out=s[1:])
    return s, down


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, split at the six ASCII space characters: starts, ends, 64-bit hashes of the words in
    ASCII lower case, and n + 1 offsets of the texts' words. Words never reach across texts."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    s, down = prefix_hash(_LOWER[data])
    hashed = mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashed, np.searchsorted(starts, offsets)


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed bytes; unpack() reverses it."""
    import zlib

    return values.dtype.str.encode() + b"@" + zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    import zlib

    kind, _, body = blob.partition(b"@")
    return np.frombuffer(zlib.decompress(body), np.dtype(kind.decode()))


def pack_strings(items: list[bytes]) -> bytes:
    import zlib

    sizes = np.fromiter(map(len, items), np.uint32, len(items))
    return np.uint32(len(items)).tobytes() + zlib.compress(sizes.tobytes() + b"".join(items), 1)


def unpack_strings(blob: bytes) -> list[bytes]:
    import zlib

    n = int(np.frombuffer(blob[:4], np.uint32)[0])
    body = zlib.decompress(blob[4:])
    at = 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(body[: 4 * n], np.uint32).astype(np.int64))])
    cuts = at.tolist()
    return [body[i:j] for i, j in zip(cuts, cuts[1:])]
