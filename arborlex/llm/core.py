"""Shared pieces of the training-data operators: scratch tables, text buffers, word hashes.

Every per-document kernel works on the raw UTF-8 buffer of an Arrow batch with numpy, in slices of
bounded size, so the memory of a task follows the largest document and not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel looks at together.
SLICE_BYTES = 1 << 19

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15


#: Whether a write's shuffle files go as soon as it ends; Spark else keeps them until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session without executors of its own may name none: then it
    is a temporary folder of the one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="arborlex-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows that go to a Python worker together.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _setting(spark: SparkSession, **values: str | None) -> Iterator[None]:
    """Session settings for a while; those given as None stay."""
    names = {"cleanup": _CLEANUP, "batch_rows": BATCH_ROWS}
    wanted = {names[k]: v for k, v in values.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage so that a lost executor costs no replay, and frees
    the shuffle files that led to it. batch_rows: rows that go to a Python worker together, where rows are large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    with _setting(spark, cleanup="true", batch_rows=None if batch_rows is None else str(batch_rows)):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arborlex_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by materialise() once nothing reads it any more."""
    path = getattr(df, "_arborlex_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Bits of a filter over keys, for each key and at most; Spark's bitmaps have 32,768 each.
_FILTER_BITS, _MOST_BITS, _BITMAP_BITS = 16, 1 << 25, 1 << 15


def filtered(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among keys (one column, written): all that are, and few others. Bits at the hashes of the
    keys, 4 MB at most, go to every task, so that a join on the key which follows moves few rows that it then drops."""
    bits = _BITMAP_BITS
    while bits < min(_MOST_BITS, _FILTER_BITS * keys.count()):
        bits *= 2
    names = [f"_{c}_{uuid.uuid4().hex}" for c in ("map", "bits")]
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    at, bit = F.floor(place(key) / _BITMAP_BITS), F.pmod(place(key), F.lit(_BITMAP_BITS))
    own = place(keys.columns[0])
    maps = keys.where(F.col(keys.columns[0]).isNotNull()).groupBy(F.floor(own / _BITMAP_BITS).alias(names[0])).agg(F.bitmap_construct_agg(F.pmod(own, F.lit(_BITMAP_BITS))).alias(names[1]))
    byte = F.conv(F.hex(F.substring(F.col(names[1]), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return rows.where(F.col(key).isNotNull()).join(F.broadcast(maps), at == F.col(names[0])).where(hit).select(*rows.columns)


def release(spark: SparkSession) -> None:
    """Between stages: lets every executor collect its garbage, so that the heap which the stages before filled goes back
    to the system. Python workers live beside that heap and share its limit. A task for each core, so that none is left
    out while nothing else runs; where the JVM takes no such calls, nothing happens."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


#: What a worker process keeps between tasks, by operator, and how to forget it.
CACHES: dict[str, Callable[[], None]] = {}
_held: set[str] = set()


def tidy(keep: str = "") -> None:
    """At the start of a task or group: forgets what other operators keep in this worker and returns freed memory."""
    others = _held - {keep}
    for name in others:
        CACHES[name]()
        gc.collect()
    _held.difference_update(others)
    if keep:
        _held.add(keep)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 buffer, int64 offsets) of a string or binary column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTES = mix64(np.arange(1, 257, dtype=U64) * U64(_MULT))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_POWERS.get("p", ())) < n:
        p = 0xD1342543DE82EF95
        inverse = pow(p, -1, 1 << 64)
        for name, base in (("p", p), ("q", inverse)):
            x = np.full(max(n, SLICE_BYTES + 1), base, U64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=U64)
    return _POWERS["p"][:n], _POWERS["q"]


#: True for the six separators of [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: True for the bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once A-Z are lower case.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[48:58] = NON_ALNUM[97:123] = NON_ALNUM[65:91] = False
NON_ALNUM[128:] = False


#: Lower case of A-Z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are hashed one by one.
_SHORT = 64


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold_case: bool = False):
    """Words of several documents at once: (hash, start byte, end byte, first word of each document).

    Byte offsets count within buf; the last array has one more entry than there are documents. A hash takes a
    word's bytes eight at a time, each step scrambled, so that it has no algebra that regular texts could hit.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    last[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    length = end - start
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = LOWER[buf] if fold_case else buf
    eight = np.ndarray((n,), np.dtype("<u8"), padded, strides=(1,))
    h = mix64(length.astype(U64) * U64(_MULT))
    left = np.flatnonzero(length <= _SHORT)
    for k in range(0, _SHORT, 8):
        left = left[length[left] > k]
        if not len(left):
            break
        spare = U64(8) * (U64(8) - np.minimum(length[left] - k, 8).astype(U64))
        h[left] = mix64(h[left] * U64(_MULT) + (eight[start[left] + k] << spare))
    for i in np.flatnonzero(length > _SHORT):
        h[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    return h, start, end, np.searchsorted(start, offsets)
