"""What the operators share: vectorised text kernels, written intermediates and connected components.

The kernels work on the UTF-8 buffer of an Arrow string column, whole column slices at a time, so their cost
is a few nanoseconds a byte and their memory is bounded by ``CHUNK_BYTES`` (or by the longest single text).
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
U64 = np.uint64


# --- written intermediates -------------------------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only on a single machine, as in tests, one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster set spark.checkpoint.dir to a folder that all its machines share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends in files that survive lost executors."""
    path = path or new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives freed memory back at the end of a task; workers live on, and executors count what they hold."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- texts in Arrow batches ------------------------------------------------------------------------------
def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows whose texts take ``limit`` bytes at most, or of one row."""
    data, offsets = text_buffer(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table_ = np.zeros(256, bool)
    for low, high in ranges:
        table_[low : high + 1] = True
    return table_


#: Bytes of words: all but white space; or letters, digits and whatever is not ASCII.
NOT_SPACE = ~byte_set((32, 32), (9, 13))
ALNUM = byte_set((48, 57), (65, 90), (97, 122), (128, 255))


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    first = offsets[:-1]
    first = first[(first < n) & (first > 0)]
    opens[first] |= inside[first + 1]
    closes[first - 1] |= inside[first]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size + 1, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased, from one prefix array of a polynomial over the bytes."""
    if not len(starts):
        return np.empty(0, U64)
    size = 1 << max(19, int(len(data)).bit_length())
    up, down = _powers(size)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_LOWER[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def hash_of(words: list[str]) -> np.ndarray:
    """Hashes of given words, as word_hashes() makes them."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    starts = ends - np.array([len(w) for w in raw], np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends)


_LANE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165]


def gram_hashes(words: np.ndarray, k: int, step: int = 1) -> np.ndarray:
    """Hashes of all runs of ``k`` words that lie ``step`` apart, in order; the caller drops those across texts."""
    n = len(words) - (k - 1) * step
    if n <= 0:
        return np.empty(0, U64)
    total = np.full(n, U64(k * 31 + step))
    for i in range(k):
        total = mix(total + words[i * step : i * step + n] * U64(_LANE[i % 8]))
    return total


# --- connected components ----------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id of ``edges`` (a, b long) the smallest id that it reaches.

    Each round every id takes the smallest label of its neighbours, gives it to the id that its own label names too,
    and takes the label of that label; so whole trees move at once, and a path takes about as many rounds as the
    logarithm of its length. Labels only fall, and rounds go on until none does. They live in written tables between
    rounds; only whether a row changed comes to the driver.
    """
    spark = edges.sparkSession
    edges_at, at = new_path(spark, "edges"), new_path(spark, "labels")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges", edges_at)
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", at)
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("seen"))
        near = labels.join(seen, labels["id"] == seen["a"]).select("id", "component", F.least("component", "seen").alias("near"))
        hooks = F.array(F.struct("id", "component", "near"), F.struct(F.col("component").alias("id"), F.lit(None).cast("long").alias("component"), "near"))
        own = F.array(F.struct("id", "component", "near"))
        given = near.select(F.explode(F.when(F.col("near") < F.col("component"), hooks).otherwise(own)).alias("x")).select("x.*")
        hooked = given.groupBy("id").agg(F.max("component").alias("component"), F.min("near").alias("near"))
        to = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        old, at = at, new_path(spark, "labels")
        after = written(hooked.join(to, "near").select("id", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("changed")), "labels", at)
        removed(spark, old)
        labels = after.select("id", "component")
        if after.filter("changed").isEmpty():
            removed(spark, edges_at)
            return labels
