"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: ASCII white space that separates words in every contract.
WS_CLASS = r"\x20\x09-\x0D"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, also when others differ from them in case only or repeat a name."""
    if all(sum(c.lower() == n.lower() for c in df.columns) == 1 for n in names):
        return df.select(*names)
    slots = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*slots).select(*(F.col(slots[df.columns.index(n)]).alias(n) for n in names))


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only on a local master where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors share no folder")
        root = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="vouchline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/vouchline/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what ``shared_path`` gave out, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vouchline_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes a materialised table that no later plan reads."""
    remove(df.sparkSession, df._vouchline_path)


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, small: int) -> DataFrame:
    """Inner join on a key that may hold any share of the left rows; ``right`` has a row a key and, in ``n``, its left rows.

    Up to ``small`` keys are broadcast. Of more, those with over a thousandth of the rows are fewer than a thousand
    and are broadcast; the rest meet by key.
    """
    keys, total = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0))).first()
    if keys <= small:
        return left.join(F.broadcast(right.drop(n)), key)
    often = max(100, total // 1000)
    hot = F.broadcast(right.where(F.col(n) > often).drop(n))
    rest = left.join(F.broadcast(right.where(F.col(n) > often).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.where(F.col(n) <= often).drop(n), key))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only


def give_back() -> None:
    """Freed memory of this worker, which stays after a task, goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copies, and n + 1 offsets; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pa.compute.fill_null(arr, "").cast(pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]] if len(arr) else buf[:0], off - off[0] if len(arr) else np.zeros(1, np.int64)


def doc_chunks(offsets: np.ndarray, size: int):
    """Runs (first, end) of documents of about ``size`` bytes; one larger document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


_MIX = np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on uint64 values."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + _MIX
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def span_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of ordered, disjoint spans as a binary column."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start] = 1
    edge[end] -= 1
    data = np.ascontiguousarray(buf[np.cumsum(edge[:-1], dtype=np.int8) > 0])
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data)])


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each span, and the distinct contents in the order of their numbers; compared byte by byte."""
    coded = span_bytes(buf, start, end).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def word_ids(words: list[bytes]) -> np.ndarray:
    """64-bit XXH3 of each word: its name wherever words of different tasks meet."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of words over documents laid end to end, and the number of each document's words."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~_IS_WS[buf]
    start = inside[1:-1] & ~inside[:-2]
    firsts = offsets[:-1][offsets[:-1] < len(buf)]
    start[firsts] = inside[1:-1][firsts]  # a document's first byte starts a word even if no space is before it
    s = np.flatnonzero(start)
    end = inside[1:-1] & ~inside[2:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    end[lasts] = inside[1:-1][lasts]
    e = np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(s, offsets))
    return s, e, counts
