"""Helpers that several operators share: scratch tables, skew-safe joins, words."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.sources.scratch import shared_dir

#: Bytes of an Arrow batch between Spark and its Python workers, which bounds what both hold of it.
BATCH_BYTES = 8 << 20
#: Bytes that separate words: space and the five controls from tab to carriage return.
WORD_GAPS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same set as a Java and RE2 regular expression.
GAP_PATTERN = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage, so a lost executor costs a reread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        self.paths.append(path := f"{self.root}/{len(self.paths)}-{name}")
        return path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for path in [p for p in self.paths if p.rsplit("-", 1)[-1] in names]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            self.paths.remove(path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner find shuffles whose frames are gone: they are seen by the second collection at the earliest."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def hex_sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow text column and the row offsets into them; null rows are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    return data[first:last], offsets - first


_GAP = np.zeros(256, dtype=bool)
_GAP[list(WORD_GAPS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (one more entry than rows).

    gaps: by byte, whether it stands between words. Rows end words as gaps do.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~gaps[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over its 8-byte blocks, length included."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    lengths = stops - starts
    out = mixed(lengths.astype(np.uint64) + np.uint64(seed) * _ODD)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
    live, at = np.arange(len(starts)), starts
    while len(live):
        left = np.minimum(stops[live] - at, 8)
        word = np.ascontiguousarray(blocks[at]).view(np.uint64)[:, 0] & masks[left]
        out[live] = mixed((out[live] * _ODD) ^ word)
        more = stops[live] - at > 8
        live, at = live[more], at[more] + 8
    return out


def word_ids(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only; good for these words alone. `data` holds nothing but them and gaps."""
    ends = np.concatenate([[0], np.cumsum(stops - starts)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[~_GAP[data]])])
    return flat.dictionary_encode().indices.to_numpy().astype(np.uint64)


def run_hashes(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `length` words inside a row, and the number of runs before each row.

    first: words before each row, as word_spans returns it.
    """
    counts = np.maximum(np.diff(first) - length + 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(before[-1]) - before[rows] + first[rows]
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(length):
        out = mixed((out * _ODD) ^ words[at + k])
    return out, before


def sized(batches, column: str, limit: int = 4 << 20):
    """Cut Arrow batches so that the text of each piece is near `limit` bytes (one row at least)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = np.diff(utf8_buffers(batch.column(at))[1])
        piece = np.cumsum(lengths) // limit
        edges = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(piece)]]) if len(piece) else [0, 0]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield batch.slice(int(a), int(b - a))
