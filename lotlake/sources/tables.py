"""Item and run tables on Parquet: versioned snapshots in buckets behind a pointer, and an appended audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.schemas import ITEMS, RUNS
from lotlake.sources.scratch import remove

#: The folder that names the finished snapshots: a table of one row each, with the folder of every bucket, the largest id
#: so far, the table's bytes and the last batch of each stream that is in it.
POINTER = "current_versions"
_POINTER_ROW = "version bigint, folder string, parts array<string>, last_id bigint, bytes bigint, streams map<string,bigint>"

#: Snapshots that stay, so that readers of the one before aren't disturbed.
KEPT = 2

#: Column of a written snapshot: the bucket, by hash of item_id; and the bytes that a bucket is meant to have.
BUCKET, BUCKET_BYTES = "bucket_no", 32 << 20


def _bucket(item_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(item_id), F.lit(buckets)).cast("int")


def buckets_for(size: int) -> int:
    """Buckets of a table of so many bytes: the power of two that keeps them near BUCKET_BYTES."""
    return 1 << max(0, (size // BUCKET_BYTES).bit_length())


def touched_buckets(batch: DataFrame, buckets: int) -> list[int]:
    """The buckets that the items of `batch` fall into."""
    if buckets == 1:
        return [0]
    return sorted(r[0] for r in batch.select(_bucket("item_id", buckets)).distinct().collect())  # at most a row a bucket


def write_items(items: DataFrame, root: str, version: int, touched: list[int] | None = None, buckets: int | None = None, last_id: int | None = None, streams: dict[str, int] | None = None) -> str:
    """Write a snapshot to a folder of its own, then name it in the pointer. One writer at a time.

    items: all rows of the buckets in `touched`, or of the whole table if that is None; other buckets stay where they
    are. buckets: their number; another one than the table has needs the whole table. last_id: the largest id, read from
    what is written if it is None. streams: the last batch of each stream that the snapshot holds. What a writer that died has
    left behind is never read and never in the way; what no snapshot of the newest KEPT names goes, the older names too.
    """
    spark = items.sparkSession
    now = current(spark, root)
    parts = list(now["parts"]) if now else []
    buckets = buckets or len(parts) or 1
    if len(parts) != buckets:
        if parts and touched is not None:
            raise ValueError("a new number of buckets needs the whole table")
        parts = [None] * buckets
    folder = f"v{version:012d}-{uuid.uuid4().hex[:12]}"
    if buckets == 1:  # written as it comes: no bucket to deal rows to
        items.write.parquet(f"{root}/{folder}/{BUCKET}=0")
    else:  # rows of a bucket go to as many tasks as their size asks for
        items.withColumn(BUCKET, _bucket("item_id", buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    written = _folders(spark, f"{root}/{folder}")
    old = sum(_bytes(spark, f"{root}/{parts[k]}") for k in (range(buckets) if touched is None else touched) if parts[k])
    for k in range(buckets) if touched is None else touched:
        parts[k] = f"{folder}/{BUCKET}={k}" if f"{BUCKET}={k}" in written else None
    if last_id is None:
        top = spark.read.schema("id bigint").parquet(f"{root}/{folder}").agg(F.max("id")).first()[0] or 0
        last_id = max(top, now["last_id"] if now else 0)
    whole = 0 if touched is None or not now else now["bytes"] - old
    row = (version, folder, parts, last_id, whole + _bytes(spark, f"{root}/{folder}"), {**(now["streams"] if now else {}), **(streams or {})})
    spark.createDataFrame([row], _POINTER_ROW).coalesce(1).write.parquet(f"{root}/{POINTER}/{folder}")
    newest = _pointers(spark, root)[-KEPT:]
    live = {part for name in newest for part in _pointer(spark, root, name)["parts"] if part}
    for name in _folders(spark, root):
        if name.startswith("v") and name < folder[:13]:
            held = [f"{name}/{part}" for part in _folders(spark, f"{root}/{name}")]
            gone = [part for part in held if part not in live]
            for path in gone if len(gone) < len(held) else [name]:
                remove(spark, f"{root}/{path}")
    for name in _folders(spark, f"{root}/{POINTER}"):
        if name < newest[0]:
            remove(spark, f"{root}/{POINTER}/{name}")
    return f"{root}/{folder}"


def _listed(spark: SparkSession, path: str):
    """(file system, path) for Hadoop calls."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _folders(spark: SparkSession, path: str) -> list[str]:
    system, where = _listed(spark, path)
    return [f.getPath().getName() for f in system.listStatus(where) if f.isDirectory()]


def _bytes(spark: SparkSession, path: str) -> int:
    system, where = _listed(spark, path)
    return system.getContentSummary(where).getLength()


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Names of the finished pointer tables, the oldest first."""
    system, where = _listed(spark, f"{root}/{POINTER}")
    if not system.exists(where):
        return []
    return sorted(name for name in _folders(spark, f"{root}/{POINTER}") if system.exists(_listed(spark, f"{root}/{POINTER}/{name}/_SUCCESS")[1]))


def _pointer(spark: SparkSession, root: str, name: str):
    return spark.read.schema(_POINTER_ROW).parquet(f"{root}/{POINTER}/{name}").first()


def current(spark: SparkSession, root: str):
    """The row of the newest finished snapshot, None before the first."""
    names = _pointers(spark, root)
    return _pointer(spark, root, names[-1]) if names else None


def current_version(spark: SparkSession, root: str) -> int | None:
    found = current(spark, root)
    return found and found["version"]


def read_items(spark: SparkSession, root: str, touched: list[int] | None = None, found=None) -> DataFrame:
    """The newest finished snapshot (or that of a row of current()), or its buckets in `touched`."""
    found = found or current(spark, root)
    parts = found["parts"] if found else []
    paths = [f"{root}/{part}" for k, part in enumerate(parts) if part and (touched is None or k in touched)]
    if not paths:
        return spark.createDataFrame([], ITEMS)
    return spark.read.schema(ITEMS).parquet(*paths)


def append_runs(runs: DataFrame, path: str) -> None:
    """One row per finished run."""
    runs.select(*[c.split()[0] for c in RUNS.split(", ")]).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)
