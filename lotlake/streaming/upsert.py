"""Structured Streaming forms: dedup of arriving lots, and the merge by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotlake.plans.ingest import stored, upsert
from lotlake.sources import tables
from lotlake.sources.scratch import remove


def first_arrivals(lots: DataFrame, late: str = "1 hour", time: str = "fetched_at") -> DataFrame:
    """The first arrival of each item per run and category; state is dropped `late` after an item's time."""
    return lots.withWatermark(time, late).dropDuplicatesWithinWatermark(["run_id", "category_idx", "item_id"])


#: The table in a checkpoint folder that names its stream.
_NAME = "stream-name"


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that a checkpoint folder belongs to, made when it is first asked for and kept in the folder."""
    path = f"{checkpoint}/{_NAME}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        spark.createDataFrame([(uuid.uuid4().hex,)], "name string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


def first_in_order(lots: DataFrame, late: str = "1 hour", started: str = "started_at") -> DataFrame:
    """Where each item comes first in a run's category by page and position, whatever order pages arrive in.

    Rows (run_id, category_idx, item_id, started, page, pos), for append mode: a run's come once the watermark, `late`
    behind the newest start of a run, has passed its start, and its state goes then. started: when the run of a row began,
    the same for all its rows; rows that arrive later than that are dropped. Lots without an id are left out.
    """
    ids = lots.where(F.col("item_id").isNotNull()).withWatermark(started, late)
    first = ids.groupBy("run_id", "category_idx", "item_id", started).agg(F.min(F.struct("page", "pos")).alias("at"))
    return first.select("run_id", "category_idx", "item_id", started, "at.page", "at.pos")


def merge_batch(root: str, counters: str, mode: str = "text", buckets: int | None = None, stream: str = "main") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: merge into the next snapshot under `root` and append the counters.

    A snapshot names the last batch of every stream that it holds, in the same write that makes it current. So a batch
    that is run again after a failure writes nothing if its own snapshot was finished and starts from the same one if not, and a
    table may have come from elsewhere or from other streams. The batch is stored, as it is read more than once. Only the
    buckets that its items fall into are read and written. buckets: their number, or None for one that follows the
    table's bytes: when it no longer fits, the batch rewrites the table.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = tables.current(spark, root)
        if found and found["streams"].get(stream, -1) >= batch_id:
            return
        work = f"{root}/work-{stream}"
        remove(spark, work)  # of a batch that was cut off
        batch = stored(batch, f"{work}/batch")
        n = buckets or tables.buckets_for(found["bytes"] if found else 0)
        known = len(found["parts"]) if found else 0
        n = known if known and (buckets or n < 4 * known) else n  # rewrites are rare: a table grows fourfold between two
        touched = tables.touched_buckets(batch, n) if n == known else None
        done = upsert(tables.read_items(spark, root, touched, found), batch, work, mode, found["last_id"] if found else 0)
        totals = spark.createDataFrame([(done.found, done.added, done.updated)], "items_found bigint, items_added bigint, items_updated bigint")
        totals.coalesce(1).write.mode("overwrite").parquet(f"{counters}/stream={stream}/batch_id={batch_id}")
        top = (found["last_id"] if found else 0) + done.fresh
        tables.write_items(done.items, root, (found["version"] if found else 0) + 1, touched, n, top, {stream: batch_id})
        remove(spark, work)

    return run


def start_upsert(stream: DataFrame, root: str, counters: str, checkpoint: str, mode: str = "text", buckets: int | None = None) -> StreamingQuery:
    """Merge what there is and stop; run it again for what has arrived since. The table may exist, whatever its version."""
    name = stream_name(stream.sparkSession, checkpoint)
    return stream.writeStream.foreachBatch(merge_batch(root, counters, mode, buckets, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
