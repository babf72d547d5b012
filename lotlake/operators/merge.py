"""Change-data merge: classify observations in arrival order and bring the item table up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlake.operators.numbering import RANGE, numbered
from lotlake.sources.scratch import scratch_dir

COLUMNS = ["item_id", "seq", "raw_json", "scraped_at", "zip_code", "radius_miles", "category"]
#: Observations from which an item is dealt to several tasks.
HOT_ROWS = 1_000_000
#: New items that one task numbers; more are numbered by ranges.
ONE_TASK = 100_000


def fingerprint(raw: Column, mode: str = "text") -> Column:
    """What is compared: the payload's text, or in mode `canonical` its value with object keys in order. No payload is one of its own."""
    if mode == "canonical":
        raw = F.coalesce(F.to_json(F.try_parse_json(raw)), raw)
    return F.coalesce(F.sha2(raw, 256), F.lit(""))


def _with_stored(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows and observations together, with `when`, which orders them, stored ones first."""
    no = lambda kind: F.lit(None).cast(kind)
    run = batch["run_id"] if "run_id" in batch.columns else no("bigint")
    terms = F.when(F.col("search_term").isNotNull(), F.array("search_term")) if "search_term" in batch.columns else no("array<string>")
    held = F.col("search_terms") if "search_terms" in stored.columns else no("array<string>")
    old = stored.select("item_id", no(batch.schema["seq"].dataType).alias("seq"), *COLUMNS[2:], no("bigint").alias("run_id"), held.alias("search_terms"), "id", "created_at", F.lit(True).alias("stored"))
    new = batch.select(*COLUMNS, run.alias("run_id"), terms.alias("search_terms"), no("bigint").alias("id"), no("timestamp").alias("created_at"), F.lit(False).alias("stored"))
    return old.unionByName(new).withColumn("when", F.struct((~F.col("stored")).alias("observed"), "seq"))


def hot_items(batch: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Rows (item_id) with over `hot_rows` observations; None if there is none. Counts combine before the shuffle."""
    if batch.limit(hot_rows + 1).count() <= hot_rows:
        return None
    found = batch.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("item_id")
    path = scratch_dir(batch.sparkSession, "hot")
    found.write.parquet(path)
    found = batch.sparkSession.read.schema(found.schema).parquet(path)
    return None if found.isEmpty() else found


def _before_in_ranges(rows: DataFrame, path: str) -> DataFrame:
    """`rows` with the fingerprint before each, no item being one task's: dealt by ranges of (item, when), stored under `path`.

    Inside a range a window has the row before. What comes before a range's first row of an item is the last
    fingerprint of the ranges before it: a table with a row per range and item in it.
    """
    spark = rows.sparkSession
    cut = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "item_id", "when").withColumn(RANGE, F.spark_partition_id())
    cut.write.parquet(path)
    held = spark.read.schema(cut.schema).parquet(path)
    ends = held.groupBy("item_id", RANGE).agg(F.max_by("mark", "when").alias("last"))
    ends = ends.select("item_id", RANGE, F.lag("last").over(Window.partitionBy("item_id").orderBy(RANGE)).alias("carried"))
    inside = held.withColumn("before", F.lag("mark").over(Window.partitionBy(RANGE, "item_id").orderBy("when")))
    return inside.join(ends, ["item_id", RANGE]).withColumn("before", F.coalesce("before", "carried")).drop(RANGE, "carried")


def classified(stored: DataFrame, batch: DataFrame, mode: str = "text", hot_rows: int = HOT_ROWS, path: str | None = None) -> DataFrame:
    """Stored rows and observations with `change`: stored, or new, updated or unchanged against the one before.

    One shuffle by item serves the window and what is grouped by item behind it; fingerprints, which don't compress, are made
    behind it. Items of over `hot_rows` observations are dealt by ranges instead, under `path`. seq may be of any type that
    has an order.
    """
    rows = _with_stored(stored, batch)
    hot = hot_items(batch, hot_rows)
    marked = lambda rows: rows.withColumn("mark", fingerprint(F.col("raw_json"), mode))
    by_item = lambda rows: marked(rows.repartition("item_id")).withColumn("before", F.lag("mark").over(Window.partitionBy("item_id").orderBy("when")))
    if hot is None:
        rows = by_item(rows)
    else:
        dealt = _before_in_ranges(marked(rows.join(hot, "item_id", "left_semi")), path or scratch_dir(batch.sparkSession, "ranges"))
        rows = by_item(rows.join(hot, "item_id", "left_anti")).unionByName(dealt)
    kind = F.when(F.col("stored"), "stored").when(F.col("before").isNull(), "new").when(F.col("before") != F.col("mark"), "updated").otherwise("unchanged")
    return rows.withColumn("change", kind)


def change_classes(stored: DataFrame, batch: DataFrame, mode: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (run_id, item_id, seq, change), one for every observation. run_id is null if observations have none."""
    return classified(stored, batch, mode, hot_rows).where("NOT stored").select("run_id", "item_id", "seq", "change")


def merged(stored: DataFrame, batch: DataFrame, mode: str = "text", hot_rows: int = HOT_ROWS, path: str | None = None) -> DataFrame:
    """The item table after a batch, without new ids (null): one row per item, with what the batch did to it (COUNTS).

    Payload, time, zip, radius and category come from the last observation that changed the item; id and
    creation stay those of the first insert. search_terms unites the terms of all observations with the stored
    ones, also of observations that change nothing.
    """
    rows = classified(stored, batch, mode, hot_rows, path)
    now = F.max_by(F.struct(*COLUMNS[2:]), F.when(F.col("change") != "unchanged", F.col("when")))
    first = F.min_by(F.struct("id", F.coalesce("created_at", "scraped_at").alias("created_at"), "seq", "search_terms"), "when")
    count = lambda kind: F.count_if(F.col("change") == kind)
    # sets of terms only where observations bring any: other aggregates run over the window's order without a sort
    terms = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("search_terms")))).alias("terms")] if "search_term" in batch.columns else []
    out = rows.groupBy("item_id").agg(now.alias("now"), first.alias("first"), F.count_if(~F.col("stored")).alias("n_found"), count("new").alias("n_new"), count("updated").alias("n_updated"), *terms)
    united = F.when(F.size("terms") > 0, F.col("terms")) if terms else F.col("first.search_terms")
    return out.select("first.id", "item_id", "now.*", "first.created_at", united.alias("search_terms"), F.col("first.seq").alias("inserted_seq"), *COUNTS)


COUNTS = ["n_found", "n_new", "n_updated"]


def with_ids(rows: DataFrame, path: str, order: str = "inserted_seq", top: int | None = None, fresh_rows: int | None = None) -> DataFrame:
    """`rows` with ids for those that have none, in the order of `order`; present ids stay.

    New ids follow `top`, or the largest of `rows` if that is None. Up to ONE_TASK new rows are numbered by one task,
    more by ranges, stored under `path`. fresh_rows: their number, if it is known. The driver reads one row.
    """
    if top is None or fresh_rows is None:
        found = rows.agg(F.max("id"), F.count_if(F.col("id").isNull())).first()
        top = (found[0] or 0) if top is None else top
        fresh_rows = found[1]
    fresh = rows.where(F.col("id").isNull())
    if fresh_rows <= ONE_TASK:
        fresh = fresh.withColumn("place", F.row_number().over(Window.orderBy(order, "item_id")))
    else:
        fresh = numbered(fresh, [order, "item_id"], path)
    return rows.where(F.col("id").isNotNull()).unionByName(fresh.withColumn("id", F.lit(top) + F.col("place")).select(rows.columns))
