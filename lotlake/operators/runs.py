"""The run audit: counters, finished rows, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlake.functions.payload import seconds_between


def page_totals(pages: DataFrame) -> DataFrame:
    """Rows (run_id, errors, pages_scraped, lots_found) over the pages a run got to (reached, then within_run_limit)."""
    return pages.groupBy("run_id").agg(F.sum("errors").alias("errors"), F.count_if(F.col("status") == "ok").alias("pages_scraped"), F.sum("take").alias("lots_found"))


def change_totals(classes: DataFrame) -> DataFrame:
    """Rows (run_id, items_found, items_added, items_updated) from classified observations with their run_id.

    Every change counts, so an item that changes to and fro in one run is updated twice.
    """
    return classes.groupBy("run_id").agg(
        F.count("*").alias("items_found"), F.count_if(F.col("change") == "new").alias("items_added"), F.count_if(F.col("change") == "updated").alias("items_updated")
    )


def finished(started: DataFrame, changes: DataFrame, pages: DataFrame) -> DataFrame:
    """Audit rows: `started` (run_id, started_at, completed_at, zip_code, radius_miles, test_mode, status) with counters.

    Runs that failed or were interrupted record no added or updated items, though rows were stored; a failed
    one has one more error.
    """
    rows = started.join(changes, "run_id", "left").join(pages, "run_id", "left")
    full = F.col("status") == "completed"
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("int")
    return rows.select(
        F.col("run_id").alias("id"),
        "started_at",
        "completed_at",
        "zip_code",
        "radius_miles",
        "test_mode",
        count("items_found").alias("items_found"),
        F.when(full, count("items_added")).otherwise(0).alias("items_added"),
        F.when(full, count("items_updated")).otherwise(0).alias("items_updated"),
        (count("errors") + F.when(F.col("status") == "failed", 1).otherwise(0)).alias("errors"),
        "status",
    )


def summary(runs: DataFrame, categories: Column) -> DataFrame:
    """One line of facts per run; `categories` is the run's list, none for all."""
    label = F.when(F.coalesce(F.size(categories), F.lit(0)) > 0, F.array_join(categories, ", ")).otherwise("all")
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return runs.select(
        "id",
        "status",
        "zip_code",
        "radius_miles",
        F.when(F.col("test_mode"), "Yes").otherwise("No").alias("test_mode"),
        label.alias("categories"),
        seconds_between(F.col("started_at"), F.col("completed_at")).alias("seconds"),
        *[count(c) for c in ("items_found", "items_added", "items_updated", "errors")],
    )


def run_by_id(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def history(runs: DataFrame, limit: int | None = 20) -> DataFrame:
    """Newest runs first."""
    rows = runs.orderBy(F.desc("started_at"), F.desc("id"))
    return rows if limit is None else rows.limit(limit)
