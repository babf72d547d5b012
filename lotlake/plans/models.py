"""The modelling layer: staging tables and facts, built run by run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.operators.reports import flat


def staged_items(items: DataFrame) -> DataFrame:
    """One flat, typed row per item."""
    return flat(items)


def staged_auctions(staged: DataFrame) -> DataFrame:
    """One row per auction; the newest item that names it says what it is called and where it is."""
    rows = staged.where(F.col("auction_ref").isNotNull())
    newest = F.max_by(F.struct("event_name", "event_city", "event_state"), F.struct("scraped_at", "item_id"))
    return rows.groupBy("auction_ref").agg(newest.alias("x"), F.count("*").alias("n_items")).select("auction_ref", "x.*", "n_items")


def fact_items(staged: DataFrame, auctions: DataFrame) -> DataFrame:
    """Items with their auction; items without one stay."""
    slim = staged.drop("event_name", "event_city", "event_state")
    return slim.join(auctions.withColumnRenamed("n_items", "auction_items"), "auction_ref", "left")


#: The log of finished runs, inside the target's folder, where readers of the target don't look.
DONE = "_finished_runs"


def finished_runs(spark: SparkSession, path: str, name: str = "sys_run_name") -> DataFrame:
    """The runs that a target holds whole: a row a run, without a look at the target."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DONE}")
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], f"{name} string")
    return spark.read.schema(f"{name} string").parquet(f"{path}/{DONE}")


def new_runs(source: DataFrame, done: DataFrame, name: str = "sys_run_name") -> DataFrame:
    """Rows of runs that aren't done yet."""
    return source.join(done.select(name).distinct(), name, "left_anti")


def append_runs(source: DataFrame, target_path: str, name: str = "sys_run_name") -> None:
    """Write runs to their own partitions; a run that is there already is replaced, others aren't touched. Then log them as finished.

    What a writer that died has left of a run isn't in the log, so the next build takes the run again and replaces it.
    """
    source.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(target_path)
    source.select(F.col(name).cast("string")).distinct().write.mode("append").parquet(f"{target_path}/{DONE}")


def build_runs(source: DataFrame, target_path: str, model: Callable[[DataFrame], DataFrame] = lambda rows: rows, name: str = "sys_run_name") -> None:
    """Bring a target up to date: `model` of the rows of the runs that it doesn't hold whole."""
    fresh = new_runs(source, finished_runs(source.sparkSession, target_path, name), name)
    append_runs(model(fresh), target_path, name)


def tagged(rows: DataFrame, terms: list[str], text: Column) -> DataFrame:
    """A row for each search term that `text` holds, in one scan.

    `text` is worked out once a row: in a lambda it would be for each term, and below an inner explode, from whose array Spark makes
    a filter, once more.
    """
    low = F.lower(text)
    hits = F.array(*[F.when(F.contains(low, F.lower(F.lit(t))), F.lit(t)) for t in terms])
    return rows.withColumn("search_term", hits).withColumn("search_term", F.explode_outer("search_term")).where(F.col("search_term").isNotNull())
