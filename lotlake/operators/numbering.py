"""Numbers in a total order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = "range of places"
#: A number that goes up by one from row to row of a range.
_PLACE = "place in range"


def numbered(rows: DataFrame, order: list[str], path: str, by: list[str] | None = None) -> DataFrame:
    """`rows` with `place`: 1, 2, 3 ... in `order`, within equal `by` if it is given. Rows that tie in all of it come in any order.

    Rows are dealt to ranges of about as many rows, whatever the values, and stored under `path`, sorted and counted as they
    are written, so that they shuffle once. A range's numbers start behind the ranges before it; the table of starts has a row
    per range and value of `by` in it.
    """
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumns({RANGE: F.spark_partition_id(), _PLACE: F.monotonically_increasing_id()})
    cut.write.option("compression", "zstd").parquet(path)
    held = rows.sparkSession.read.schema(cut.schema).parquet(path)
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(*by, RANGE).agg(F.min(_PLACE).alias("first"), F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    starts = sizes.select(*[F.col(c).alias(f"{c} of start") for c in [*by, RANGE]], ahead.alias("rows before"))
    same = [held[c].eqNullSafe(starts[f"{c} of start"]) for c in [*by, RANGE]]
    return held.join(F.broadcast(starts), same).select(*rows.columns, (F.col(_PLACE) + F.col("rows before")).alias("place"))
