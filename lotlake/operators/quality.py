"""Table constraints as checks: each returns the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlake.schemas import RADII


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def nulls(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows (column_name, n_null), one per required column, from one scan."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in required])).alias("x")).select("x.*")


def odd_radius(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("radius_miles").isin(*RADII))
