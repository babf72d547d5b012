"""Reports over the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlake.functions import payload as P


def items_by_id(items: DataFrame, *item_ids: str) -> DataFrame:
    """The items of the ids, all columns, payload included."""
    return items.where(F.col("item_id").isin(*item_ids))


def items_in_zip(items: DataFrame, zip_code: str) -> DataFrame:
    return items.where(F.col("zip_code") == zip_code)


def search(items: DataFrame, term: str, limit: int | None = 20) -> DataFrame:
    """Items whose payload holds the term, by item_id so that the first hits are defined."""
    hits = items.where(P.contains_text(F.col("raw_json"), term)).orderBy("item_id")
    return hits if limit is None else hits.limit(limit)


def flat(items: DataFrame) -> DataFrame:
    """One parse of the payload, promoted fields as columns."""
    rows = items.withColumn("p", P.fields(F.col("raw_json")))
    return rows.select(
        *[c for c in items.columns if c != "raw_json"],
        F.col("p.lead").alias("lead"),
        F.col("p.bidAmount").alias("bid_amount"),
        F.col("p.shippingOffered").alias("shipping_offered"),
        F.col("p.auction_ref").alias("auction_ref"),
        F.col("p.auction_data.eventName").alias("event_name"),
        F.col("p.auction_data.eventCity").alias("event_city"),
        F.col("p.auction_data.eventState").alias("event_state"),
    )


def count_rows(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def date_range(items: DataFrame) -> DataFrame:
    return items.agg(F.min("scraped_at").alias("oldest"), F.max("scraped_at").alias("newest"))


def per_value(items: DataFrame, column: str) -> DataFrame:
    """Counts by raw value (null and empty text are groups of their own), largest first."""
    return items.groupBy(column).agg(F.count("*").alias("n_items")).orderBy(F.desc("n_items"), F.asc_nulls_first(column))


def statistics(items: DataFrame) -> DataFrame:
    """Totals, range and counts by category and zip code from one scan.

    Rows (section, value, n_items, oldest, newest); section is total, category or zip_code.
    """
    sets = items.groupingSets([[], ["category"], ["zip_code"]], "category", "zip_code").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n_items"), F.min("scraped_at").alias("oldest"), F.max("scraped_at").alias("newest")
    )
    section = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "category").otherwise("zip_code")
    value = F.when(section == "category", P.category_label(F.col("category"))).when(section == "zip_code", F.col("zip_code"))
    return sets.select(section.alias("section"), value.alias("value"), "n_items", "oldest", "newest")


def recent(items: DataFrame, limit: int = 100) -> DataFrame:
    """The newest items, all columns; ties by item_id. Taken while sorting, without a full sort."""
    return items.orderBy(F.desc("scraped_at"), "item_id").limit(limit)


def recent_display(items: DataFrame, limit: int = 10) -> DataFrame:
    """The newest items as shown in a list. The payload is parsed after the limit."""
    rows = flat(recent(items, limit))
    return rows.select(
        "item_id",
        P.title(F.col("lead"), 50).alias("title"),
        P.event(F.col("event_name")).alias("event"),
        P.location(F.col("event_city"), F.col("event_state")).alias("location"),
        P.category_label(F.col("category")).alias("category"),
        P.iso_seconds(F.col("scraped_at")).alias("scraped_at"),
    )
