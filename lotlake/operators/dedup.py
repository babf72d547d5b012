"""Page-order semantics of a crawl as set operations: first-seen lots, end of results, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CRAWL = ["run_id", "category_idx"]
#: A state with fewer lots ends the results (fixed value: half a page).
SHORT_PAGE = 50


def first_seen(lots: DataFrame) -> DataFrame:
    """Rows (run_id, category_idx, item_id, page, pos): where each id comes first in a category, by page and position.

    Lots without an id are left out. An aggregate, so it combines before the shuffle; only slim columns move. Page and position
    (ints) are one number, page above position: Spark hashes for the least number, and sorts all rows for a struct.
    """
    ids = lots.where(F.col("item_id").isNotNull())
    at = F.min(F.shiftleft(F.col("page").cast("int").cast("bigint"), 32) + F.col("pos").cast("int")).alias("at")
    page, pos = F.shiftright("at", 32).cast(lots.schema["page"].dataType), F.col("at").bitwiseAND(F.lit(2**31 - 1)).cast(lots.schema["pos"].dataType)
    return ids.groupBy(*CRAWL, "item_id").agg(at).select(*CRAWL, "item_id", page.alias("page"), pos.alias("pos"))


def without_id(lots: DataFrame) -> DataFrame:
    """Rows (run_id, category_idx, n_lots): lots that yield no id. They are dropped without counting as errors."""
    return lots.groupBy(*CRAWL).agg(F.count_if(F.col("item_id").isNull()).alias("n_lots")).where("n_lots > 0")


def page_counts(states: DataFrame, lots: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row per page: status, errors, lots in its state, lots new in its category."""
    key = [*CRAWL, "page"]
    all_lots = lots.groupBy(*key).agg(F.count("*").alias("n_lots"))
    new_lots = firsts.groupBy(*key).agg(F.count("*").alias("n_new"))
    rows = states.select(*key, "status", "errors").join(all_lots, key, "left").join(new_lots, key, "left")
    return rows.withColumns({"n_lots": F.coalesce("n_lots", F.lit(0)), "n_new": F.coalesce("n_new", F.lit(0))})


def reached(pages: DataFrame, short: int = SHORT_PAGE, limit: int | None = None) -> DataFrame:
    """`pages` (of page_counts) up to where the crawl ends, with emits (its lots are taken), before (new lots of
    earlier pages) and take (lots taken from it).

    A crawl stops before the first page that failed, has no state or nothing new, and after the first with fewer
    than `short` lots; a missing page number stops it too. Under a limit it ends on the page that fills it.
    Windows run over one row per page.
    """
    crawl = Window.partitionBy(*CRAWL)
    order = crawl.orderBy("page")
    gap = F.col("page") != F.row_number().over(order)
    rows = pages.withColumn("bad", (F.col("status") != "ok") | (F.col("n_new") == 0)).withColumn("gap", gap)
    rows = rows.withColumn("stop", F.min(F.when(F.col("bad") | F.col("gap"), F.col("page"))).over(crawl))
    rows = rows.withColumn("last", F.min(F.when((F.col("n_lots") < short) & ~F.col("bad"), F.col("page"))).over(crawl))
    emits = (F.col("stop").isNull() | (F.col("page") < F.col("stop"))) & (F.col("last").isNull() | (F.col("page") <= F.col("last")))
    # the page that stops a crawl is fetched, one that is missing or behind it isn't
    seen = emits | ((F.col("page") == F.col("stop")) & ~F.col("gap") & (F.col("last").isNull() | (F.col("page") <= F.col("last"))))
    rows = rows.withColumn("emits", emits).where(seen).drop("bad", "gap", "stop", "last")
    before = F.coalesce(F.sum(F.when(F.col("emits"), F.col("n_new")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    if limit is None:
        return rows.withColumn("take", F.when(F.col("emits"), F.col("n_new")).otherwise(0))
    rows = rows.where(F.col("before") < limit)
    return rows.withColumn("take", F.when(F.col("emits"), F.least("n_new", F.lit(limit) - F.col("before"))).otherwise(0))


def within_run_limit(pages: DataFrame, limit: int) -> DataFrame:
    """`pages` (of reached) of the categories that a limited run gets to: those before which fewer than `limit` lots were taken."""
    each = pages.groupBy(*CRAWL).agg(F.sum("take").alias("taken"))
    earlier = Window.partitionBy("run_id").orderBy("category_idx").rowsBetween(Window.unboundedPreceding, -1)
    kept = each.withColumn("earlier", F.coalesce(F.sum("taken").over(earlier), F.lit(0))).where(F.col("earlier") < limit)
    return pages.join(kept.select(*CRAWL), CRAWL, "left_semi")


def emitted(firsts: DataFrame, pages: DataFrame) -> DataFrame:
    """The first-seen lots that the crawl takes: on taken pages, the first `take` by position. Ranks run inside one page."""
    key = [*CRAWL, "page"]
    rows = firsts.join(pages.where("take > 0").select(*key, "before", "take"), key)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    return ranked.where(F.col("rank") <= F.col("take")).withColumn("nth", F.col("before") + F.col("rank")).drop("before", "take", "rank")


def gathered(*parts: tuple[str | None, DataFrame]) -> DataFrame:
    """Categories' rows one after the other, tagged with the category; repeats stay."""
    out = None
    for category, rows in parts:
        tagged = rows.withColumn("category", F.lit(category).cast("string"))
        out = tagged if out is None else out.unionByName(tagged)
    return out
