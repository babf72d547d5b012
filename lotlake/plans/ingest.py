"""Ingest as one job: fetched pages to observations, item table and audit counters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlake.operators import dedup, entities, merge, runs


#: Categories of runs up to which their last pages are broadcast (some 30 bytes each).
CUTS = 100_000


class PageRows(NamedTuple):
    """states: a row a page (KEY, status, errors). lots: slim rows (KEY, pos, item_id)."""

    states: DataFrame
    lots: DataFrame


def page_rows(pages: DataFrame, scratch: str) -> PageRows:
    """What page order is decided by, from one parse of the pages: stored under `scratch` as a row a lot, and one without position a page."""
    rows = entities.lot_ids(entities.page_states(pages), pages_too=True).select(*entities.KEY, "status", "errors", "pos", "item_id")
    found = stored(rows, f"{scratch}/slim")
    return PageRows(found.where("pos IS NULL").select(*entities.KEY, "status", "errors"), found.where("pos IS NOT NULL").select(*entities.KEY, "pos", "item_id"))


class Crawl(NamedTuple):
    """observed: rows (run_id, category_idx, category, page, pos, item_id, raw_json) that the crawl takes.
    pages: the pages it got to, with counts."""

    observed: DataFrame
    pages: DataFrame


def crawl(pages: DataFrame, scratch: str, limit: int | None = None, short: int = dedup.SHORT_PAGE) -> Crawl:
    """First-seen lots up to the end of results and the limits, with their payloads.

    Decisions are made on slim rows, which are stored under `scratch` (a shared folder) so that the pages are
    parsed twice in all: for them, and, up to the last page that a lot is taken from, for payloads. A lot's first place is
    on a page that is taken if it is so among the lots up to there, so those behind are counted once.
    """
    found = page_rows(pages, scratch)
    firsts = dedup.first_seen(found.lots)
    got = dedup.reached(dedup.page_counts(found.states, found.lots, firsts), short, limit)
    if limit is not None:
        got = dedup.within_run_limit(got, limit)
    got = stored(got, f"{scratch}/got")
    last = stored(got.where("take > 0").groupBy(*dedup.CRAWL).agg(F.max("page").alias("last page")), f"{scratch}/last")
    known, top = last.agg(F.count("*"), F.max("last page")).first()
    if known <= CUTS:  # what no lot is taken from isn't parsed or compared again; html doesn't shuffle for it, and readers skip what is behind `top`
        cut = lambda rows: rows.where(F.col("page") <= F.lit(top)).join(F.broadcast(last), dedup.CRAWL).where(F.col("page") <= F.col("last page")).select(rows.columns)
        pages, firsts = cut(pages), dedup.first_seen(cut(found.lots))
    taken = dedup.emitted(firsts, got)
    rows = entities.lots(entities.page_states(pages)).join(taken.select("run_id", "category_idx", "page", "pos", "nth"), ["run_id", "category_idx", "page", "pos"])
    return Crawl(entities.payloads(rows), got)


def observations(observed: DataFrame, zip_code: str, radius_miles: int, scraped_at, search_term: Column | None = None) -> DataFrame:
    """Observations in arrival order: seq is (run, category, place in its results). search_term: what the crawl searched for, if for anything."""
    term = [] if search_term is None else [search_term.alias("search_term")]
    seq = F.struct("run_id", "category_idx", F.col("nth").cast("bigint").alias("nth"))
    return observed.select(
        "run_id",
        seq.alias("seq"),
        "item_id",
        "raw_json",
        scraped_at.alias("scraped_at"),
        F.lit(zip_code).alias("zip_code"),
        F.lit(radius_miles).alias("radius_miles"),
        "category",
        *term,
    )


def stored(rows: DataFrame, path: str) -> DataFrame:
    """`rows` written and read again, so that what uses them twice doesn't work them out twice. zstd takes no longer here than snappy and less disk."""
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Upserted(NamedTuple):
    """items: the table after a batch. found, added, updated: what the batch held and did. fresh: items that are new."""

    items: DataFrame
    found: int
    added: int
    updated: int
    fresh: int


def upsert(items: DataFrame, batch: DataFrame, scratch: str, mode: str = "text", top: int | None = None) -> Upserted:
    """The item table after a batch, and its counters, from one pass over stored rows and observations.

    What is merged is stored under `scratch`, with what became of each item's observations, so that counters are sums of
    what was written, whatever was run twice on the way. top: the largest id so far, if `items` is only the part of
    the table that the batch touches.
    """
    held = stored(merge.merged(items, batch, mode, path=f"{scratch}/hot"), f"{scratch}/merged")
    found, added, updated, fresh = held.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in merge.COUNTS], F.count_if(F.col("id").isNull())).first()
    return Upserted(merge.with_ids(held, f"{scratch}/ranges", top=top, fresh_rows=fresh).drop("inserted_seq", *merge.COUNTS), found, added, updated, fresh)


def counters(items: DataFrame, batch: DataFrame, mode: str = "text") -> DataFrame:
    """What a batch adds and changes, by run."""
    return runs.change_totals(merge.change_classes(items, batch, mode))
