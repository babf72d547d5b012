"""Reading fetched pages, and the frontier of pages to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.functions.payload import category_list
from lotlake.schemas import PAGES

#: Lots per result page (fixed value of the site).
PAGE_SIZE = 100


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of fetched pages; html is null where fetching failed."""
    return spark.read.schema(PAGES).format(fmt).load(path)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """Raw page files, one row each, with the file they came from; an empty file is an empty page. Bytes that are no UTF-8 are replaced.

    Spark's readers give no row for an empty file, so those are the listed files that no row comes from. The list of names is the
    one that the driver makes for any read of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one_form = lambda url: F.regexp_replace(url, "^file:/+", "file:/")  # noqa: E731 - file:/x and file:///x
    read = files.select(one_form("_metadata.file_path").alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    listed = spark.createDataFrame([(name,) for name in files.inputFiles()], "url string").select(one_form("url").alias("url"))
    return read.unionByName(listed.join(read.select("url"), "url", "left_anti").withColumn("html", F.lit("")))


def requested_pages(requests: DataFrame, files: DataFrame, name: Column, file_name: Column, columns: list[str] | None = None) -> DataFrame:
    """`requests` (the frontier) with html: that of the file named for a page, null where there is none, which means that fetching failed.

    name, file_name: what a request and a file are matched by. Files that nobody asked for are left out; each name
    should come once. Pages that are there go through an inner join, which broadcasts the frontier if it is small, and
    the missing ones are found by names alone, so html never shuffles with a small frontier.
    """
    columns = columns or requests.columns
    asked = requests.select(*columns, name.alias("name of page"))
    there = asked.join(files.select(file_name.alias("name of page"), "html"), "name of page").select(*columns, "html")
    missing = asked.join(files.select(file_name.alias("name of page")), "name of page", "left_anti").select(*columns, F.lit(None).cast("string").alias("html"))
    return there.unionByName(missing)


def page_url(base: str, category: Column, zip_code: Column, miles: Column, page: Column, term: Column | None = None) -> Column:
    """The search URL of a page; values are not encoded, and without a category there is no path segment.

    term: what is searched for. It is free text, so it is encoded; without one the URL has no such parameter.
    """
    wanted = F.lit("") if term is None else F.when(F.coalesce(term, F.lit("")) == "", "").otherwise(F.concat(F.lit("&q="), F.url_encode(term)))
    segment = F.when(F.coalesce(category, F.lit("")) == "", "").otherwise(F.concat(category, F.lit("/")))
    return F.concat(
        F.lit(f"{base}/lots/"), segment, F.lit("?status=open&zip="), zip_code, F.lit("&miles="), miles.cast("string"), F.lit("&apage="), page.cast("string"), F.lit(f"&ipp={PAGE_SIZE}"), wanted
    )


def frontier(requests: DataFrame, base: str, pages: int) -> DataFrame:
    """Rows (run_id, category_idx, category, page, url) for requests (run_id, categories text, zip_code, radius_miles).

    Without a category a request makes one pass over all lots, with a null category. Requests may have a search_term, which
    goes into the URL and stays as a column.
    """
    term = ["search_term"] if "search_term" in requests.columns else []
    listed = requests.withColumn("list", category_list(F.coalesce("categories", F.lit(""))))
    each = listed.select("*", F.posexplode_outer(F.when(F.size("list") > 0, F.col("list"))).alias("i", "category"))
    rows = each.select("run_id", F.coalesce("i", F.lit(0)).alias("category_idx"), "category", "zip_code", "radius_miles", *term, F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    url = page_url(base, F.col("category"), F.col("zip_code"), F.col("radius_miles"), F.col("page"), F.col("search_term") if term else None)
    return rows.select("run_id", "category_idx", "category", "page", url.alias("url"), *term)
