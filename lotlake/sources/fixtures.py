"""The star-schema test tables in the shape of items, observations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotlake.schemas import RADII

#: Orders whose lots share a page, and the columns that order lots.
ORDERS_PER_PAGE = 200
_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _radius(n, extra: bool = False):
    choices = [*RADII, 75] if extra else list(RADII)
    return F.get(F.array(*[F.lit(r) for r in choices]), (n % len(choices)).cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change stream: the user is the item, its properties the payload, one run per day."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        F.date_diff(day, F.lit("2020-01-01").cast("date")).cast("bigint").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("item_id"),
        F.col("props").alias("raw_json"),
        F.col("ts").cast("timestamp").alias("scraped_at"),
        F.lpad((F.col("user_id") % 10).cast("string"), 5, "0").alias("zip_code"),
        _radius(F.col("user_id")).alias("radius_miles"),
        F.col("event_type").alias("category"),
    )


def write_files(pages: DataFrame, path: str) -> None:
    """A file <name>.html for each row (name, html), as a fetcher leaves them; null or empty html is a file without a byte. 256 folders.

    Tasks write the files themselves: a Spark writer takes a job for each empty file, and for any file a folder, a checksum and two renames.
    A task that runs twice writes the same bytes again.
    """

    def write(batches):
        import zlib

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        files, root = FileSystem.from_uri(path)
        for batch in batches:
            for name, html in zip(batch["name"].to_pylist(), batch["html"].to_pylist(), strict=True):
                folder = f"{root}/{zlib.crc32(name.encode()) % 256:03d}"
                files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{name}.html") as out:
                    out.write((html or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = pages.select("name", F.col("html").cast("string").alias("html"))
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part, and with their order's customer, which are joined per order: that join leaves lines dealt by order.

    Nations and regions come last, as they take no shuffle and their names would go through one.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item table from line items: one row per (order, line), the earliest shipped."""
    rows = _lots(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_ORDER))
    payload = F.to_json(
        F.struct(
            F.col("p_name").alias("lead"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bidAmount"),
            (F.col("l_returnflag") == "N").alias("shippingOffered"),
            F.concat(F.lit("Auction:"), F.col("o_orderkey").cast("string")).alias("auction_ref"),
            F.struct(F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("eventName"), F.col("n_name").alias("eventCity"), F.col("r_name").alias("eventState")).alias("auction_data"),
        )
    )
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return (
        rows.withColumn("first", first)
        .where("first = 1")
        .select(
            number.alias("id"),
            number.cast("string").alias("item_id"),
            payload.alias("raw_json"),
            F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
            F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zip_code"),
            _radius(F.col("c_nationkey"), extra=True).alias("radius_miles"),
            F.when(F.col("p_type") != "STANDARD", F.col("p_type")).alias("category"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )
    )


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("page", (1 + F.floor(F.col("l_orderkey") / ORDERS_PER_PAGE)).cast("int"))
    # page before type: rows are sorted by the first bytes of the first column
    place = Window.partitionBy("page", "p_type").orderBy("l_orderkey", "l_linenumber", *_ORDER, "l_discount", "l_tax")
    return rows.withColumn("pos", F.row_number().over(place) - 1)


def pages(spark: SparkSession, sf_dir: str, ids: str = "plain", faults: bool = False) -> DataFrame:
    """Result pages with an embedded state, by part type as category, ORDERS_PER_PAGE orders to a page.

    Every seventh order's auction is missing, every eleventh stands under another key and is only found by its
    type and id. ids='mixed' spreads the ways a lot can carry its id. faults=True puts one fault into the
    pages of each category: seen ids again, no fetch, an empty body, no script, cut JSON, no entities.
    """
    rows = _numbered(spark, sf_dir)
    first = F.col("p_type") == "ECONOMY"
    if faults:
        rows = rows.where(~(first & (F.col("page") == 5)))
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    order = F.col("l_orderkey").cast("string")
    q = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    own_id = F.concat(F.lit('"id":'), number.cast("string"))
    if ids == "mixed":
        kind = F.col("l_partkey") % 6
        own_id = (
            F.when(kind == 1, F.concat(F.lit('"id":null,"itemId":"i'), number.cast("string"), F.lit('"')))
            .when(kind == 2, F.concat(F.lit('"eventItemId":'), number.cast("string")))
            .when(kind == 3, F.lit('"id":0'))
            .when(kind == 4, F.lit('"id":false'))
            .when(kind == 5, F.lit('"other":1'))
            .otherwise(own_id)
        )
    lot = F.concat(
        F.lit('"Lot:'), number.cast("string"), F.lit("-"), F.col("pos").cast("string"), F.lit('":{"__typename":"Lot",'), own_id,
        F.lit(',"lead":'), q(F.col("p_name")), F.lit(',"bidAmount":'), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        F.lit(',"auction":{"__ref":"Auction:'), order, F.lit('"},"lotState":{"__ref":"LotState:'), F.col("l_returnflag"), F.col("l_linestatus"), F.lit('"}}'),
    )
    auction = F.when(
        F.col("l_orderkey") % 7 != 0,
        F.concat(
            q(F.when(F.col("l_orderkey") % 11 == 0, F.concat(F.lit("Event-"), order)).otherwise(F.concat(F.lit("Auction:"), order))),
            F.lit(':{"__typename":"Auction","id":'), order, F.lit(',"eventName":"Sale '), order, F.lit('"}'),
        ),
    )
    lot_state = F.concat(F.lit('"LotState:'), F.col("l_returnflag"), F.col("l_linestatus"), F.lit('":{"flag":"'), F.col("l_returnflag"), F.lit('"}'))
    made = rows.groupBy("page", "p_type").agg(
        F.sort_array(F.collect_list(F.struct("pos", lot.alias("x"))))["x"].alias("lots"), F.sort_array(F.collect_set(auction)).alias("auctions"), F.sort_array(F.collect_set(lot_state)).alias("states")
    )
    if faults:  # page 5 of the first category repeats page 4: as a page, so that lots are read once and stay in their order
        made = made.withColumn("page", F.explode(F.when(first & (F.col("page") == 4), F.array(F.lit(4), F.lit(5))).otherwise(F.array("page"))))
    doc = F.concat(F.lit('{"apollo.state":{'), F.array_join(F.concat("lots", "auctions", "states"), ","), F.lit("}}"))
    page = lambda text: F.concat(F.lit('<html><body><script>var a=1;</script><script id="page-state" type="application/json">'), text, F.lit("</script></body></html>"))
    html = page(doc)
    if faults:
        at = lambda kind, n: (F.col("p_type") == kind) & (F.col("page") == n)
        html = (
            F.when(at("LARGE", 6), F.lit(None).cast("string"))
            .when(at("MEDIUM", 5), "")
            .when(at("PROMO", 4), "<html><script>var a=1;</script></html>")
            .when(at("SMALL", 3), page(F.left(doc, F.length(doc) - 1)))
            .when(at("STANDARD", 7), page(F.lit('{"apollo.state":{}}')))
            .otherwise(html)
        )
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return made.select(
        F.lit(1).cast("bigint").alias("run_id"),
        (F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("p_type")) - 1).cast("int").alias("category_idx"),
        F.col("p_type").alias("category"),
        "page",
        F.concat(F.lit("https://lots.example/lots/"), "p_type", F.lit("/?apage="), F.col("page").cast("string")).alias("url"),
        html.alias("html"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )
