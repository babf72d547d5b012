"""Every operator as a query over the test tables, with the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlake.functions import payload as P
from lotlake.operators import dedup, entities, merge, quality, reports, runs
from lotlake.plans import ingest, models
from lotlake.schemas import ITEMS
from lotlake.session import prepare
from lotlake.sources import fixtures, tables
from lotlake.sources.pages import frontier, read_html, read_pages, requested_pages
from lotlake.sources.scratch import remove, scratch_dir
from lotlake.streaming import upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Lots that the limited crawls take.
LIMIT = 900
PAGE = ["category_idx", "page"]

_OBS = """obs AS (
  SELECT date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS run_id, event_id AS seq, CAST(user_id AS VARCHAR) AS item_id, props AS raw_json, ts AS scraped_at,
    lpad(CAST(user_id % 10 AS VARCHAR), 5, '0') AS zip_code, [10, 25, 50, 100, 250, 500][user_id % 6 + 1] AS radius_miles, event_type AS category FROM events)"""
_CLASSES = f"""{_OBS}, classed AS (
  SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN before <> raw_json THEN 'updated' ELSE 'unchanged' END AS change
  FROM (SELECT *, lag(raw_json) OVER (PARTITION BY item_id ORDER BY seq) AS before FROM obs))"""
_ITEMS = """lots AS (
  SELECT *, l_orderkey * 10 + l_linenumber AS number FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
items AS (
  SELECT CAST(number AS VARCHAR) AS item_id, p_name AS lead, CAST(round(l_extendedprice * 100) AS BIGINT) AS bid, l_returnflag = 'N' AS shipping, 'Auction:' || o_orderkey AS auction_ref,
    c_mktsegment || ' ' || o_orderpriority AS event_name, n_name AS event_city, r_name AS event_state, l_shipdate AS scraped_at, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip_code,
    [10, 25, 50, 100, 250, 500, 75][c_nationkey % 7 + 1] AS radius_miles, nullif(p_type, 'STANDARD') AS category
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS first FROM lots)
  WHERE first = 1)"""
_KINDS = "['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']"
_LOTS = f"""placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY p_type, page ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_discount, l_tax) - 1 AS INTEGER) AS pos
  FROM (SELECT *, CAST(1 + l_orderkey // {fixtures.ORDERS_PER_PAGE} AS INTEGER) AS page, l_orderkey * 10 + l_linenumber AS number,
    CAST(list_position({_KINDS}, p_type) - 1 AS INTEGER) AS category_idx FROM lineitem JOIN part ON l_partkey = p_partkey))"""
_FAULTS = f"""{_LOTS}, rows AS (
  SELECT * FROM placed WHERE NOT (category_idx = 0 AND page = 5) UNION ALL SELECT * REPLACE (5 AS page) FROM placed WHERE category_idx = 0 AND page = 4),
page_list AS (
  SELECT *, CASE WHEN status IN ('fetch_failed', 'bad_json') THEN 1 ELSE 0 END AS errors FROM (
    SELECT DISTINCT category_idx, page, CASE WHEN category_idx = 1 AND page = 6 THEN 'fetch_failed' WHEN category_idx = 2 AND page = 5 THEN 'empty_body' WHEN category_idx = 3 AND page = 4 THEN 'no_script'
      WHEN category_idx = 4 AND page = 3 THEN 'bad_json' WHEN category_idx = 5 AND page = 7 THEN 'empty_state' ELSE 'ok' END AS status FROM rows)),
found AS (SELECT category_idx, page, pos, CAST(number AS VARCHAR) AS item_id FROM rows JOIN page_list USING (category_idx, page) WHERE status = 'ok'),
firsts AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY category_idx, item_id ORDER BY page, pos) AS nth FROM found) WHERE nth = 1),
counted AS (
  SELECT p.*, coalesce(n_lots, 0) AS n_lots, coalesce(n_new, 0) AS n_new FROM page_list p
  LEFT JOIN (SELECT category_idx, page, count(*) AS n_lots FROM found GROUP BY ALL) USING (category_idx, page)
  LEFT JOIN (SELECT category_idx, page, count(*) AS n_new FROM firsts GROUP BY ALL) USING (category_idx, page)),
stops AS (
  SELECT *, min(CASE WHEN status <> 'ok' OR n_new = 0 OR gap THEN page END) OVER c AS stop, min(CASE WHEN status = 'ok' AND n_new > 0 AND n_lots < 50 THEN page END) OVER c AS last
  FROM (SELECT *, page <> row_number() OVER (PARTITION BY category_idx ORDER BY page) AS gap FROM counted) WINDOW c AS (PARTITION BY category_idx)),
seen AS (
  SELECT *, (stop IS NULL OR page < stop) AND (last IS NULL OR page <= last) AS emits FROM stops
  WHERE (stop IS NULL OR page < stop OR (page = stop AND NOT gap)) AND (last IS NULL OR page <= last)),
got AS (SELECT *, coalesce(sum(CASE WHEN emits THEN n_new ELSE 0 END) OVER (PARTITION BY category_idx ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seen),
limited AS (SELECT *, CASE WHEN emits THEN least(n_new, {LIMIT} - before) ELSE 0 END AS take FROM got WHERE before < {LIMIT}),
taken AS (SELECT * EXCLUDE (r) FROM (SELECT f.*, take, before + row_number() OVER (PARTITION BY category_idx, page ORDER BY pos) AS nth, row_number() OVER (PARTITION BY category_idx, page ORDER BY pos) AS r
  FROM firsts f JOIN limited USING (category_idx, page)) WHERE r <= take),
run_limit AS (SELECT category_idx FROM (SELECT category_idx, coalesce(sum(n) OVER (ORDER BY category_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM (SELECT category_idx, sum(take) AS n FROM limited GROUP BY 1)) WHERE earlier < {LIMIT})"""
_RUNS = f"""{_CLASSES}, runs AS (
  SELECT run_id AS id, min(scraped_at) AS started_at, max(scraped_at) AS completed_at, '04217' AS zip_code, 25 AS radius_miles, run_id % 2 = 0 AS test_mode,
    CASE run_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'interrupted' ELSE 'completed' END AS status, count(*) AS items_found,
    CASE WHEN run_id % 5 > 1 THEN count(*) FILTER (change = 'new') ELSE 0 END AS items_added, CASE WHEN run_id % 5 > 1 THEN count(*) FILTER (change = 'updated') ELSE 0 END AS items_updated,
    CASE WHEN run_id % 5 = 0 THEN 1 ELSE 0 END AS errors FROM classed GROUP BY run_id)"""


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(ts: str):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


def _sql_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S') AS {ts}"


def _no_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ITEMS)


def _lots(spark: SparkSession, sf_dir: str, **kind) -> DataFrame:
    return entities.lots(entities.page_states(fixtures.pages(spark, sf_dir, **kind)))


def _ids(spark: SparkSession, sf_dir: str, **kind) -> DataFrame:
    return entities.lot_ids(entities.page_states(fixtures.pages(spark, sf_dir, **kind)))


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = ingest.page_rows(fixtures.pages(spark, sf_dir, faults=True), scratch_dir(spark, "crawl"))
    firsts = dedup.first_seen(found.lots)
    return firsts, dedup.page_counts(found.states, found.lots, firsts)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fixtures.observations(spark, sf_dir)
    status = F.when(F.col("run_id") % 5 == 0, "failed").when(F.col("run_id") % 5 == 1, "interrupted").otherwise("completed")
    started = obs.groupBy("run_id").agg(F.min("scraped_at").alias("started_at"), F.max("scraped_at").alias("completed_at")).select(
        "*", F.lit("04217").alias("zip_code"), F.lit(25).alias("radius_miles"), (F.col("run_id") % 2 == 0).alias("test_mode"), status.alias("status")
    )
    no_pages = started.select("run_id", F.lit(0).alias("errors"), F.lit(0).alias("pages_scraped"), F.lit(0).alias("lots_found"))
    return runs.finished(started, ingest.counters(_no_items(spark), obs), no_pages)


# sources


@query(
    """WITH kinds AS (SELECT DISTINCT p_type FROM part),
    c AS (SELECT p_type AS category, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS category_idx FROM kinds),
    r AS (SELECT CAST(1 AS BIGINT) AS run_id, category_idx, category FROM c UNION ALL SELECT 2, 0, NULL)
    SELECT run_id, category_idx, category, CAST(n AS INTEGER) AS page,
      'https://lots.example/lots/' || coalesce(category || '/', '') || '?status=open&zip=04217&miles=25&apage=' || n || '&ipp=100' AS url FROM r, range(1, 21) t(n)"""
)
def search_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = fixtures.table(spark, sf_dir, "part").select("p_type").distinct()
    listed = kinds.agg(F.array_join(F.array_sort(F.collect_list("p_type")), " , ,").alias("categories"))
    requests = listed.select(F.lit(1).cast("bigint").alias("run_id"), "categories").unionByName(listed.select(F.lit(2).cast("bigint").alias("run_id"), F.lit(None).cast("string").alias("categories")))
    return frontier(requests.withColumns({"zip_code": F.lit("04217"), "radius_miles": F.lit(25)}), "https://lots.example", 20)


@query("""WITH t AS (SELECT DISTINCT p_name AS term FROM part) SELECT CAST(1 AS BIGINT) AS run_id, term AS search_term, CAST(n AS INTEGER) AS page,
    'https://lots.example/lots/?status=open&zip=04217&miles=25&apage=' || n || '&ipp=100&q=' || replace(term, ' ', '+') AS url FROM t, range(1, 4) r(n)""")
def term_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to fetch for each search term, here all names of parts."""
    terms = fixtures.table(spark, sf_dir, "part").select(F.col("p_name").alias("search_term")).distinct()
    asked = terms.withColumns({"run_id": F.lit(1).cast("bigint"), "categories": F.lit(None).cast("string"), "zip_code": F.lit("04217"), "radius_miles": F.lit(25)})
    return frontier(asked, "https://lots.example", 3).select("run_id", "search_term", "page", "url")


@query(f"""WITH {_FAULTS} SELECT status, count(*) AS n_pages, CAST(sum(errors) AS BIGINT) AS errors FROM (
    SELECT status, errors FROM page_list UNION ALL SELECT 'no_script', 0 FROM pages) GROUP BY status""")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthesised result pages, and the raw web pages, none of which holds a state."""
    raw = fixtures.table(spark, sf_dir, "pages").select(
        F.lit(2).cast("bigint").alias("run_id"), F.lit(0).alias("category_idx"), F.lit(None).cast("string").alias("category"), F.col("page_id").cast("int").alias("page"), "url", "html", F.lit(None).cast("timestamp").alias("fetched_at")
    )
    path = scratch_dir(spark, "fetched")
    fixtures.pages(spark, sf_dir, faults=True).unionByName(raw).write.parquet(path)
    states = entities.page_states(read_pages(spark, path))
    return states.groupBy("status").agg(F.count("*").alias("n_pages"), F.sum("errors").alias("errors"))


@query("""SELECT page_id, CASE WHEN page_id % 50 = 8 THEN 'fetch_failed' WHEN page_id % 50 = 7 THEN 'empty_body' ELSE 'no_script' END AS status, CASE WHEN page_id % 50 = 8 THEN 1 ELSE 0 END AS errors,
    CASE WHEN page_id % 50 = 8 THEN NULL WHEN page_id % 50 = 7 THEN 0 ELSE length(html) END AS n_chars FROM pages""")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as raw files, read back against the list of what was asked for. Some files are empty, some aren't there."""
    raw, path = fixtures.table(spark, sf_dir, "pages").select("page_id", "html"), scratch_dir(spark, "files")
    place = F.col("page_id") % 50
    fixtures.write_files(raw.where(place != 8).select(F.concat(F.lit("p"), "page_id").alias("name"), F.when(place != 7, F.col("html")).alias("html")), path)
    # the files are opened once; what was asked for is then matched with a table
    files = ingest.stored(read_html(spark, path), scratch_dir(spark, "read"))
    asked = raw.select(F.lit(1).cast("bigint").alias("run_id"), F.lit(0).alias("category_idx"), F.lit(None).cast("string").alias("category"), F.col("page_id").cast("int").alias("page"), "page_id")
    pages = requested_pages(asked, files, F.concat(F.lit("p"), "page_id"), F.regexp_extract("url", "/(p[0-9]+)[.]html$", 1))
    pages = ingest.stored(pages, f"{scratch_dir(spark, 'asked')}/pages")
    states = entities.page_states(pages).select("page", "status", "errors")
    return pages.select("page", "page_id", F.length("html").alias("n_chars")).join(states, "page").select("page_id", "status", "errors", "n_chars")


# entities


@query(f"WITH {_LOTS} SELECT category_idx, page, count(*) AS n_lots FROM placed GROUP BY ALL")
def lot_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).groupBy(*PAGE).agg(F.count("*").alias("n_lots"))


@query(f"""WITH {_LOTS} SELECT category_idx, page, pos, 'Auction:' || l_orderkey AS auction_ref, CASE WHEN l_orderkey % 7 <> 0 THEN 'Sale ' || l_orderkey END AS event_name FROM placed""")
def resolve_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lots(spark, sf_dir).select(*PAGE, "pos", "auction_ref", F.try_variant_get("auction", "$.eventName", "string").alias("event_name"))


@query(f"WITH {_LOTS} SELECT category_idx, page, pos, 'LotState:' || l_returnflag || l_linestatus AS lot_state_ref, l_returnflag AS flag FROM placed")
def resolve_lot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lots(spark, sf_dir).select(*PAGE, "pos", "lot_state_ref", F.try_variant_get("lot_state", "$.flag", "string").alias("flag"))


@query(f"""WITH {_LOTS} SELECT category_idx, page, pos, CASE l_partkey % 6 WHEN 0 THEN CAST(number AS VARCHAR) WHEN 1 THEN 'i' || number WHEN 2 THEN CAST(number AS VARCHAR)
    WHEN 3 THEN 'lot-0' WHEN 4 THEN 'lot-False' END AS item_id FROM placed""")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir, ids="mixed").select(*PAGE, "pos", "item_id")


@query(f"""WITH {_LOTS} SELECT category_idx, page, pos, CAST(number AS VARCHAR) AS item_id, p_name AS lead, CAST(round(l_extendedprice * 100) AS BIGINT) AS bid,
    'Auction:' || l_orderkey AS auction_ref, CASE WHEN l_orderkey % 7 <> 0 THEN 'Sale ' || l_orderkey END AS event_name, l_returnflag AS flag,
    'LotState:' || l_returnflag || l_linestatus AS lot_state_ref, CASE WHEN l_orderkey % 7 <> 0 THEN 9 ELSE 8 END AS n_keys FROM placed""")
def enriched_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_json")
    get = lambda path: P.field(raw, path)
    return entities.payloads(_lots(spark, sf_dir)).select(
        *PAGE, "pos", "item_id", get("lead").alias("lead"), get("bidAmount").cast("bigint").alias("bid"), get("auction_ref").alias("auction_ref"), get("auction_data.eventName").alias("event_name"),
        get("lot_state_data.flag").alias("flag"), get("lot_state_ref").alias("lot_state_ref"), (F.size(F.json_object_keys(raw)) + 1).alias("n_keys"),
    )


# page order


@query(f"WITH {_FAULTS} SELECT category_idx, item_id, page, pos FROM firsts")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.page_rows(fixtures.pages(spark, sf_dir, faults=True), scratch_dir(spark, "crawl"))  # stored, or each use of an id works it out again
    return dedup.first_seen(found.lots).drop("run_id")


@query(f"WITH {_FAULTS} SELECT category_idx, page, status, errors, n_lots, n_new, emits FROM seen")
def page_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.reached(_counted(spark, sf_dir)[1]).select(*PAGE, "status", "errors", "n_lots", "n_new", "emits")


@query(f"WITH {_FAULTS} SELECT category_idx, item_id, page, pos, CAST(nth AS BIGINT) AS nth FROM taken")
def limit_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts, counted = _counted(spark, sf_dir)
    return dedup.emitted(firsts, dedup.reached(counted, limit=LIMIT)).drop("run_id")


@query(f"WITH {_FAULTS} SELECT category_idx, page, CAST(take AS BIGINT) AS take, errors FROM limited JOIN run_limit USING (category_idx)")
def limit_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.within_run_limit(dedup.reached(_counted(spark, sf_dir)[1], limit=LIMIT), LIMIT).select(*PAGE, "take", "errors")


@query(f"""WITH {_FAULTS}, page_sum AS (SELECT category_idx, count(*) AS pages_seen, CAST(sum(errors) AS BIGINT) AS errors FROM seen GROUP BY 1),
    all_taken AS (SELECT f.* FROM firsts f JOIN seen USING (category_idx, page) WHERE emits)
    SELECT category_idx, pages_seen, errors, count(item_id) AS n_items FROM page_sum LEFT JOIN all_taken USING (category_idx) GROUP BY ALL""")
def full_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to item table in one job, counted by category."""
    scratch = scratch_dir(spark, "crawl")
    done = ingest.crawl(ingest.stored(fixtures.pages(spark, sf_dir, faults=True), f"{scratch}/pages"), scratch)
    batch = ingest.stored(ingest.observations(done.observed, "04217", 25, F.lit("2024-01-01 00:00:00").cast("timestamp")), f"{scratch}/observations")
    items = ingest.upsert(_no_items(spark), batch, scratch).items
    per_page = done.pages.groupBy("category_idx").agg(F.count("*").alias("pages_seen"), F.sum("errors").alias("errors"))
    # an item that several categories show is one row; it counts where it was last changed, so count observations
    per_item = batch.join(items.select("item_id"), "item_id", "left_semi").groupBy("seq.category_idx").agg(F.count("*").alias("n_items"))
    return per_page.join(per_item, "category_idx", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


@query(f"""WITH {_LOTS} SELECT nullif(p_type, 'LARGE') AS category, count(*) AS n_lots, count(DISTINCT number) AS n_items FROM placed GROUP BY p_type""")
def gather_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of five categories and of a pass without one, one after the other; repeats stay."""
    found = ingest.stored(_ids(spark, sf_dir).select("category", "item_id"), f"{scratch_dir(spark, 'gather')}/lots")
    kinds = [r[0] for r in found.select("category").distinct().orderBy("category").collect()]  # six
    parts = [(None if kind == "LARGE" else kind, found.where(F.col("category") == kind).drop("category")) for kind in kinds]
    return dedup.gathered(*parts).groupBy("category").agg(F.count("*").alias("n_lots"), F.count_distinct("item_id").alias("n_items"))


@query(f"WITH {_LOTS} SELECT category_idx, count(*) AS n_lots FROM placed WHERE l_partkey % 6 = 5 GROUP BY category_idx")
def lots_without_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.without_id(_ids(spark, sf_dir, ids="mixed")).drop("run_id")


@query(f"""WITH {_FAULTS}, page_sum AS (SELECT CAST(sum(errors) AS BIGINT) AS errors, count(*) FILTER (status = 'ok') AS pages_scraped, CAST(sum(CASE WHEN emits THEN n_new ELSE 0 END) AS BIGINT) AS lots_found FROM seen),
    got_lots AS (
      SELECT *, lag(payload) OVER (PARTITION BY item_id ORDER BY category_idx, page, pos) AS prior
      FROM (SELECT f.*, p_name || '|' || round(l_extendedprice * 100) || '|' || l_returnflag || l_linestatus AS payload
        FROM firsts f JOIN seen USING (category_idx, page) JOIN rows USING (category_idx, page, pos) WHERE emits))
    SELECT CAST(1 AS BIGINT) AS id, 'completed' AS status, CAST(count(*) AS INTEGER) AS items_found, CAST(count(*) FILTER (prior IS NULL) AS INTEGER) AS items_added,
      CAST(count(*) FILTER (prior <> payload) AS INTEGER) AS items_updated, CAST(any_value(errors) AS INTEGER) AS errors, any_value(pages_scraped) AS pages_scraped, any_value(lots_found) AS lots_found
    FROM got_lots, page_sum""")
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit row of a crawl: what it stored, and the errors, pages and lots that it met."""
    scratch = scratch_dir(spark, "crawl")
    done = ingest.crawl(ingest.stored(fixtures.pages(spark, sf_dir, faults=True), f"{scratch}/pages"), scratch)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    batch = ingest.stored(ingest.observations(done.observed, "04217", 25, at), f"{scratch}/observations")
    started = spark.range(1, 2).select(
        F.col("id").alias("run_id"), at.alias("started_at"), at.alias("completed_at"), F.lit("04217").alias("zip_code"), F.lit(25).alias("radius_miles"), F.lit(False).alias("test_mode"), F.lit("completed").alias("status")
    )
    met = ingest.stored(runs.page_totals(done.pages), f"{scratch}/met")
    audit = runs.finished(started, ingest.counters(_no_items(spark), batch), met)
    return audit.join(met.select(F.col("run_id").alias("id"), "pages_scraped", "lots_found"), "id").select("id", "status", "items_found", "items_added", "items_updated", "errors", "pages_scraped", "lots_found")


@query(f"""WITH {_FAULTS}, page_sum AS (SELECT CAST(sum(errors) AS INTEGER) AS errors, CAST(sum(CASE WHEN emits THEN n_new ELSE 0 END) AS INTEGER) AS found FROM seen)
    SELECT CAST(id AS BIGINT) AS id, status, found AS items_found, 0 AS items_added, 0 AS items_updated, CAST(errors + CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS INTEGER) AS errors
    FROM page_sum, (VALUES (2, 'failed'), (3, 'interrupted')) t(id, status)""")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of a crawl that failed and of one that was interrupted: page errors and found lots count, stored items don't."""
    scratch = scratch_dir(spark, "crawl")
    pages = ingest.stored(fixtures.pages(spark, sf_dir, faults=True), f"{scratch}/pages")
    done = ingest.crawl(pages.withColumn("run_id", F.explode(F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint")))), scratch)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    batch = ingest.stored(ingest.observations(done.observed, "04217", 25, at), f"{scratch}/observations")
    started = spark.range(2, 4).select(
        F.col("id").alias("run_id"), at.alias("started_at"), at.alias("completed_at"), F.lit("04217").alias("zip_code"), F.lit(25).alias("radius_miles"), F.lit(False).alias("test_mode"),
        F.when(F.col("id") == 2, "failed").otherwise("interrupted").alias("status"),
    )
    audit = runs.finished(started, ingest.counters(_no_items(spark), batch), ingest.stored(runs.page_totals(done.pages), f"{scratch}/met"))
    return audit.select("id", "status", "items_found", "items_added", "items_updated", "errors")


# merge


@query(f"WITH {_CLASSES} SELECT item_id, seq, change FROM classed")
def change_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.change_classes(_no_items(spark), fixtures.observations(spark, sf_dir)).drop("run_id")


_MERGED_SQL = f"""WITH {_CLASSES}, f AS (SELECT item_id, row_number() OVER (ORDER BY min(seq)) AS id, arg_min(scraped_at, seq) AS created_at FROM classed GROUP BY item_id),
    n AS (SELECT item_id, max(seq) AS seq FROM classed WHERE change <> 'unchanged' GROUP BY item_id)
    SELECT CAST(f.id AS BIGINT) AS id, item_id, raw_json, {_sql_text("scraped_at")}, zip_code, radius_miles, category, {_sql_text("created_at")} FROM n JOIN classed USING (item_id, seq) JOIN f USING (item_id)"""


@query(_MERGED_SQL)
def merge_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier half becomes a stored snapshot, the later half is merged into it as read back."""
    obs = fixtures.observations(spark, sf_dir)
    half = (obs.agg(F.max("seq")).first()[0] or 0) // 2
    root = scratch_dir(spark, "items")
    tables.write_items(ingest.upsert(_no_items(spark), obs.where(F.col("seq") <= half), f"{root}/first").items, root, 1)
    remove(spark, f"{root}/first")
    items = ingest.upsert(tables.read_items(spark, root), obs.where(F.col("seq") > half), f"{root}/second").items
    tables.write_items(items, root, 2)
    remove(spark, f"{root}/second")
    return tables.read_items(spark, root).select("id", "item_id", "raw_json", _text("scraped_at"), "zip_code", "radius_miles", "category", _text("created_at"))


@query(f"""WITH {_OBS}, k AS (SELECT item_id, seq, CAST(json_extract(raw_json, '$.k') AS VARCHAR) AS k FROM obs), b AS (SELECT *, lag(k) OVER (PARTITION BY item_id ORDER BY seq) AS before FROM k)
    SELECT CASE WHEN before IS NULL THEN 'new' WHEN before <> k THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS n FROM b GROUP BY 1""")
def merge_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads whose keys come in either order and spacing compare by value."""
    k = P.field(F.col("raw_json"), "k")
    shuffled = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"z":1,"k":'), k, F.lit("}"))).otherwise(F.concat(F.lit('{ "k" : '), k, F.lit(', "z" : 1 }')))
    classes = merge.change_classes(_no_items(spark), fixtures.observations(spark, sf_dir).withColumn("raw_json", shuffled), mode="canonical")
    return classes.groupBy("change").agg(F.count("*").alias("n"))


@query(f"WITH {_OBS} SELECT item_id, row_number() OVER (ORDER BY min(seq)) AS id FROM obs GROUP BY item_id")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = scratch_dir(spark, "ids")
    new = ingest.stored(merge.merged(_no_items(spark), fixtures.observations(spark, sf_dir)), f"{scratch}/merged")
    return merge.with_ids(new, f"{scratch}/ranges").select("item_id", F.col("id").cast("bigint").alias("id"))


@query(f"""WITH {_ITEMS}, f AS (SELECT item_id, term FROM items JOIN (VALUES ('gear'), ('old'), ('red'), ('ring')) t(term) ON lead ILIKE '%' || term || '%')
    SELECT item_id, string_agg(term, ',' ORDER BY term) AS search_terms, count(*) AS n_terms FROM f GROUP BY item_id""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for two terms are merged, then searches for two more: an item keeps every term that has found it.

    All four look through the listing in one scan; what they find is stored, and the listing is not.
    """
    root, runs_of = scratch_dir(spark, "items"), {"red": 1, "gear": 1, "ring": 2, "old": 2}
    found = models.tagged(fixtures.items(spark, sf_dir), list(runs_of), P.field(F.col("raw_json"), "lead"))
    run = F.element_at(F.create_map(*[F.lit(x) for pair in runs_of.items() for x in pair]), F.col("search_term")).cast("bigint")
    found = ingest.stored(found.select(run.alias("run_id"), F.struct("search_term", "id").alias("seq"), "item_id", "raw_json", "scraped_at", "zip_code", "radius_miles", "category", "search_term"), scratch_dir(spark, "found"))
    for version in (1, 2):
        work = scratch_dir(spark, "merge")
        done = ingest.upsert(tables.read_items(spark, root), found.where(F.col("run_id") == version), work)
        tables.write_items(done.items, root, version)
        remove(spark, work)
    return tables.read_items(spark, root).select("item_id", F.array_join("search_terms", ",").alias("search_terms"), F.size("search_terms").cast("bigint").alias("n_terms"))


# runs


@query(f"WITH {_CLASSES} SELECT run_id, count(*) AS items_found, count(*) FILTER (change = 'new') AS items_added, count(*) FILTER (change = 'updated') AS items_updated FROM classed GROUP BY run_id")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fixtures.observations(spark, sf_dir)
    return ingest.counters(_no_items(spark), obs)


@query(f"""WITH {_RUNS} SELECT id, status, zip_code, radius_miles, CASE WHEN test_mode THEN 'Yes' ELSE 'No' END AS test_mode, CASE WHEN id % 3 = 0 THEN 'all' ELSE 'art, coins' END AS categories,
    CAST(date_diff('microsecond', started_at, completed_at) AS DOUBLE) / 1e6 AS seconds, CAST(items_found AS INTEGER) AS items_found, CAST(items_added AS INTEGER) AS items_added,
    CAST(items_updated AS INTEGER) AS items_updated, errors FROM runs""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows as written and read again."""
    path = scratch_dir(spark, "runs")
    tables.append_runs(_runs(spark, sf_dir), path)
    return runs.summary(tables.read_runs(spark, path), F.when(F.col("id") % 3 != 0, P.category_list(F.lit(" art,, coins ,"))))


@query(f"WITH {_RUNS} SELECT id, status, CAST(items_found AS INTEGER) AS items_found, {_sql_text('started_at')} FROM runs WHERE id = 1463")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_by_id(_runs(spark, sf_dir), 1463).select("id", "status", "items_found", _text("started_at"))


@query(f"WITH {_RUNS} SELECT id, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, status, CAST(items_found AS INTEGER) AS items_found FROM runs ORDER BY runs.started_at DESC, id DESC LIMIT 20")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.history(_runs(spark, sf_dir)).select("id", P.iso_seconds(F.col("started_at")).alias("started_at"), "status", "items_found")


@query(f"WITH {_RUNS} SELECT count(*) AS n_runs FROM runs")
def run_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_rows(_runs(spark, sf_dir), "n_runs")


# reports


@query(f"WITH {_ITEMS} SELECT item_id, lead, zip_code, radius_miles, category, {_sql_text('scraped_at')} FROM items WHERE item_id = '1001' OR item_id = '10'")
def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixtures.items(spark, sf_dir)
    return reports.items_by_id(items, "1001", "10").select("item_id", P.field(F.col("raw_json"), "lead").alias("lead"), "zip_code", "radius_miles", "category", _text("scraped_at"))


@query(f"""WITH {_ITEMS} SELECT item_id, CAST(json_object('lead', lead, 'bidAmount', bid, 'shippingOffered', shipping, 'auction_ref', auction_ref,
    'auction_data', json_object('eventName', event_name, 'eventCity', event_city, 'eventState', event_state)) AS VARCHAR) AS raw_json FROM items WHERE item_id IN ('1001', '10', '20001')""")
def item_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.items_by_id(fixtures.items(spark, sf_dir), "1001", "10", "20001").select("item_id", "raw_json")


@query(f"WITH {_OBS} SELECT seq, {_sql_text('scraped_at')}, epoch_us(scraped_at) % 1000000 AS micros FROM obs")
def text_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times stored as text, with T or a blank, with and without fraction and offset, read back."""
    form = lambda pattern: F.date_format("scraped_at", pattern)
    text = F.when(F.col("seq") % 2 == 0, form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(form("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    text = F.when(F.unix_micros("scraped_at") % 1_000_000 == 0, F.left(text, F.lit(19))).otherwise(text)
    text = F.when(F.col("seq") % 3 == 0, F.concat(text, F.lit("+00:00"))).otherwise(text)
    read = fixtures.observations(spark, sf_dir).withColumn("scraped_at", P.stored_time(text))
    return read.select("seq", _text("scraped_at"), (F.unix_micros("scraped_at") % 1_000_000).alias("micros"))


@query(f"WITH {_ITEMS} SELECT item_id, category FROM items WHERE zip_code = '00007'")
def items_by_zip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.items_in_zip(fixtures.items(spark, sf_dir), "00007").select("item_id", "category")


@query(f"WITH {_ITEMS} SELECT item_id, lead FROM items WHERE lead ILIKE '%red ring%' ORDER BY item_id LIMIT 20")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search(fixtures.items(spark, sf_dir), "Red RING").select("item_id", P.field(F.col("raw_json"), "lead").alias("lead"))


@query(f"WITH {_ITEMS} SELECT item_id FROM items WHERE lead ILIKE '%gear%'")
def text_search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.items(spark, sf_dir).where(F.col("raw_json").ilike("%GEAR%")).select("item_id")


@query(f"WITH {_ITEMS} SELECT item_id, event_name FROM items WHERE event_name ILIKE '%house%urgent%'")
def auction_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_json")
    return fixtures.items(spark, sf_dir).where(P.field_like(raw, "auction_data.eventName", "%House%Urgent%")).select("item_id", P.field(raw, "auction_data.eventName").alias("event_name"))


@query(f"WITH {_ITEMS} SELECT category, count(*) AS n_items FROM items WHERE event_state = 'ASIA' GROUP BY category")
def state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.items(spark, sf_dir).where(P.field(F.col("raw_json"), "auction_data.eventState") == "ASIA")
    return reports.per_value(rows, "category")


@query(f"WITH {_ITEMS} SELECT count(*) AS n_items FROM items WHERE shipping")
def shipping_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_rows(fixtures.items(spark, sf_dir).where(P.is_true(F.col("raw_json"), "shippingOffered")), "n_items")


@query(f"WITH {_ITEMS} SELECT item_id FROM items WHERE NOT shipping AND lead = 'small ring'")
def shipping_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.items(spark, sf_dir).where(P.contains(F.col("raw_json"), {"shippingOffered": False, "lead": "small ring"})).select("item_id")


@query(f"WITH {_ITEMS} SELECT item_id, lead, bid AS bid_amount, shipping AS shipping_offered, event_city, event_state FROM items")
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flat(fixtures.items(spark, sf_dir)).select("item_id", "lead", F.col("bid_amount").cast("bigint").alias("bid_amount"), "shipping_offered", "event_city", "event_state")


@query(f"WITH {_ITEMS} SELECT count(*) AS n_items FROM items")
def item_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_rows(fixtures.items(spark, sf_dir), "n_items")


@query(f"WITH {_ITEMS} SELECT strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS newest FROM items")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.date_range(fixtures.items(spark, sf_dir)).select(_text("oldest"), _text("newest"))


@query(f"WITH {_ITEMS} SELECT category, count(*) AS n_items FROM items GROUP BY category")
def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_value(fixtures.items(spark, sf_dir), "category")


@query(f"WITH {_ITEMS} SELECT zip_code, count(*) AS n_items FROM items GROUP BY zip_code")
def by_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_value(fixtures.items(spark, sf_dir), "zip_code")


@query(f"""WITH {_ITEMS}, g AS (SELECT grouping(category) AS a, grouping(zip_code) AS b, category, zip_code, count(*) AS n_items, min(scraped_at) AS oldest, max(scraped_at) AS newest
    FROM items GROUP BY GROUPING SETS ((), (category), (zip_code)))
    SELECT CASE WHEN a = 1 AND b = 1 THEN 'total' WHEN a = 0 THEN 'category' ELSE 'zip_code' END AS section, CASE WHEN a = 0 THEN coalesce(category, 'all') WHEN b = 0 THEN zip_code END AS value,
      n_items, {_sql_text("oldest")}, {_sql_text("newest")} FROM g""")
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.statistics(fixtures.items(spark, sf_dir)).select("section", "value", "n_items", _text("oldest"), _text("newest"))


@query(f"WITH {_ITEMS} SELECT item_id, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at, category, zip_code FROM items ORDER BY items.scraped_at DESC, item_id LIMIT 100")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent(fixtures.items(spark, sf_dir)).select("item_id", _text("scraped_at"), "category", "zip_code")


@query(f"""WITH {_ITEMS} SELECT item_id, left(lead, 50) AS title, left(event_name, 30) AS event, event_city || ', ' || event_state AS location, coalesce(category, 'all') AS category,
    strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS scraped_at FROM items ORDER BY items.scraped_at DESC, item_id LIMIT 10""")
def recent_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_display(fixtures.items(spark, sf_dir))


# checks and models


@query(f"""WITH {_ITEMS} SELECT 'repeated item_id' AS check_name, count(*) FILTER (CAST(item_id AS BIGINT) % 1000 = 1) AS n FROM items UNION ALL SELECT 'null category', count(*) FILTER (category IS NULL) FROM items
    UNION ALL SELECT 'null zip_code', count(*) FILTER (zip_code IS NULL) FROM items UNION ALL SELECT 'null raw_json', 0""")
def dup_and_null_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item table into which some rows were written twice."""
    items = fixtures.items(spark, sf_dir)
    twice = quality.repeated(items.unionByName(items.where("id % 1000 = 1")), "item_id").agg(F.lit("repeated item_id").alias("check_name"), F.count("*").alias("n"))
    empty = quality.nulls(items, ["category", "zip_code", "raw_json"])
    return twice.unionByName(empty.select(F.concat(F.lit("null "), "column_name").alias("check_name"), F.col("n_null").alias("n")))


@query(f"WITH {_ITEMS} SELECT item_id, radius_miles FROM items WHERE radius_miles NOT IN (10, 25, 50, 100, 250, 500)")
def radius_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.odd_radius(fixtures.items(spark, sf_dir)).select("item_id", "radius_miles")


@query(f"""WITH {_ITEMS} SELECT CAST(item_id AS BIGINT) AS id, item_id, lead, bid AS bid_amount, shipping AS shipping_offered, auction_ref, event_name, event_city, event_state, zip_code, radius_miles, category,
    {_sql_text("scraped_at")} FROM items""")
def stg_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.staged_items(fixtures.items(spark, sf_dir))
    return rows.select("id", "item_id", "lead", F.col("bid_amount").cast("bigint").alias("bid_amount"), "shipping_offered", "auction_ref", "event_name", "event_city", "event_state", "zip_code", "radius_miles", "category", _text("scraped_at"))


@query(f"WITH {_ITEMS} SELECT auction_ref, min(event_name) AS event_name, min(event_city) AS event_city, min(event_state) AS event_state, count(*) AS n_items FROM items GROUP BY auction_ref")
def stg_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.staged_auctions(models.staged_items(fixtures.items(spark, sf_dir)))


@query(f"""WITH {_ITEMS} SELECT auction_ref, arg_max(event_name || ' ' || item_id, strftime(scraped_at, '%Y-%m-%d') || item_id) AS event_name, count(*) AS n_items FROM items GROUP BY auction_ref""")
def newest_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item says something else about its auction; the newest one counts, of equally new ones the largest id."""
    staged = models.staged_items(fixtures.items(spark, sf_dir)).withColumn("event_name", F.concat_ws(" ", "event_name", "item_id"))
    return models.staged_auctions(staged).select("auction_ref", "event_name", "n_items")


@query(f"WITH {_ITEMS} SELECT item_id, lead, auction_ref, event_name, event_city, count(*) OVER (PARTITION BY auction_ref) AS auction_items FROM items")
def fct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = models.staged_items(fixtures.items(spark, sf_dir))
    return models.fact_items(staged, models.staged_auctions(staged)).select("item_id", "lead", "auction_ref", "event_name", "event_city", "auction_items")


@query(f"WITH {_OBS} SELECT 'run-' || run_id AS sys_run_name, count(*) AS n, CASE WHEN run_id % 2 = 0 THEN 1 ELSE 2 END AS build FROM obs GROUP BY run_id")
def incremental_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of even number are built, a build of some others dies half way; the next build adds what isn't whole and nothing else."""
    source, path = fixtures.observations(spark, sf_dir).withColumn("sys_run_name", F.concat(F.lit("run-"), F.col("run_id").cast("string"))), scratch_dir(spark, "facts")
    model = lambda build: lambda rows: rows.select("sys_run_name", "seq", "item_id", "raw_json", F.lit(build).alias("build")).repartition("sys_run_name")
    models.build_runs(source.where("run_id % 2 = 0"), path, model(1))
    model(0)(source.where("run_id % 10 = 3 AND seq % 2 = 0")).write.mode("append").partitionBy("sys_run_name").parquet(path)
    models.build_runs(source, path, model(2))
    return spark.read.parquet(path).groupBy("sys_run_name").agg(F.count("*").alias("n"), F.max("build").alias("build"))


@query(f"WITH {_ITEMS} SELECT term AS search_term, category, count(*) AS n FROM items JOIN (VALUES ('red'), ('gear'), ('plate')) t(term) ON lead ILIKE '%' || term || '%' GROUP BY ALL")
def search_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.tagged(fixtures.items(spark, sf_dir), ["red", "gear", "plate"], P.field(F.col("raw_json"), "lead"))
    return found.groupBy("search_term", "category").agg(F.count("*").alias("n"))


# streaming


def _stream(spark: SparkSession, sf_dir: str, shuffled: bool = False) -> DataFrame:
    """The events as files that have arrived in a folder."""
    landed, path = fixtures.table(spark, sf_dir, "events"), scratch_dir(spark, "landing")
    (landed.repartition(8, F.xxhash64("event_id")) if shuffled else landed).write.parquet(path)
    e = spark.readStream.schema(landed.schema).parquet(path)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {_OBS} SELECT run_id, category, item_id, count(*) OVER () * 0 + 1 AS n FROM (SELECT DISTINCT run_id, category, item_id FROM obs)")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select(
        F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("bigint").alias("run_id"), F.crc32("event_type").alias("category_idx"), F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("item_id"), F.col("ts").alias("fetched_at")
    )
    out, at = scratch_dir(spark, "arrivals"), scratch_dir(spark, "stream")
    first = upsert.first_arrivals(rows, "1 day")
    first.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("run_id", "category", "item_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_OBS}, p AS (SELECT run_id, category, item_id, hour(scraped_at) AS page, seq AS pos FROM obs)
    SELECT run_id, category, item_id, CAST(page AS INTEGER) AS page, pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id, category, item_id ORDER BY page, pos) AS nth FROM p) WHERE nth = 1
    AND run_id < (SELECT max(run_id) FROM p)""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First places in page order though events arrive shuffled; the last day's run is still open."""
    day = F.to_date("ts")
    rows = _stream(spark, sf_dir, shuffled=True).select(
        F.date_diff(day, F.lit("2020-01-01").cast("date")).cast("bigint").alias("run_id"), F.col("event_type").alias("category_idx"), F.col("user_id").cast("string").alias("item_id"), F.hour("ts").alias("page"), F.col("event_id").alias("pos"), day.cast("timestamp").alias("started_at")
    )
    out, at = scratch_dir(spark, "firsts"), scratch_dir(spark, "stream")
    upsert.first_in_order(rows, "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("run_id", F.col("category_idx").alias("category"), "item_id", "page", "pos")


@query(_MERGED_SQL)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge as a stream over the events, read back from the last snapshot."""
    e = _stream(spark, sf_dir)
    obs = e.select(
        F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("bigint").alias("run_id"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("item_id"), F.col("props").alias("raw_json"), F.col("ts").alias("scraped_at"),
        F.lpad((F.col("user_id") % 10).cast("string"), 5, "0").alias("zip_code"), fixtures._radius(F.col("user_id")).alias("radius_miles"), F.col("event_type").alias("category"),
    )
    root = scratch_dir(spark, "items")
    upsert.start_upsert(obs, root, f"{root}/counters", scratch_dir(spark, "stream")).awaitTermination()
    return tables.read_items(spark, root).select("id", "item_id", "raw_json", _text("scraped_at"), "zip_code", "radius_miles", "category", _text("created_at"))
