"""From fetched pages to lots: states, lot rows, resolved references, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlake.functions import state as S

KEY = ["run_id", "category_idx", "category", "page"]


def page_states(pages: DataFrame, script_id: str = S.SCRIPT_ID) -> DataFrame:
    """Rows (run_id, category_idx, category, page, status, errors, state); the html goes no further. Narrow."""
    rows = pages.select(*KEY, "html", S.state_text(F.col("html"), script_id).alias("text"))
    rows = rows.select(*KEY, "html", "text", S.state_map(F.col("text")).alias("state"))
    rows = rows.select(*KEY, S.page_status(F.col("html"), F.col("text"), F.col("state")).alias("status"), "state")
    return rows.select(*KEY, "status", S.page_errors(F.col("status")).alias("errors"), F.when(F.col("status") == "ok", F.col("state")).alias("state"))


def lot_ids(states: DataFrame, pages_too: bool = False) -> DataFrame:
    """One row per lot of a page: KEY, position, cache key and id, all that page order is decided by. Narrow.

    pages_too: with status and errors, and one row more for each page, whose other columns are null.
    """

    found = F.transform(F.filter(_entries(S.IDS), lambda e: S.is_kind(e["key"], e["facts"], "Lot")), lambda e: F.struct(e["pos"].alias("pos"), e["key"].alias("key"), e["facts"].alias("facts")))
    if pages_too:
        found = F.concat(F.array(F.lit(None)), F.coalesce(found, F.array()))
    shown = [*KEY, "status", "errors"] if pages_too else KEY
    return states.select(*shown, F.inline(found)).withColumn("item_id", S.item_id(F.col("facts"))).drop("facts")


def _entries(fields: str):
    """The entities of a state in order: pos, key and, of what is read of them, `fields`."""
    return F.transform(F.map_entries("state"), lambda e, i: F.struct(i.alias("pos"), e["key"].alias("key"), S.facts(e["value"], fields).alias("facts")))


def lots(states: DataFrame) -> DataFrame:
    """The rows of lot_ids() with the lot and what its references lead to. Narrow: lookups stay in the row.

    Entities stay in the page's state, an entry leads to them by its place. A key is looked up by its hash, once.
    """
    c = F.col
    # pages without a state give no row; a filter would be pushed below the parse and parse again
    rows = states.withColumn("entries", _entries(S.FACTS))
    rows = rows.withColumns({"auctions": S.auction_index(c("entries")), "state hashes": S.hashes(F.map_keys("state"))})
    rows = rows.withColumn("auction hashes", S.hashes(F.map_keys("auctions")))
    entity = lambda at: F.get(F.map_values("state"), at)

    def named(e):
        auction_ref, state_ref = e["facts"]["auction"]["__ref"], e["facts"]["lotState"]["__ref"]
        hits = S.hash_place(c("auction hashes"), auction_ref).alias("auction_hit"), S.hash_place(c("state hashes"), state_ref).alias("state_hit")
        return F.struct(e["pos"].alias("pos"), e["key"].alias("key"), e["facts"].alias("facts"), auction_ref.alias("auction_ref"), state_ref.alias("lot_state_ref"), *hits)

    def placed(e):
        auction_at = F.get(F.map_values("auctions"), S.place(F.map_keys("auctions"), e["auction_hit"], e["auction_ref"]))
        return F.struct(*[e[x].alias(x) for x in ("pos", "key", "facts", "auction_ref", "lot_state_ref")], auction_at.alias("auction_at"), S.place(F.map_keys("state"), e["state_hit"], e["lot_state_ref"]).alias("state_at"))

    def resolved(e):
        return F.struct(
            *[e[x].alias(x) for x in ("pos", "key", "facts", "auction_ref", "lot_state_ref")],
            entity(e["pos"]).alias("lot"),
            e["auction_at"].isNotNull().alias("has_auction"),
            entity(e["auction_at"]).alias("auction"),
            e["state_at"].isNotNull().alias("has_lot_state"),
            entity(e["state_at"]).alias("lot_state"),
        )

    found = F.filter("entries", lambda e: S.is_kind(e["key"], e["facts"], "Lot"))
    for step in (named, placed, resolved):
        found = F.transform(found, step)
    return rows.select(*KEY, F.inline(found)).withColumn("item_id", S.item_id(c("facts"))).drop("facts")


def payloads(rows: DataFrame) -> DataFrame:
    """`rows` of lots() with raw_json in place of what it is made of. Array functions without lambdas, which are compiled."""
    c = F.col
    own = rows.withColumn("own", S.own_fields(c("lot"))).withColumns({"keys of lot": F.map_keys("own"), "values of lot": F.map_values("own")})
    for name, ref in (("auction", "auction_ref"), ("lotState", "lot_state_ref")):
        own = own.withColumn("at", S.reference_place(c("keys of lot"), name, c(ref)))
        own = own.withColumns({"keys of lot": S.without(c("keys of lot"), c("at")), "values of lot": S.without(c("values of lot"), c("at"))})
    text = S.enriched(c("keys of lot"), c("values of lot"), c("has_auction"), c("auction"), c("auction_ref"), c("has_lot_state"), c("lot_state"), c("lot_state_ref"))
    return own.withColumn("raw_json", text).drop("lot", "auction", "lot_state", "has_auction", "has_lot_state", "own", "keys of lot", "values of lot", "at")
