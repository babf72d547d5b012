"""Columns that take a page's embedded entity cache apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Id of the script element that holds the state (each site has its own, so it is a parameter), and the key of the cache in it (fixed value).
SCRIPT_ID, STATE_KEY = "page-state", "apollo.state"
MAP = "map<string,variant>"


#: Attributes of a tag: names, each with a quoted value, a bare one or none. Possessive, so nothing is tried twice. Long runs
#: are atomic groups, which Java reads in a tight loop, as it doesn't a possessive run.
_ATTRIBUTE = r"""[^\s>/=]++(?:\s*+=\s*+(?:"(?>[^"]*)"|'(?>[^']*)'|[^\s>"'](?>[^\s>]*)|))?+"""
_ATTRIBUTES = rf"(?:[\s/=]++|{_ATTRIBUTE})*+"
#: The rest of an element whose content is text, up to its end tag: runs without a tag at a stride, not a match tried at each character.
_CONTENT = r"(?>[^<]*)(?:<(?!/{0}(?:[\s/>]|\z))(?>[^<]*))*+"
#: Tokens of HTML behind which a script tag isn't one: comments, elements whose content is text, tags. Group 1: a script element up to its end tag.
_TOKEN = (
    rf"(?is)<!--(?:(?>[^-]+)|-(?!->))*+(?:-->)?+|(<script(?=[\s/>]){_ATTRIBUTES}>{_CONTENT.format('script')})(?:</script)?+"
    rf"|<(style|textarea|title)(?=[\s/>]){_ATTRIBUTES}>" + _CONTENT.format(r"\2") + rf"(?:</\2)?+|</?[a-z]{_ATTRIBUTES}>"
)


def state_text(html: Column, script_id: str = SCRIPT_ID) -> Column:
    """Text of the first script element with the id; null if there is none or it is empty.

    One scan over the page's tokens, so a script inside a comment, an attribute or a text element doesn't count, and a tag
    doesn't end inside a quoted value. An element that is never closed goes on to the end. Time is linear in the page.
    """
    scripts = F.filter(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(1)), lambda x: x != "")
    opening = lambda x: F.regexp_extract(x, rf"(?is)^<script({_ATTRIBUTES})>", 1)
    named = rf"""^(?i:id)\s*=\s*(?:"{re.escape(script_id)}"|'{re.escape(script_id)}'|{re.escape(script_id)})$"""
    wanted = F.filter(scripts, lambda x: F.exists(F.regexp_extract_all(opening(x), F.lit(rf"(?s){_ATTRIBUTE}"), F.lit(0)), lambda a: a.rlike(named)))
    found = F.get(wanted, F.lit(0))
    opened = F.length(F.regexp_extract(found, rf"(?is)^<script{_ATTRIBUTES}>", 0))
    return F.nullif(F.substr(found, opened + 1), F.lit(""))


def state_map(text: Column, key: str = STATE_KEY) -> Column:
    """The cache as an ordered map of key to entity, from one parse; null if it is missing or no object, or the text is no JSON.

    A key that repeats keeps its place and takes the last value.
    """
    found = F.from_json(text, f"`{key}` {MAP}").getField(key)
    return F.map_from_entries(F.map_entries(found))


def page_status(html: Column, text: Column, state: Column, key: str = STATE_KEY) -> Column:
    """What became of a page: ok, or why it has no lots. text and state are those of the functions above.

    Only pages that aren't ok are parsed again, to say why.
    """
    raw = F.get_json_object(text, f"$['{key}']")
    closed = F.rtrim(text).rlike(r"[}\]\"\w]$")
    whole = F.try_parse_json(text)
    return (
        F.when((F.size(state) > 0) & F.rtrim(text).endswith("}"), "ok")
        .when(html.isNull(), "fetch_failed")
        .when(html == "", "empty_body")
        .when(text.isNull(), "no_script")
        .when(whole.isNull() | ~closed, "bad_json")
        .when(~F.schema_of_variant(whole).startswith("OBJECT"), "not_object")
        .when(~F.rtrim(text).endswith("}"), "bad_json")  # readers accept text after a complete object
        .when(raw.isNull() | raw.isin("", "0", "false", "[]", "{}"), "empty_state")
        .otherwise("not_object")
    )


def page_errors(status: Column) -> Column:
    return F.when(status.isin("fetch_failed", "bad_json", "not_object"), 1).otherwise(0)


#: What is read of an entity. Extracted at once: null for what is no object, a null field for what doesn't fit.
IDS = "struct<__typename:string,id:variant,itemId:variant,eventItemId:variant>"
FACTS = IDS[:-1] + ",auction:struct<__ref:string>,lotState:struct<__ref:string>>"


def facts(entity: Column, fields: str = FACTS) -> Column:
    return F.try_variant_get(entity, "$", fields)


def is_kind(key: Column, known: Column, kind: str) -> Column:
    """Whether an entity is an object of a kind, by its type name or by its cache key. known: its facts."""
    return known.isNotNull() & (F.coalesce(known["__typename"] == kind, F.lit(False)) | key.startswith(f"{kind}:"))


def _shown(value: Column) -> Column:
    """A value as text, booleans in the stored spelling; null if missing or JSON null."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _set(value: Column) -> Column:
    """A value as text if it isn't empty, zero, false or null. Strings and whole numbers, which ids are, are told first."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    unset = ((kind == "BOOLEAN") & (text == "false")) | (number & (F.try_variant_get(value, "$", "double") == 0)) | text.isin("[]", "{}")
    other = F.when(~unset, F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text))
    return F.when(kind.isin("STRING", "BIGINT"), F.when(text != F.when(kind == "STRING", "").otherwise("0"), text)).otherwise(other)


def item_id(known: Column) -> Column:
    """The lot's id: the first of id, itemId, eventItemId that is set; for a typed lot with an unset id, lot-<id>; else null."""
    typed = known["__typename"] == "Lot"
    fallback = F.when(typed & known["id"].isNotNull(), F.concat(F.lit("lot-"), F.coalesce(_shown(known["id"]), F.lit("None"))))
    return F.coalesce(*[_set(known[f]) for f in ("id", "itemId", "eventItemId")], fallback)


def auction_index(entries: Column) -> Column:
    """Places in the state of the auctions among entries (pos, key, facts), by cache key and by the alias Auction:<id>; later entries win."""

    def names(entry: Column) -> Column:
        own = F.when(entry["key"].startswith("Auction:"), F.replace(entry["key"], F.lit("Auction:"), F.lit(""))).otherwise(F.coalesce(_shown(entry["facts"]["id"]), F.lit("None")))
        return F.array(F.struct(entry["key"].alias("key"), entry["pos"].alias("pos")), F.struct(F.concat(F.lit("Auction:"), own).alias("key"), entry["pos"].alias("pos")))

    auctions = F.filter(entries, lambda e: is_kind(e["key"], e["facts"], "Auction"))
    return F.map_from_entries(F.flatten(F.transform(auctions, names)))


def hashes(keys: Column) -> Column:
    """Hash by hash, what place() looks a key up by."""
    return F.transform(keys, lambda k: F.xxhash64(k))


def hash_place(hashed: Column, key: Column) -> Column:
    """Place from 1 of a key's hash among hashes(), 0 if it isn't there. Numbers are compared, which takes a fraction of what texts take."""
    return F.array_position(hashed, F.xxhash64(key))


def place(keys: Column, at: Column, key: Column) -> Column:
    """Place from 0 of a key among distinct keys; null if it isn't there. at: its hash_place(); if another key has that hash, all texts are compared."""
    exact = F.when(F.get(keys, at.cast("int") - 1) == key, at).otherwise(F.array_position(keys, key))
    return F.when(at > 0, F.nullif(exact, F.lit(0)).cast("int") - 1)


def own_fields(lot: Column) -> Column:
    return F.try_variant_get(lot, "$", MAP)


def reference_place(keys: Column, name: str, ref: Column) -> Column:
    """Place from 1 of the field with a reference among a lot's keys; 0 if there is no reference."""
    return F.when(ref.isNotNull(), F.array_position(keys, F.lit(name))).otherwise(0).cast("int")


def without(array: Column, at: Column) -> Column:
    """An array without the element at a place from 1; all of it for 0."""
    return F.when(at > 0, F.concat(F.slice(array, F.lit(1), at - 1), F.slice(array, at + 1, F.size(array)))).otherwise(array)


def enriched(keys: Column, values: Column, has_auction: Column, auction: Column, auction_ref: Column, has_state: Column, lot_state: Column, state_ref: Column) -> Column:
    """The payload text: a lot's keys and values without its references, then what they lead to and the references themselves."""
    for key, value, there in (
        ("auction_data", auction, has_auction),
        ("lot_state_data", lot_state, has_state),
        ("auction_ref", auction_ref.cast("variant"), auction_ref.isNotNull()),
        ("lot_state_ref", state_ref.cast("variant"), state_ref.isNotNull()),
    ):
        more = lambda x, there=there: F.slice(F.array(x), F.lit(1), F.when(there, 1).otherwise(0))
        keys, values = F.concat(keys, more(F.lit(key))), F.concat(values, more(value))
    return F.to_json(F.map_from_arrays(keys, values))
