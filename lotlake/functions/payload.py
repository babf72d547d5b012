"""Columns over the stored payload text: fields, predicates, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotlake.schemas import PAYLOAD


def field(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, f"$.{path}")


def fields(raw: Column) -> Column:
    """All promoted fields in one parse."""
    return F.from_json(raw, PAYLOAD)


def contains_text(raw: Column, term: str) -> Column:
    """Case-insensitive search of the whole payload; % and _ in the term are wildcards, as it is pasted in unescaped."""
    escape = next(c for c in "\\!#~^|`\x01\x02\x03" if c not in term)
    return F.ilike(raw, F.lit(f"%{term}%"), F.lit(escape))


def field_like(raw: Column, path: str, pattern: str) -> Column:
    return field(raw, path).ilike(pattern)


def is_true(raw: Column, path: str) -> Column:
    """The field is JSON true or the number 1 (true extracts as 1); text never counts."""
    value = F.try_variant_get(F.try_parse_json(raw), f"$.{path}", "variant")
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(((kind == "BOOLEAN") & F.try_variant_get(value, "$", "boolean")) | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (number == 1)), F.lit(False))


def contains(raw: Column, pattern: dict[str, str | int | float | bool | None]) -> Column:
    """JSON containment of a flat object: every key is there with an equal scalar of the same type."""
    found = F.lit(True)
    doc = F.try_parse_json(raw)
    for key, want in pattern.items():
        value = F.try_variant_get(doc, f'$["{key}"]', "variant")
        kind = F.schema_of_variant(value)
        if want is None:
            same = F.is_variant_null(value)
        elif isinstance(want, bool):
            same = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == want)
        elif isinstance(want, str):
            same = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == want)
        else:
            same = kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.try_variant_get(value, "$", "double") == float(want))
        found = found & F.coalesce(same, F.lit(False))
    return found


# Display defaults and lengths: fixed values.


def title(lead: Column, size: int) -> Column:
    return F.left(F.coalesce(lead, F.lit("No title")), F.lit(size))


def event(name: Column) -> Column:
    return F.left(F.coalesce(name, F.lit("Unknown")), F.lit(30))


def location(city: Column, state: Column) -> Column:
    return F.concat(F.coalesce(city, F.lit("")), F.lit(", "), F.coalesce(state, F.lit("")))


def category_label(category: Column) -> Column:
    return F.coalesce(F.nullif(category, F.lit("")), F.lit("all"))


def iso_seconds(ts: Column) -> Column:
    """The first 19 characters of the ISO form; N/A for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("N/A"))


def stored_time(text: Column) -> Column:
    """A stored time as a timestamp: ISO text with T or a blank between date and time, with or without a fraction; null if it is neither."""
    return F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def category_list(text: Column, keep_empty: bool = False) -> Column:
    """A comma-separated list, trimmed; empty entries only stay in the command-line form (keep_empty)."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return parts if keep_empty else F.filter(parts, lambda x: x != "")
