"""Column helpers for semi-structured payloads held as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_payload(raw: Column) -> Column:
    """Tolerant parse: bad JSON gives null, and every path below null is null."""
    return F.try_parse_json(raw)


def node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """Type word of the value at ``path``: STRING, BIGINT, OBJECT..., ARRAY..., VOID or null."""
    return F.schema_of_variant(node(v, path))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "map<string,variant>").isNotNull(), F.lit(False))


def text(v: Column, path: str) -> Column:
    """Text form of a scalar, or the JSON text of a nested value (like ``->>``)."""
    return F.try_variant_get(v, path, "string")


def _spaced(json: Column) -> Column:
    """Compact JSON text with a blank after each colon and comma outside of strings."""
    pieces = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*+"|[,:]|[^",:]++'), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.isin(",", ":"), F.concat(p, F.lit(" "))).otherwise(p)), "")


def _member_text(v: Column, depth: int) -> Column:
    """JSON text of a value: members of objects by length of the key in bytes, then by key, down to ``depth`` levels."""
    if depth == 0:
        return _spaced(F.to_json(v))
    members = F.try_variant_get(v, "$", "map<string,variant>")
    items = F.try_variant_get(v, "$", "array<variant>")
    keys = F.array_sort(F.transform(F.map_keys(members), lambda k: F.struct(F.octet_length(k).alias("size"), k.alias("key"))))

    def pair(k: Column) -> Column:
        name = F.to_json(F.array(k["key"]))
        name = F.substr(name, F.lit(2), F.length(name) - 2)
        return F.concat(name, F.lit(": "), _member_text(F.element_at(members, k["key"]), depth - 1))

    def listed(opened: str, texts: Column, closed: str) -> Column:
        return F.concat(F.lit(opened), F.array_join(texts, ", "), F.lit(closed))

    return (
        F.when(members.isNotNull(), listed("{", F.transform(keys, pair), "}"))
        .when(items.isNotNull(), listed("[", F.transform(items, lambda x: _member_text(x, depth - 1)), "]"))
        .otherwise(_spaced(F.to_json(v)))
    )


def stored_text(v: Column, path: str) -> Column:
    """Text as the tracker's database gives it (``->>``): strings bare, objects and lists with blanks after colons and commas.

    Keys are in the database's order on the two outer levels; deeper objects keep the order of the variant.
    """
    nested = kind(v, path).startswith("OBJECT") | kind(v, path).startswith("ARRAY")
    return F.when(nested, _member_text(node(v, path), 2)).otherwise(text(v, path))


def string_only(v: Column, path: str) -> Column:
    """The value only where it is a JSON string."""
    return F.when(kind(v, path) == "STRING", text(v, path))


def integer_only(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def truthy(v: Column, path: str) -> Column:
    """Text of the value unless it is empty, zero, false or missing."""
    value = text(v, path)
    zero = F.coalesce(value.try_cast("double") == 0.0, F.lit(False))
    empty = (value == "") | ((kind(v, path) != "STRING") & (value.isin("false", "{}", "[]") | zero))
    return F.when(~empty, value)


def scalar_text(v: Column, path: str) -> Column:
    """Text of a number or string, null for booleans and nested values."""
    t = kind(v, path)
    numeric_or_text = t.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    return F.when(numeric_or_text, text(v, path))


def objects_or_scalars(v: Column, path: str) -> Column:
    """The JSON array at ``path`` as an array of variants; null when it is no list."""
    return F.try_variant_get(v, path, "array<variant>")
