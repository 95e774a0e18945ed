"""Typed access to an event's JSON payload; a key is a payload key or, if there is one, a column."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _variant(key: str, data: str) -> Column:
    path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return F.try_variant_get(F.try_parse_json(data), path, "variant")


def value(df: DataFrame, key: str, data: str = "data") -> Column:
    """The value of a key as canonical JSON text, so that equal values are equal texts; null if missing."""
    return F.to_json(F.col(f"`{key}`").cast("variant")) if key in df.columns else F.to_json(_variant(key, data))


def canonical(data: Column | str = "data") -> Column:
    """A JSON text without white space and escapes that it doesn't need, keys sorted; what doesn't parse stays as it is."""
    own = F.col(data) if isinstance(data, str) else data
    return F.coalesce(F.to_json(F.try_parse_json(own)), own)


def is_any(df: DataFrame, key: str, values: list, data: str = "data") -> Column:
    """Whether the key has one of the Python values; null if it is missing.

    Numbers compare by value, whatever their notation (1, 1.0 and 1e0 are one number; a truth value is
    none); all else, numbers inside lists and objects included, by canonical text.
    """
    own = F.col(f"`{key}`").cast("variant") if key in df.columns else _variant(key, data)
    plain = [v for v in values if isinstance(v, int | float) and not isinstance(v, bool) and abs(v) <= 1 << 53]
    number = F.when(F.schema_of_variant(own).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(own, "$", "double"))
    others = [literal(v) for v in values if not any(v is p for p in plain)]
    return F.when(own.isNotNull(), F.coalesce(number.isin([float(v) for v in plain]), F.lit(False)) | F.to_json(own).isin(others))


def parsed_once(of: Callable[[Column], Column], data: str = "data") -> Column:
    """What ``of`` makes of the parsed data; they are parsed once, however often it uses them."""
    return F.get(F.transform(F.array(F.try_parse_json(data)), of), F.lit(0))


def is_object(v: Column) -> Column:
    """Whether a parsed value is a JSON object; false for what doesn't parse."""
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def text_at(v: Column, field: str) -> Column:
    """The string at a dotted path of keys of a parsed value, null if there is none."""
    path = "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in field.split("."))
    own = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string"))


def path_text(field: str, data: str = "data") -> Column:
    """The string at a dotted path of keys, null if there is none."""
    return parsed_once(lambda v: text_at(v, field), data)


def with_path(object_text: Column, field: str, new: str) -> Column:
    """The JSON object with the string ``new`` at a dotted path, as canonical text; the path's objects must be there."""
    key, _, rest = field.partition(".")
    entries = F.from_json(object_text, "map<string,variant>")
    inner = F.parse_json(F.lit(literal(new))) if not rest else F.parse_json(with_path(F.to_json(F.element_at(entries, F.lit(key))), rest, new))
    return canonical(F.to_json(F.transform_values(entries, lambda k, v: F.when(k == key, inner).otherwise(v))))


def literal(x) -> str:
    """A Python value as the text that ``value`` gives for it."""
    if isinstance(x, float) and x.is_integer():
        x = int(x)
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def text(df: DataFrame, key: str, data: str = "data") -> Column:
    """The value of a key if it is a string, else null."""
    if key in df.columns:
        return F.col(f"`{key}`").cast("string")
    own = _variant(key, data)
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string"))


def strings(data: str = "data") -> Column:
    """The top-level string values by key; null if the text is no JSON object. To be a column, so that it is parsed once."""
    entries = F.from_json(F.col(data), "map<string,variant>")
    return F.map_filter(F.transform_values(entries, lambda k, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda k, v: v.isNotNull())
