"""Filters, rollups and order on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload
from ..functions.patterns import Rule, java


def duration() -> Column:
    return F.col("end_ns") - F.col("start_ns")


def filter_keyvals(events: DataFrame, key: str, values: list) -> DataFrame:
    """Events that have the key with one of the values."""
    return events.where(payload.is_any(events, key, values))


def exclude_keyvals(events: DataFrame, key: str, values: list) -> DataFrame:
    """Events but those that ``filter_keyvals`` keeps; events without the key stay."""
    return events.where(~F.coalesce(payload.is_any(events, key, values), F.lit(False)))


def filter_regex(events: DataFrame, key: str, pattern: str) -> DataFrame:
    """Events whose value of the key is a string in which the pattern is found."""
    Rule(pattern)  # fails on a bad pattern
    return events.where(payload.text(events, key).rlike(java(pattern)))


def categorize(events: DataFrame, classes: list[tuple[list[str], Rule]]) -> DataFrame:
    """Add ``category``: the deepest category with a matching rule, the last of equally deep ones, else Uncategorized.

    An empty category never wins.
    """
    ranked = sorted(((len(c), k, c, r) for k, (c, r) in enumerate(classes) if c), key=lambda x: (-x[0], -x[1]))
    parsed, out = events.withColumn("_strings", payload.strings()), None
    for _, _, category, rule in ranked:
        names, hit = F.array(*map(F.lit, category)), rule.matches(events, F.col("_strings"))
        out = F.when(hit, names) if out is None else out.when(hit, names)
    other = F.array(F.lit("Uncategorized"))
    return parsed.withColumn("category", other if out is None else out.otherwise(other)).drop("_strings")


def tag(events: DataFrame, tags: list[tuple[str, Rule]]) -> DataFrame:
    """Add ``tags``: the tags with a matching rule, sorted and once each."""
    if not tags:
        return events.withColumn("tags", F.array().cast("array<string>"))
    found = F.array(*(F.when(rule.matches(events, F.col("_strings")), F.lit(name)) for name, rule in tags))
    return events.withColumn("_strings", payload.strings()).withColumn("tags", F.array_sort(F.array_distinct(F.array_compact(found)))).drop("_strings")


def split_url(df: DataFrame, url: Column) -> DataFrame:
    """Add protocol, domain (without leading ``www.``), path and params; all null if it is no URL.

    Blanks around a URL go, blanks in it count as ``%20``, and the case of scheme and host doesn't matter.
    """
    url = F.regexp_replace(F.btrim(F.regexp_replace(url, "[\\t\\n\\r]", "")), " ", "%20")
    url = F.concat(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*:", 0)), F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*:", ""))
    part = lambda p: F.try_parse_url(url, F.lit(p))
    opaque = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*:([^?#]*)", 1)
    scheme, host = F.lower(part("PROTOCOL")), F.lower(part("HOST"))
    known = scheme.isNotNull()
    path = F.coalesce(F.when(part("PATH") != "", part("PATH")), F.when(host.isNotNull(), F.lit("/")), opaque)
    return df.withColumns({
        "protocol": scheme,
        "domain": F.when(known, F.coalesce(F.regexp_replace(host, r"^(www\.)+", ""), scheme)),
        "path": F.when(known, path),
        "params": F.when(known, F.coalesce(part("QUERY"), F.lit(""))),
    })


def merge_by_keys(events: DataFrame, keys: list[str], within: tuple[str, ...] = ("bucket",), keep: tuple[str, ...] = ()) -> DataFrame:
    """One event for each combination of the keys' values: durations add up; start, data and ``keep`` are the first event's.

    Events that lack a key are left out; no keys give no events. The values are columns key_0, key_1 ...
    """
    if not keys:
        return events.limit(0)
    named = {f"key_{k}": payload.value(events, key) for k, key in enumerate(keys)}
    df = events.withColumns(named).where(F.forall(F.array(*named), lambda x: x.isNotNull()))
    first = F.min_by(F.struct("start_ns", "data", *keep), F.struct("start_ns", "id"))
    out = df.groupBy(*within, *named).agg(first.alias("f"), F.sum(duration()).alias("ns"))
    return out.select(*within, *named, F.lit(None).cast("long").alias("id"), "f.start_ns", (F.col("f.start_ns") + F.col("ns")).alias("end_ns"), "f.data", *(f"f.{c}" for c in keep))


def longest(events: DataFrame, n: int) -> DataFrame:
    """The n longest events; the earlier first among equals."""
    return events.orderBy(duration().desc(), "start_ns", "id").limit(max(0, int(n)))


def earliest(events: DataFrame, n: int) -> DataFrame:
    """The n first events by start."""
    return events.orderBy("start_ns", "id").limit(max(0, int(n)))


def sum_durations(events: DataFrame, *by: str) -> DataFrame:
    """``duration_ms``: the sum of durations in whole milliseconds, 0 for none."""
    return events.groupBy(*by).agg(F.coalesce(F.expr("sum(end_ns - start_ns) div 1000000"), F.lit(0)).cast("long").alias("duration_ms"))


def concat(*frames: DataFrame) -> DataFrame:
    """All events of all frames, with ``part`` as the frame's place."""
    out = [f.withColumn("part", F.lit(k)) for k, f in enumerate(frames)]
    whole = out[0]
    for f in out[1:]:
        whole = whole.unionByName(f)
    return whole
