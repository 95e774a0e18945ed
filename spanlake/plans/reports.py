"""Ready-made activity reports: lazy frames, composed of the operators."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload
from ..functions.patterns import BROWSERS, DEFAULT_CATEGORIES, Rule
from ..operators import intervals, rows
from ..operators.folds import no_cuts
from ..scratch import written

#: Rows of a report's lists.
TOP = 100
#: What a desktop report is made of: what needs the events, the user's activity and the tabs.
OF_EVENTS = ("events", "title_events", "app_events", "cat_events", "duration")
OF_ACTIVITY = ("active_events",)
OF_TABS = ("browser_urls", "browser_domains", "browser_duration")


def active_periods(afk: DataFrame, window: DataFrame | None = None, always_active: str | None = None, audible: DataFrame | None = None, span: int | None = None) -> DataFrame:
    """When the user was at work: status not-afk, or an always-active app or title, or an audible tab."""
    active = rows.filter_keyvals(intervals.flood(afk, span=span), "status", ["not-afk"])
    parts = [active]
    if always_active and window is not None:
        parts += [rows.filter_regex(window, key, always_active) for key in ("app", "title")]
    if audible is not None:
        parts.append(rows.filter_keyvals(audible, "audible", [True]))
    return intervals.period_union(*parts, span=span)


def browser_events(window: DataFrame, browsers: dict[str, DataFrame], span: int | None = None) -> DataFrame | None:
    """Tab events of each browser while one of its windows was in front, with the URL's parts as columns."""
    out = None
    for name, tabs in browsers.items():
        front = rows.filter_keyvals(window, "app", BROWSERS[name])
        flooded = intervals.flood(tabs, span=span)
        # Rows of large buckets are counted and joined: two jobs, but one fold.
        own = intervals.period_intersect(flooded if span == 0 else written(flooded), front, span=span)
        out = own if out is None else out.unionByName(own)
    return None if out is None else rows.split_url(out, payload.text(out, "url"))


def canonical_events(window: DataFrame, active: DataFrame | None = None, classes: list[tuple[list[str], Rule]] = DEFAULT_CATEGORIES, only: list[list[str]] | None = None, span: int | None = None) -> DataFrame:
    """Flooded window events, cut to the active periods (united ones), categorised, and of the categories ``only`` if given."""
    out = window if active is None else intervals.period_intersect(window, active, united=True, span=span)
    out = rows.categorize(out, classes)
    return out.where(F.to_json("category").isin([payload.literal(c) for c in only])) if only else out


def desktop_report(window: DataFrame, afk: DataFrame | None = None, browsers: dict[str, DataFrame] | None = None, classes: list[tuple[list[str], Rule]] = DEFAULT_CATEGORIES, always_active: str | None = None, only: list[list[str]] | None = None, top: int = TOP, names: Collection[str] | None = None) -> dict[str, DataFrame]:
    """Rollups by title, app, category, URL and domain, and durations, of one bucket a side.

    All frames must carry the same bucket name, which stands for the user or device. Window events are flooded
    once, and what several rollups read is written once. With ``names`` only these are given, and no job runs for others.
    """
    unknown = set(names or ()) - {*OF_EVENTS, *OF_ACTIVITY, *OF_TABS}
    if unknown:
        raise ValueError(f"no parts of a report: {sorted(unknown)}")
    asks = lambda of: names is None or any(n in names for n in of)
    afk = afk if asks(OF_EVENTS + OF_ACTIVITY) else None
    browsers = browsers if afk is not None or asks(OF_TABS) else None
    # What is made of the frames has hardly more rows a bucket than they have together.
    span = no_cuts(window, *([] if afk is None else [afk]), *(browsers or {}).values())
    flooded = written(intervals.flood(window, span=span))
    tabs = browser_events(flooded, browsers, span) if browsers else None
    tabs = None if tabs is None else written(tabs)
    active = None if afk is None else written(active_periods(afk, flooded, always_active, tabs, span))
    out = {}
    if asks(OF_EVENTS):
        events = canonical_events(flooded, active, classes, only, span)
        out = {
            "events": events,
            "title_events": rows.longest(rows.merge_by_keys(events, ["app", "title"]), top),
            "app_events": rows.longest(rows.merge_by_keys(events, ["app"]), top),
            "cat_events": rows.longest(rows.merge_by_keys(events, ["category"]), top),
            "duration": rows.sum_durations(events),
        }
    if active is not None:
        out["active_events"] = active
    if tabs is not None:
        out |= {"browser_urls": rows.longest(rows.merge_by_keys(tabs, ["url"]), top), "browser_domains": rows.longest(rows.merge_by_keys(tabs, ["domain"]), top), "browser_duration": rows.sum_durations(tabs)}
    return {name: df for name, df in out.items() if names is None or name in names}


def mobile_report(apps: DataFrame, classes: list[tuple[list[str], Rule]] = DEFAULT_CATEGORIES, top: int = TOP) -> dict[str, DataFrame]:
    """Rollups by app and category of a phone's app events."""
    by_app = rows.categorize(rows.merge_by_keys(intervals.flood(apps), ["app"]), classes)
    return {"events": by_app, "cat_events": rows.longest(rows.merge_by_keys(by_app.drop("key_0"), ["category"]), top), "duration": rows.sum_durations(by_app)}
