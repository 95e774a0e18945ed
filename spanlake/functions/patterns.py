"""Regex rules as column expressions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern of the Perl kind for Java: Unicode classes and case, ``$`` only at the very end, named groups."""
    pattern = pattern.replace("(?P<", "(?<")
    pattern = re.sub(r"(\\.|\[(?:\\.|[^\]\\])*\])|\$", lambda m: m[1] or r"\z", pattern)
    return f"(?dU{'iu' if ignore_case else ''}){pattern}"


@dataclass(frozen=True)
class Rule:
    """Matches if the pattern is found in a string value: of ``keys`` if given, else of any key.

    A rule without a pattern matches nothing.
    """

    regex: str | None = None
    ignore_case: bool = False
    keys: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.keys is not None and not self.keys:
            raise ValueError("keys must name one key at least")
        if self.regex is not None:
            re.compile(self.regex)

    def matches(self, df: DataFrame, strings: Column) -> Column:
        """Whether the rule holds for a row; ``strings`` is the column ``payload.strings``."""
        if not self.regex:
            return F.lit(False)
        found = lambda c: F.coalesce(c.rlike(java(self.regex, self.ignore_case)), F.lit(False))
        if self.keys is None:
            return F.coalesce(F.exists(F.map_values(strings), found), F.lit(False))
        out = F.lit(False)
        for key in self.keys:
            out = out | found(F.col(f"`{key}`").cast("string") if key in df.columns else F.try_element_at(strings, F.lit(key)))
        return out


def rule(spec: dict) -> Rule:
    """A rule of a dict: type (``none`` or ``regex``), regex, and maybe ignore_case and select_keys; ValueError if it is none.

    re.error says that the regex is bad.
    """
    kind, keys = spec.get("type"), spec.get("select_keys")
    if kind == "none":
        return Rule()
    if kind != "regex" or not isinstance(spec.get("regex"), str) or not isinstance(spec.get("ignore_case", False), bool):
        raise ValueError(f"no rule: {spec}")
    if keys is not None and not (isinstance(keys, list) and all(isinstance(k, str) for k in keys)):
        raise ValueError(f"select_keys must be a list of strings: {spec}")
    return Rule(spec["regex"], spec.get("ignore_case", False), None if keys is None else tuple(keys))


def read_classes(text: str) -> list[tuple[list[str], Rule]]:
    """Classes of the JSON text ``[[["A", "B"], {"type": "regex", ...}], ...]``."""
    return [(list(names), rule(spec)) for names, spec in json.loads(text)]


def write_classes(classes: list[tuple[list[str], Rule]]) -> str:
    """The JSON text of classes, which ``read_classes`` reads."""
    out = []
    for names, r in classes:
        spec = {"type": "none"} if not r.regex else {"type": "regex", "regex": r.regex}
        out.append([names, spec | {"ignore_case": r.ignore_case} | ({} if r.keys is None else {"select_keys": list(r.keys)})])
    return json.dumps(out, ensure_ascii=False)


#: The default categories and their patterns.
DEFAULT_CATEGORIES = [
    (["Work"], Rule("Google Docs|libreoffice|ReText")),
    (["Work", "Programming"], Rule("GitHub|Stack Overflow|BitBucket|Gitlab|vim|Spyder|kate|Ghidra|Scite")),
    (["Work", "Image"], Rule("Gimp|Inkscape")),
    (["Work", "Video"], Rule("Kdenlive")),
    (["Work", "Audio"], Rule("Audacity")),
    (["Work", "3D"], Rule("Blender")),
    (["Media", "Games"], Rule("Minecraft|RimWorld")),
    (["Media", "Video"], Rule("YouTube|Plex|VLC")),
    (["Media", "Social Media"], Rule("reddit|Facebook|Twitter|Instagram|devRant", True)),
    (["Media", "Music"], Rule("Spotify|Deezer", True)),
    (["Comms", "IM"], Rule("Messenger|Telegram|Signal|WhatsApp|Rambox|Slack|Riot|Discord|Nheko")),
    (["Comms", "Email"], Rule("Gmail|Thunderbird|mutt|alpine")),
]

#: The window names of each browser.
BROWSERS = {
    "chrome": ["Google Chrome", "Google-chrome", "chrome.exe", "google-chrome-stable", "Chromium", "Chromium-browser", "Chromium-browser-chromium", "chromium.exe", "Google-chrome-beta", "Google-chrome-unstable", "Brave-browser"],
    "firefox": ["Firefox", "Firefox.exe", "firefox", "firefox.exe", "Firefox Developer Edition", "firefoxdeveloperedition", "Firefox-esr", "Firefox Beta", "Nightly", "org.mozilla.firefox"],
    "opera": ["opera.exe", "Opera"],
    "brave": ["brave.exe"],
    "edge": ["msedge.exe", "Microsoft Edge"],
    "vivaldi": ["Vivaldi-stable", "Vivaldi-snapshot", "vivaldi.exe"],
}
