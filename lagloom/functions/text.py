"""Scalar functions on text columns: error classes, names, titles, keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The error classes, tried in this order, and the words that put a message in one (case matters).
ERROR_CLASSES = [
    ("network", ["timeout", "connection", "network", "dns"]),
    ("format", ["decode", "format", "codec", "audio"]),
    ("http", ["404", "403", "500", "http"]),
    ("processing", ["fingerprint", "alignment", "processing"]),
    ("configuration", ["config", "validation", "invalid"]),
]

CONTENT_TYPES = ["music", "news", "talk", "sports", "mixed"]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether text holds one of the words, case counting; false for no words."""
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def error_class(message: Column) -> Column:
    """The class of an error message, `none` for null and `other` if no class has a word of it."""
    found = F.when(message.isNull(), "none")
    for name, words in ERROR_CLASSES:
        found = found.when(contains_any(message, words), name)
    return found.otherwise("other")


def content_type(text: Column) -> Column:
    """One of the known content types in lower case; anything else is news."""
    low = F.lower(text)
    return F.when(low.isin(CONTENT_TYPES), low).otherwise("news")


def category(title: Column) -> Column:
    """What follows the first `CATEGORY:` up to a comma or the end, perhaps empty; null without one."""
    return F.when(F.contains(title, F.lit("CATEGORY:")), F.regexp_extract(title, r"CATEGORY:([^,]*)", 1))


def has_ad_break(title: Column) -> Column:
    return F.coalesce(F.contains(title, F.lit("AD_BREAK")), F.lit(False))


def icy_title(title: Column) -> Column:
    """struct(artist, title) of an `artist - title` line; without a dash there is no artist."""
    parts = F.split(title, " - ", 2)
    return F.struct(F.when(F.size(parts) > 1, F.trim(parts[0])).alias("artist"), F.trim(F.element_at(parts, -1)).alias("title"))


def pair_name(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit("_vs_"), right)


def fingerprint_name(pair: Column) -> Column:
    return F.concat(pair, F.lit("_fingerprint"))


def measurement_key(group: Column, broadcast: Column) -> Column:
    return F.concat_ws("_", group, broadcast)


def split_key(key: Column) -> Column:
    """struct(group, broadcast) of a measurement key, cut at the first underscore; null without one."""
    found = F.regexp_extract(key, r"^([^_]*)_(?s)(.*)$", 1), F.regexp_extract(key, r"^([^_]*)_(?s)(.*)$", 2)
    return F.when(F.contains(key, F.lit("_")), F.struct(found[0].alias("group"), found[1].alias("broadcast")))


def display_name(name: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), fallback)


def event_title(name: Column) -> Column:
    """`stream_detection` as `Stream Detection`."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def playlist_kind(is_master: Column, is_live: Column) -> Column:
    return F.when(is_master, "Master Playlist").when(is_live, "Live Media Playlist").otherwise("VOD Media Playlist")


def pass_label(passed: Column) -> Column:
    return F.when(passed, "PASS").otherwise("FAIL")


def health_label(healthy: Column) -> Column:
    return F.when(healthy, "Healthy").otherwise("Unhealthy")


def setting_key(name: str) -> str:
    """The environment form of a setting or flag name."""
    return name.replace("-", "_").replace(".", "_").upper()


# Response headers that a short report shows; some carry the name of the service that sends them.
SHOWN_HEADERS = ["content-type", "server", "x-cache", "via", "is_live", "is_master", "content_categories", "has_ad_breaks", "discontinuity_sequence", "start_time_offset"]


def shown_headers(headers: Column, verbose: bool = False, service: str | None = None) -> Column:
    """The headers (map) that a report shows: all if verbose, else the fixed ones and, for a service, its playlist durations."""
    if verbose:
        return headers
    names = SHOWN_HEADERS + ([f"x-{service}-playlist-available-duration", f"{service}_available_duration"] if service else [])
    return F.map_filter(headers, lambda k, _: k.isin(names))
