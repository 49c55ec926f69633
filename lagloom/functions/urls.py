"""Scalar functions on URLs: where they lead, what they carry, ad-bypass parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# What tells the two kinds of stream apart.
HLS_URLS = [r"\.m3u8$", r"/playlist\.m3u8", r"/master\.m3u8", r"/index\.m3u8"]
HLS_TYPES = ["application/vnd.apple.mpegurl", "application/x-mpegurl", "vnd.apple.mpegurl"]
ICECAST_URLS = [r"\.mp3$", r"\.aac$", r"\.ogg$", r"/stream$", r"/listen$", r"/audio$", r"/radio$", r":8000/", r":8080/"]
ICECAST_TYPES = ["audio/mpeg", "audio/mp3", "audio/aac", "audio/ogg", "application/ogg"]
ICECAST_PORTS = ["8000", "8080", "8443", "9000"]


def is_local(url: Column) -> Column:
    """Whether it names a file: anything but http:// and https://."""
    return ~(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")))


def local_path(url: Column) -> Column:
    return F.regexp_replace(url, "^file://", "")


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def stream_type(url: Column, hls: Sequence[str] = tuple(HLS_URLS), icecast: Sequence[str] = tuple(ICECAST_URLS)) -> Column:
    """hls or icecast by the patterns of the URL without its query, hls first; null if none fits."""
    bare = F.lower(F.regexp_replace(url, r"[?#][\s\S]*$", ""))
    return F.when(matches_any(bare, hls), "hls").when(matches_any(bare, icecast), "icecast")


def stream_type_of_content(content_type: Column) -> Column:
    """hls or icecast by a Content-Type header, whatever its case and parameters."""
    bare = F.lower(F.trim(F.regexp_extract(content_type, r"^[^;]*", 0)))
    return F.when(bare.isin(HLS_TYPES), "hls").when(bare.isin(ICECAST_TYPES), "icecast")


def truncated(url: Column, length: int) -> Column:
    """url, or its start and ... if it has over length bytes; ASCII is cut at the byte, as are other texts at the character."""
    return F.when(F.octet_length(url) <= length, url).otherwise(F.concat(F.substring(url, 1, length - 3), F.lit("...")))


def host_of(url: Column) -> Column:
    """Host and port, without user and password."""
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), r"^.*@", "")


def path_of(url: Column) -> Column:
    """The path with its percent signs decoded; as it stands if they are broken."""
    raw = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    # A plus stands for itself in a path.
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def file_name(url: Column) -> Column:
    """A name for a file made from host and path, audio if both are empty."""
    name = F.regexp_replace(F.concat(host_of(url), path_of(url)), r"[/:?&=]", "_")
    return F.when(name == "", "audio").otherwise(name)


@dataclass
class BypassRule:
    """Query parameters for URLs whose host holds one of hosts and whose path one of paths; none given, any will do."""

    hosts: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    parameters: dict[str, str] = field(default_factory=dict)

    def fits(self, url: Column) -> Column:
        def one(text: Column, parts: list[str]) -> Column:
            return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p)) if parts else F.lit(True)

        return one(host_of(url), self.hosts) & one(path_of(url), self.paths)


def _escape(text: Column) -> Column:
    """Query escaping that keeps ~ and escapes *."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def with_bypass(url: Column, rules: Sequence[BypassRule]) -> Column:
    """url with the parameters of all rules that fit, a later rule overriding an earlier one.

    If one sets a parameter, the whole query is written anew, sorted by key, values of a repeated
    key in their order. Otherwise, and if the URL can't be parsed, it stays as it is.
    """
    rules = [r for r in rules if r.parameters]
    if not rules:
        return url
    pair = "struct<k: string, v: string>"
    none = F.array().cast(f"array<{pair}>")

    def pairs(parameters: dict[str, str]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in parameters.items()])

    def set_all(query: Column, parameters: dict[str, str]) -> Column:
        return F.concat(F.filter(query, lambda p: ~p["k"].isin(list(parameters))), pairs(parameters))

    raw = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    given = F.transform(
        F.filter(F.split(raw, "&"), lambda p: p != ""),
        lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, r"=([\s\S]*)$", 1)).otherwise("")).alias("v")),
    )
    query, changed = given, F.lit(False)
    for rule in rules:
        fits = rule.fits(url)
        changed = changed | fits
        query = F.when(fits, set_all(query, rule.parameters)).otherwise(query)
    # A stable sort by key: equal keys keep their places.
    placed = F.transform(F.coalesce(query, none), lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    written = F.array_join(F.transform(F.array_sort(placed), lambda p: F.concat(_escape(p["k"]), F.lit("="), _escape(p["v"]))), "&")
    base, fragment = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"#[\s\S]*$", 0)
    return F.when(changed & F.try_parse_url(url, F.lit("PATH")).isNotNull(), F.concat(base, F.lit("?"), written, fragment)).otherwise(url)


def with_suffix(url: Column, parameters: str) -> Column:
    """url and a ready query string, joined by ? or &."""
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(parameters))
