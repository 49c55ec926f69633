"""Checks of protocols as rules: rows of name, severity and what breaks them, compiled to one aggregation.

A rule's `broken` is an aggregate, as SQL, over the rows of a subject (the segments of a playlist, the polls or blocks of
sound of a stream); `found` is the number it tells. All rules of a set are aggregated together, in one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.sources import playlists as m3u8

# What a broken rule of each severity takes off a health of 100.
SEVERITIES = {"error": 40, "warning": 15, "info": 0}


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    broken: str
    found: str = "0"

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"rule {self.name}: no severity {self.severity!r}, there are {', '.join(SEVERITIES)}")


#: Segments of a media playlist beside what the playlist says; see playlist_rows().
PLAYLIST_RULES = [
    Rule("no_header", "error", "bool_or(NOT is_valid)"),
    Rule("no_segments", "error", "bool_or(NOT is_master) AND count(uri) = 0"),
    Rule("no_target_duration", "error", "bool_or(NOT is_master) AND count(target_duration) = 0"),
    Rule("over_target_duration", "error", "max(round(duration)) > max(target_duration)", "count_if(round(duration) > target_duration)"),
    Rule("no_duration", "warning", "count_if(duration <= 0) > 0", "count_if(duration <= 0)"),
    Rule("repeated_segment", "warning", "count(DISTINCT uri) < count(uri)", "count(uri) - count(DISTINCT uri)"),
    Rule("fractions_before_version_3", "warning", "max(version) < 3 AND bool_or(duration <> floor(duration))", "count_if(duration <> floor(duration))"),
    Rule("short_window", "warning", "bool_or(is_live) AND sum(duration) < 3 * max(target_duration)", "sum(duration)"),
    Rule("discontinuities", "info", "count_if(discontinuity) > 0", "count_if(discontinuity)"),
]

#: Polls of a stream, as sources.captures reads them.
STREAM_RULES = [
    Rule("no_content_type", "error", "count_if(coalesce(content_type, '') <> '') = 0"),
    Rule("no_bytes", "error", "coalesce(max(bytes_received), 0) <= 0"),
    Rule("sample_rate_changes", "error", "min(sample_rate) < max(sample_rate)", "max(sample_rate) - min(sample_rate)"),
    Rule("channels_change", "error", "min(channels) < max(channels)", "max(channels) - min(channels)"),
    Rule("bitrate_out_of_band", "warning", "min(bitrate) < 16 OR max(bitrate) > 512", "count_if(bitrate < 16 OR bitrate > 512)"),
    Rule("slow_connection", "warning", "max(connection_ms) > 5000", "max(connection_ms)"),
    Rule("low_buffer", "warning", "min(buffer_health) < 0.3", "count_if(buffer_health < 0.3)"),
    Rule("no_title", "info", "count_if(coalesce(title, '') <> '') = 0"),
]

#: Sound of a stream, in one row or many; see sound_rows().
SOUND_RULES = [
    Rule("no_samples", "error", "sum(samples) = 0"),
    Rule("not_finite", "error", "sum(not_finite) > 0", "sum(not_finite)"),
    Rule("silent", "error", "sum(samples) > 0 AND bool_and(silent)"),
    Rule("rate_changes", "error", "min(sample_rate) < max(sample_rate)", "max(sample_rate) - min(sample_rate)"),
    Rule("no_rate", "error", "coalesce(max(sample_rate), 0) <= 0"),
    Rule("often_silent", "warning", "NOT bool_and(silent) AND 2 * count_if(silent) > count(*)", "count_if(silent)"),
    Rule("clipped", "warning", "100 * sum(clipped) > sum(samples)", "sum(clipped)"),
]


def from_rows(rows: Iterable[Mapping]) -> list[Rule]:
    """Rules from mappings with name, severity, broken and, if wanted, found, as a settings file has them; two of one name are an error."""
    made = [Rule(r["name"], r["severity"], r["broken"], str(r.get("found", "0"))) for r in rows]
    if len({r.name for r in made}) < len(made):
        raise ValueError("two rules of one name")
    return made


def violations(rows: DataFrame, by: list[str], rules: list[Rule]) -> DataFrame:
    """by, rule, severity, found of each rule that a subject breaks. A rule that gives null, for want of values, isn't broken."""
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("two rules of one name")
    each = [F.struct(F.expr(r.broken).alias("broken"), F.expr(f"cast({r.found} AS double)").alias("found")).alias(f"__{i}") for i, r in enumerate(rules)]
    told: list[Column] = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"__{i}.broken").alias("broken"), F.col(f"__{i}.found").alias("found")) for i, r in enumerate(rules)]
    if not told:
        return rows.select(*by, F.lit("").alias("rule"), F.lit("").alias("severity"), F.lit(0.0).alias("found")).limit(0)
    broken = rows.groupBy(*by).agg(*each).select(*by, F.explode(F.filter(F.array(*told), lambda v: v["broken"])).alias("v"))
    return broken.select(*by, "v.rule", "v.severity", "v.found")


def verdicts(subjects: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """by, errors, warnings, is_valid, health of every subject: valid without errors, and 0 to 100 by what its broken rules take off."""
    off = F.expr("CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITIES.items()) + " END")
    counts = found.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.sum(off).alias("off"))
    joined = subjects.select(*by).distinct().join(counts, by, "left").fillna(0, ["errors", "warnings", "off"])
    return joined.select(*by, "errors", "warnings", (F.col("errors") == 0).alias("is_valid"), F.greatest(F.lit(0), 100 - F.col("off")).cast("int").alias("health"))


def playlist_rows(raw: DataFrame) -> DataFrame:
    """Segments of playlists (playlist_url, content) beside what their playlist says; a playlist without segments is one row without any."""
    return m3u8.playlists(raw).join(m3u8.segments(raw), "playlist_url", "left")


def sound_rows(sound: DataFrame) -> DataFrame:
    """sound with numbers of its samples in place of pcm: samples, not_finite, clipped, and whether all are silent."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    some = F.coalesce("pcm", F.array().cast("array<double>")).cast("array<double>")
    count = lambda f: F.size(F.filter(some, f))
    numbers = {
        "samples": F.size(some),
        "not_finite": count(lambda x: ~finite(x)),
        "clipped": count(lambda x: finite(x) & (F.abs(x) >= 0.999)),
        "silent": count(lambda x: finite(x) & (F.abs(x) > 0.001)) == 0,
    }
    return sound.withColumns(numbers).drop("pcm")
