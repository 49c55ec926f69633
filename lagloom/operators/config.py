"""Settings: defaults, layers, presets, checks.

Settings are small and live on the driver as plain mappings with dotted keys; layers and coalesce
do the same to tables of them. Durations are nanoseconds. Names of agents and hosts are
neutral and meant to be replaced.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.durations import nanoseconds
from lagloom.functions.urls import HLS_TYPES, HLS_URLS, ICECAST_PORTS, ICECAST_TYPES, ICECAST_URLS

S = 1_000_000_000
M = 60 * S

# Defaults of all settings.
DEFAULTS: dict[str, Any] = {
    "verbose": False, "log_level": "info", "output_format": "table",
    "stream.connection_timeout": 10 * S, "stream.read_timeout": 90 * S, "stream.buffer_size": 8192, "stream.max_redirects": 3,
    "stream.user_agent": "lagloom/1.0", "stream.headers": {}, "stream.ad_bypass_rules": [],
    "test.timeout": 90 * S, "test.retry_attempts": 3, "test.retry_delay": 5 * S, "test.concurrent": False, "test.max_concurrency": 4,
    "audio.sample_rate": 44100, "audio.channels": 2, "audio.buffer_duration": 1 * S, "audio.window_size": 2048, "audio.overlap": 0.5,
    "audio.window_function": "hann", "audio.fft_size": 2048, "audio.mel_bins": 128,
    "quality.min_similarity": 0.95, "quality.max_latency": 5 * S, "quality.min_bitrate": 128, "quality.max_dropouts": 3, "quality.buffer_health": 0.8,
    "output.precision": 3, "output.include_metadata": True, "output.timestamps": True, "output.colors": True, "output.pager": False,
    "hls.parser.strict_mode": False, "hls.parser.max_segment_analysis": 10, "hls.parser.ignore_unknown_tags": False, "hls.parser.validate_uris": False,
    "hls.parser.custom_tag_handlers": {}, "hls.detection.url_patterns": HLS_URLS, "hls.detection.content_types": HLS_TYPES,
    "hls.detection.timeout_seconds": 5, "hls.detection.required_headers": [], "hls.http.user_agent": "lagloom-hls/1.0",
    "hls.http.accept_header": "application/vnd.apple.mpegurl,application/x-mpegurl,text/plain", "hls.http.connection_timeout": 5 * S,
    "hls.http.read_timeout": 15 * S, "hls.http.max_redirects": 5, "hls.http.buffer_size": 16384, "hls.http.custom_headers": {},
    "hls.audio.sample_duration": 90 * S, "hls.audio.buffer_duration": 2 * S, "hls.audio.max_segments": 10, "hls.audio.follow_live": False,
    "hls.audio.analyze_segments": False, "hls.metadata_extractor.enable_url_patterns": True, "hls.metadata_extractor.enable_header_mappings": True,
    "hls.metadata_extractor.enable_segment_analysis": True, "hls.metadata_extractor.default_values": {"codec": "aac", "channels": 2, "sample_rate": 44100},
    "icecast.detection.url_patterns": ICECAST_URLS, "icecast.detection.content_types": ICECAST_TYPES, "icecast.detection.timeout_seconds": 15,
    "icecast.detection.required_headers": [], "icecast.detection.common_ports": ICECAST_PORTS, "icecast.http.user_agent": "lagloom-icecast/1.0",
    "icecast.http.accept_header": "audio/*, application/ogg, */*", "icecast.http.connection_timeout": 45 * S, "icecast.http.read_timeout": 60 * S,
    "icecast.http.max_redirects": 3, "icecast.http.custom_headers": {}, "icecast.http.request_icy_meta": True, "icecast.audio.buffer_size": 4096,
    "icecast.audio.buffer_duration": 2 * S, "icecast.audio.sample_duration": 90 * S, "icecast.audio.max_read_attempts": 10,
    "icecast.audio.read_timeout": 90 * S, "icecast.audio.handle_icy_meta": True, "icecast.audio.metadata_interval": 8192,
    "icecast.metadata_extractor.enable_header_mappings": True, "icecast.metadata_extractor.enable_icy_metadata": True,
    "icecast.metadata_extractor.icy_metadata_timeout": 15 * S, "icecast.metadata_extractor.default_values": {"codec": "mp3", "channels": 2, "sample_rate": 44100},
}

# Presets, each a part of the settings to lay over the defaults.
PRESETS: dict[str, dict[str, Any]] = {
    "quality.production": {"min_similarity": 0.99, "max_latency": 1 * S, "min_bitrate": 256, "max_dropouts": 0, "buffer_health": 0.95},
    "quality.development": {"min_similarity": 0.85, "max_latency": 10 * S, "min_bitrate": 64, "max_dropouts": 10, "buffer_health": 0.5},
    "quality.comprehensive": {"min_similarity": 0.98, "max_latency": 2 * S, "min_bitrate": 192, "max_dropouts": 1, "buffer_health": 0.9},
    "audio.high_quality": {"sample_rate": 48000, "channels": 2, "buffer_duration": 2 * S, "window_size": 4096, "overlap": 0.75, "window_function": "hamming", "fft_size": 4096, "mel_bins": 256},
    "audio.fast": {"sample_rate": 22050, "channels": 1, "buffer_duration": S // 2, "window_size": 1024, "overlap": 0.25, "window_function": "hann", "fft_size": 1024, "mel_bins": 64},
    "test.production": {"timeout": 5 * M, "retry_attempts": 5, "retry_delay": 10 * S, "concurrent": True, "max_concurrency": 8},
    "test.development": {"timeout": 1 * M, "retry_attempts": 1, "retry_delay": 2 * S, "concurrent": False, "max_concurrency": 2},
    "stream.production": {"connection_timeout": 15 * S, "read_timeout": 60 * S, "buffer_size": 16384, "max_redirects": 5},
    "stream.development": {"connection_timeout": 5 * S, "read_timeout": 15 * S, "buffer_size": 4096, "max_redirects": 2},
    "output.json": {"colors": False, "pager": False, "precision": 6},
    "output.csv": {"colors": False, "pager": False, "include_metadata": False, "timestamps": False},
    "output.table": {"colors": True, "pager": True, "precision": 2},
}

# What requests send and streams are expected to be, profiles of test runs, regions.
HEADERS = {"User-Agent": "lagloom/1.0", "Accept": "audio/*, application/vnd.apple.mpegurl, application/x-mpegurl", "Cache-Control": "no-cache", "Connection": "keep-alive"}
EXPECTED_METADATA = {"bitrate": 128, "sample_rate": 44100, "channels": 2, "codec": "aac", "format": "auto"}
#: Profiles of a test run: seconds, metrics, and the preset of its quality thresholds (none: the defaults).
PROFILES = {
    "quick": {"duration": 90 * S, "metrics": ["latency", "connectivity", "basic_quality"], "thresholds": None},
    "standard": {"duration": 2 * M, "metrics": ["latency", "quality", "reliability"], "thresholds": None},
    "comprehensive": {"duration": 10 * M, "metrics": ["latency", "quality", "reliability", "spectral_analysis"], "thresholds": "quality.comprehensive"},
}
REGIONS = {"local": {"name": "Local Development", "endpoint": "http://localhost:8080", "location": "localhost", "headers": {}, "enabled": True}}


def section(name: str, preset: str | None = None) -> dict[str, Any]:
    """The defaults of a section, by their names in it, under a preset if given."""
    base = {k[len(name) + 1 :]: v for k, v in DEFAULTS.items() if k.startswith(f"{name}.")}
    return base | (PRESETS.get(f"{name}.{preset}", {}) if preset else {})


def flatten(tree: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """A nested document with dotted keys. Keys whose default is itself a mapping stay whole."""
    out = {}
    for k, v in tree.items():
        name = f"{prefix}{k}"
        if isinstance(v, Mapping) and not isinstance(DEFAULTS.get(name), Mapping):
            out |= flatten(v, f"{name}.")
        else:
            out[name] = nanoseconds(v) if name in DEFAULTS and isinstance(v, str) and _is_duration(name) else v
    return out


def _is_duration(key: str) -> bool:
    return key.endswith(("timeout", "_delay", "_duration", "max_latency")) and not key.endswith("_seconds")


def nest(flat: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """The nested form of the settings below a prefix, as the readers of a protocol take it."""
    out: dict[str, Any] = {}
    for key, value in flat.items():
        if key.startswith(prefix):
            *path, leaf = key[len(prefix) :].split(".")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            at[leaf] = value
    return out


def layered(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers override earlier ones, key by key; None doesn't count as a value. Defaults lie below all."""
    out = dict(DEFAULTS)
    for layer in layers:
        out |= {k: v for k, v in layered_names(layer).items() if v is not None}
    return out


def merge_layers(layers: DataFrame, key: str = "key", value: str = "value", priority: str = "priority") -> DataFrame:
    """The same on a table: for each key the value of the highest priority that has one."""
    return layers.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, priority).alias(value))


def traced_layers(layers: DataFrame, key: str = "key", value: str = "value", layer: str = "layer", priority: str = "priority") -> DataFrame:
    """key, value, layer, hidden: for each key its value, the layer that it came from, and the layers whose values it hides, the highest first.

    A null isn't a value; a key without any has no row. Of layers with one priority the last name counts, so that a layer
    that has a key twice gives its largest value.
    """
    own = layers.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(priority).alias("priority"), F.col(layer).alias("layer")).agg(F.max(value).alias("value"))
    ranked = F.sort_array(F.collect_list(F.struct("priority", "layer", "value")), asc=False)  # one entry a layer
    top = F.col("r")[0]
    return own.groupBy("key").agg(ranked.alias("r")).select("key", top["value"].alias("value"), top["layer"].alias("layer"), F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["layer"]).alias("hidden"))


def layer_rows(layers: Mapping[str, Mapping[str, Any]]) -> list[tuple[str, str, str, int]]:
    """Rows (key, layer, value, priority) of named layers, the lowest first; values as JSON, without those that are None."""
    return [(k, name, json.dumps(v, sort_keys=True), n) for n, (name, layer) in enumerate(layers.items()) for k, v in layered_names(layer).items() if v is not None]


def layered_names(layer: Mapping[str, Any]) -> dict[str, Any]:
    """A layer under the names of the settings: output as a plain value is output_format."""
    return {("output_format" if k == "output" and not isinstance(v, Mapping) else k): v for k, v in layer.items()}


def typed(key: str, raw: str) -> Any:
    """What a text means for a setting, by its default: durations in nanoseconds, words for flags, JSON for the rest; plain text for keys without a default."""
    default = DEFAULTS.get(key)
    if _is_duration(key):
        return int(raw) if raw.isdigit() else nanoseconds(raw)
    if isinstance(default, bool):
        return raw.lower() in ("1", "true", "yes")
    return raw if default is None or isinstance(default, str) else json.loads(raw)


def with_defaults(settings: DataFrame, defaults: DataFrame, key: str = "key") -> DataFrame:
    """settings and those rows of defaults whose key it doesn't have."""
    return settings.unionByName(defaults.join(settings.select(key), key, "left_anti").select(*settings.columns))


@dataclass(frozen=True)
class RunSettings:
    """What a comparison run goes by. Zero and empty count as unset in filled(); durations in nanoseconds."""

    benchmark_timeout: int = 0
    operation_timeout: int = 0
    max_concurrent_broadcasts: int = 0
    max_concurrent_streams: int = 0
    audio_segment_duration: int = 0
    min_alignment_confidence: float = 0.0
    max_alignment_offset: float = 0.0
    min_fingerprint_similarity: float = 0.0
    max_retries: int = 0
    retry_delay: int = 0
    fail_fast: bool = False
    skip_fingerprint_comparison: bool = False
    enable_detailed_analysis: bool = False
    include_feature_breakdown: bool = False
    include_raw_data: bool = False
    validate_hls_structure: bool = False
    validate_icecast_metadata: bool = False
    validate_audio_format: bool = False
    validate_bitrate_consistency: bool = False
    min_health_score: float = 0.0
    output_format: str = ""
    pretty_print: bool = False
    generate_summary: bool = False

    @classmethod
    def read(cls, values: Mapping[str, Any]) -> "RunSettings":
        """From a document; unknown keys are passed over, durations may be texts."""
        known = {f.name: f.default for f in fields(cls)}
        return cls(**{k: nanoseconds(v) if k.endswith(("timeout", "delay", "duration")) else v for k, v in values.items() if k in known and v is not None})

    def filled(self) -> "RunSettings":
        """With defaults for what is unset. If no validation is asked for, all are."""
        out = replace(self, **{k: getattr(self, k) or v for k, v in RUN_DEFAULTS.items()}, pretty_print=True, generate_summary=True)
        checks = [f.name for f in fields(self) if f.name.startswith("validate_")]
        return out if any(getattr(self, c) for c in checks) else replace(out, **dict.fromkeys(checks, True))

    def under_flags(self, timeout: int = 0, segment_duration: int = 0, max_concurrent: int = 0, output_format: str = "", detailed: bool = False, skip_fingerprint: bool = False) -> "RunSettings":
        """Filled, then overridden: the first four where given, the two switches always."""
        out = self.filled()
        return replace(
            out,
            benchmark_timeout=timeout if timeout > 0 else out.benchmark_timeout,
            audio_segment_duration=segment_duration if segment_duration > 0 else out.audio_segment_duration,
            max_concurrent_broadcasts=max_concurrent if max_concurrent > 0 else out.max_concurrent_broadcasts,
            output_format=output_format or out.output_format,
            enable_detailed_analysis=detailed,
            include_feature_breakdown=detailed,
            include_raw_data=detailed,
            skip_fingerprint_comparison=skip_fingerprint,
        )

    def problems(self) -> list[str]:
        """All that is out of range, in the order of checks."""
        positive = ["benchmark_timeout", "operation_timeout", "max_concurrent_broadcasts", "max_concurrent_streams", "audio_segment_duration"]
        share = ["min_fingerprint_similarity", "min_health_score"]
        checks = [(k, "positive") for k in positive] + [("min_alignment_confidence", "share"), ("max_alignment_offset", "positive")] + [(k, "share") for k in share]
        return [_fault(k, rule) for k, rule in checks if not _within(getattr(self, k), rule)]


# Defaults of a run.
RUN_DEFAULTS = {
    "benchmark_timeout": 30 * M, "operation_timeout": 300 * S, "max_concurrent_broadcasts": 3, "max_concurrent_streams": 4, "audio_segment_duration": 90 * S,
    "min_alignment_confidence": 0.4, "max_alignment_offset": 15.0, "min_fingerprint_similarity": 0.6, "max_retries": 2, "retry_delay": 5 * S,
    "min_health_score": 0.7, "output_format": "json",
}

#: Checks of the settings, in order. positive: over 0; natural: 0 or more; share: 0 to 1; filled: not empty.
RULES = [
    ("test.timeout", "positive"), ("test.retry_attempts", "natural"), ("audio.sample_rate", "positive"), ("audio.channels", "positive"), ("quality.min_similarity", "share"),
    *[(f"hls.{k}", r) for k, r in (("http.connection_timeout", "positive"), ("http.read_timeout", "positive"), ("http.max_redirects", "natural"), ("http.buffer_size", "positive"),
                                   ("audio.sample_duration", "positive"), ("audio.buffer_duration", "positive"), ("audio.max_segments", "positive"))],
    *[(f"icecast.{k}", r) for k, r in (("http.connection_timeout", "positive"), ("http.read_timeout", "positive"), ("http.max_redirects", "natural"), ("audio.sample_duration", "positive"),
                                       ("audio.buffer_duration", "positive"), ("audio.max_read_attempts", "positive"), ("audio.read_timeout", "positive"),
                                       ("metadata_extractor.icy_metadata_timeout", "positive"), ("detection.timeout_seconds", "positive"),
                                       ("detection.url_patterns", "filled"), ("detection.content_types", "filled"))],
    ("stream.connection_timeout", "positive"), ("stream.read_timeout", "positive"), ("stream.max_redirects", "natural"), ("stream.buffer_size", "positive"),
]


def _within(value: Any, rule: str) -> bool:
    if rule == "filled":
        return bool(value)
    value = value or 0
    return {"positive": value > 0, "natural": value >= 0, "share": not (value < 0 or value > 1)}[rule]


def _fault(key: str, rule: str) -> str:
    said = {"positive": "must be positive", "natural": "must not be negative", "share": "must be between 0 and 1", "filled": "must not be empty"}
    return f"{key} {said[rule]}"


def problems(settings: Mapping[str, Any]) -> list[str]:
    """All that is out of range, in the order of RULES; a missing setting counts as 0."""
    return [_fault(k, rule) for k, rule in RULES if not _within(settings.get(k), rule)]


def output_format(flag: str | None, settings: Mapping[str, Any]) -> str:
    """The flag, else the general setting, else that of the run, else json."""
    return flag or settings.get("output_format") or settings.get("benchmark.output_format") or "json"

#: What recordings of a content type are analysed by: which features count beside the cepstral ones.
CONTENT_SETTINGS = [
    ("music", False, True, True),
    ("news", True, False, False),
    ("talk", True, False, False),
    ("sports", True, False, False),
    ("mixed", True, True, False),
]


def with_content_settings(streams: DataFrame, column: str = "content_type") -> DataFrame:
    """streams with speech_features, harmonic_features and chroma_features of their content type; unknown types go as news."""
    from lagloom.functions.text import content_type

    table = streams.sparkSession.createDataFrame(CONTENT_SETTINGS, "__kind string, speech_features boolean, harmonic_features boolean, chroma_features boolean")
    kinds = streams.withColumn("__kind", content_type(F.col(column)))
    return kinds.join(F.broadcast(table), "__kind", "left").drop("__kind")
