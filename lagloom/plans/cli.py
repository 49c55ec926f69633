"""Command line: compare the deliveries of a broadcast, or look at one captured playlist or stream.

    python -m lagloom compare --catalog broadcasts.yaml --audio recordings/ [--settings app.yaml] [--index N] ...
    python -m lagloom hls --playlists folder/
    python -m lagloom icecast --captures folder/
    python -m lagloom validate --catalog broadcasts.yaml
    python -m lagloom settings [--settings app.yaml] [--set test.timeout=30s]
    python -m lagloom example --catalog broadcasts.yaml --settings app.yaml
"""

from __future__ import annotations

import argparse
import json
import os
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions import numbers, text
from lagloom.functions.durations import nanoseconds
from lagloom.operators import catalog, config, rules, segments
from lagloom.operators.config import RunSettings
from lagloom.plans import benchmark
from lagloom.sources import audio_files, captures, catalog_files, playlists, sinks
from lagloom.streaming.changes import changed_titles


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lagloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("compare")
    p.add_argument("--catalog", required=True)
    p.add_argument("--audio", required=True, help="folder of WAV files at the paths of the URLs, or named {broadcast}_{stream}.wav")
    p.add_argument("--settings")
    p.add_argument("--set", action="append", metavar="KEY=VALUE", help="a general setting, over file and environment")
    p.add_argument("--index", type=int, help="only the broadcast at this place")
    p.add_argument("--timeout", default="30m")
    p.add_argument("--segment-duration", default="0s")
    p.add_argument("--max-concurrent", type=int, default=3)
    p.add_argument("--output-format", choices=["json", "yaml", "csv", "table"])
    p.add_argument("--output-file")
    p.add_argument("--metrics", help="folder for metric rows")
    p.add_argument("--detailed-analysis", action="store_true")
    p.add_argument("--skip-fingerprint", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p = sub.add_parser("hls")
    p.add_argument("--playlists", required=True)
    p.add_argument("--segments", type=int, default=10)
    p.add_argument("--rules", help="a file of rules (name, severity, broken, found) in place of those built in")
    p.add_argument("--limit", type=int, help="rows of each table; all without")
    p = sub.add_parser("icecast")
    p.add_argument("--captures", required=True)
    p.add_argument("--limit", type=int, help="rows; all without")
    p.add_argument("--follow", action="store_true")
    p.add_argument("--check", action="store_true", help="the rules that streams break")
    p = sub.add_parser("validate")
    p.add_argument("--catalog")
    p.add_argument("--settings")
    p = sub.add_parser("settings")
    p.add_argument("--settings")
    p.add_argument("--set", action="append", metavar="KEY=VALUE")
    p = sub.add_parser("example")
    p.add_argument("--catalog")
    p.add_argument("--settings")
    return top


def environment(prefix: str = "LAGLOOM_") -> dict[str, str]:
    """Settings from variables such as LAGLOOM_TEST_TIMEOUT, by the names of the defaults."""
    found = {}
    for key, default in config.DEFAULTS.items():
        raw = os.environ.get(prefix + text.setting_key(key))
        if raw is not None:
            found[key] = config.typed(key, raw)
    return found


def flags(given: list[str] | None) -> dict[str, object]:
    """Settings from flags `--set key=value`; a key that no default has is an error."""
    found = {}
    for each in given or []:
        key, mark, raw = each.partition("=")
        if not mark or key not in config.DEFAULTS:
            raise ValueError(f"--set {each}: not a setting")
        found[key] = config.typed(key, raw)
    return found


def layers_of(args) -> dict[str, dict]:
    """All layers of general settings, the lowest first: defaults, the file (given or found on the search path), environment, flags."""
    path = args.settings or catalog_files.found_settings()
    return {"defaults": config.DEFAULTS, "file": catalog_files.read_settings(path) if path else {}, "environment": environment(), "flags": flags(args.set)}


def settings_table(spark: SparkSession, args) -> None:
    """Every setting, its value, the layer that it is from, and those that it hides."""
    rows = spark.createDataFrame(config.layer_rows(layers_of(args)), "key string, layer string, value string, priority int")
    show(config.traced_layers(rows).withColumn("hidden", F.array_join("hidden", ", ")).orderBy("key"), None)


def load(spark: SparkSession, args) -> tuple[dict, RunSettings, object]:
    """Settings, run settings and catalogue, all checked."""
    settings = config.layered(*layers_of(args).values())
    path = args.settings or catalog_files.found_settings()
    own = catalog_files.read_run_settings(path) if path else RunSettings()
    run = own.under_flags(nanoseconds(args.timeout), nanoseconds(args.segment_duration), args.max_concurrent, args.output_format or "", args.detailed_analysis, args.skip_fingerprint)
    wrong = config.problems(settings) + run.problems()
    if wrong:
        raise ValueError("; ".join(wrong))
    streams = catalog.inherit(catalog_files.read_catalog(spark, args.catalog))
    wrong = catalog.problems(streams)
    faults = [r.problem for r in wrong.orderBy("level", "group_key", "broadcast_key", "stream_name").limit(20).collect()]
    if len(faults) == 20 and (more := wrong.count() - 20):
        faults.append(f"and {more} more, which the command validate tells")
    if faults or not streams.head(1):
        raise ValueError("; ".join(faults) or "a catalogue needs a group")
    return settings, run, streams


def compare(spark: SparkSession, args) -> dict:
    began = time.time()
    settings, run, streams = load(spark, args)
    rows = catalog.enabled_groups(streams).where("broadcast_enabled") if args.index is None else catalog.select_broadcast(streams, args.index)
    keyed = rows.withColumns({"key": text.measurement_key(F.col("group_key"), F.col("broadcast_key")), "error": F.lit(None).cast("string")})
    keyed = keyed.withColumn("broadcast_key", F.col("key")).drop("key")
    measured = audio_files.measure(keyed, audio_files.read_audio(spark, args.audio), run.audio_segment_duration / 1e9, os.path.abspath(args.audio) if "://" not in args.audio else args.audio)
    broadcasts = keyed.groupBy("broadcast_key").agg(F.first("broadcast_name").alias("name"), F.first("broadcast_content_type").alias("content_type")).withColumns({"total_s": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    # Everything below goes back to the same samples.
    measured = measured.cache()
    made = benchmark.run(broadcasts, measured, run, settings["output.precision"])
    documents = {r.broadcast_key: json.loads(r.document) for r in benchmark.documents(made, args.verbose).collect()}
    out = {
        "benchmark_summary": {"start_time": datetime.fromtimestamp(began, timezone.utc).isoformat(), "total_duration": time.time() - began, "average_latency_metrics": None, "broadcast_measurements": documents},
        "timestamp": datetime.now(timezone.utc).isoformat(),
        "configuration": {"segment_duration": nanoseconds(args.segment_duration) / 1e9, "timeout": nanoseconds(args.timeout) / 1e9, "detailed_analysis": args.detailed_analysis, "skip_fingerprint": args.skip_fingerprint},
    }
    if args.detailed_analysis or args.verbose:
        out["performance_metrics"] = {r.metric: r.asDict() for r in made.performance().collect()} if args.detailed_analysis else None
        out["quality_metrics"] = made.quality().first().asDict(True) if args.detailed_analysis else None
        out["reliability_metrics"] = made.reliability().first().asDict(True) if args.detailed_analysis else None
    if args.metrics:
        sinks.write_metrics(made.metrics(), args.metrics)
    sinks.write_text(args.output_file, sinks.formatted(out, config.output_format(args.output_format, {k: v for k, v in settings.items() if k != "output_format" or v != config.DEFAULTS[k]} | {"benchmark.output_format": run.output_format})))
    measured.unpersist()
    return out


def show(df: DataFrame, limit: int | None) -> None:
    """All rows as lines of tabs, fetched a partition at a time; with a limit so many, and a line that says so."""
    print("\t".join(df.columns))
    for n, row in enumerate(df.toLocalIterator()):
        if limit is not None and n >= limit:
            print(f"... only {limit} rows are shown")
            return
        print("\t".join("" if v is None else str(v) for v in row))


def hls(spark: SparkSession, args) -> None:
    raw = playlists.read_playlists(spark, args.playlists)
    heads, parts, variants = playlists.playlists(raw), playlists.segments(raw), playlists.variants(raw)
    heads = heads.withColumns({"kind": text.playlist_kind(F.col("is_master"), F.col("is_live")), "result": text.pass_label(F.col("is_valid"))})
    own = rules.from_rows(catalog_files.read_document(args.rules)["rules"]) if args.rules else rules.PLAYLIST_RULES
    checked = rules.playlist_rows(raw)
    broken = rules.violations(checked, ["playlist_url"], own)
    for df in (broken, rules.verdicts(checked, broken, ["playlist_url"]), heads, segments.segment_summary(parts, args.segments), segments.playlist_analysis(heads.select("playlist_url"), parts, variants), segments.last_segment(parts)):
        show(df, args.limit)


def icecast(spark: SparkSession, args) -> None:
    rows = captures.read_captures(spark, args.captures)
    if args.follow:
        show(changed_titles(rows).select("stream", "ts", text.icy_title(F.col("title")).alias("t")).select("stream", "ts", "t.*").orderBy("stream", "ts"), args.limit)
        return
    if args.check:
        broken = rules.violations(rows, ["stream"], rules.STREAM_RULES)
        show(broken, args.limit)
        show(rules.verdicts(rows, broken, ["stream"]), args.limit)
        return
    score = numbers.quality_score(F.col("bitrate"), F.col("sample_rate"), F.col("codec"), F.coalesce(F.col("bytes_received") > 0, F.lit(False)))
    show(rows.select("stream", "ts", score.alias("score"), numbers.rating(score).alias("rating"), numbers.buffer_band(F.col("buffer_health")).alias("buffer"), text.shown_headers(F.col("headers")).alias("headers")), args.limit)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "example":
        if args.catalog:
            catalog_files.write_document(args.catalog, catalog_files.example_catalog())
        if args.settings:
            catalog_files.write_document(args.settings, catalog_files.example_settings())
        return 0
    spark = SparkSession.builder.appName("lagloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "validate":
        wrong = []
        if args.catalog:
            rows = catalog.problems(catalog.inherit(catalog_files.read_catalog(spark, args.catalog)))
            wrong += [r.problem for r in rows.orderBy("level", "group_key", "broadcast_key", "stream_name").collect()]
        if args.settings:
            wrong += config.problems(config.layered(catalog_files.read_settings(args.settings))) + catalog_files.read_run_settings(args.settings).filled().problems()
        print("\n".join(wrong) or "valid")
        return int(bool(wrong))
    {"compare": compare, "hls": hls, "icecast": icecast, "settings": settings_table}[args.command](spark, args)
    return 0
