"""Files in, documents out, and the whole run through the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import config
from lagloom.plans import cli
from lagloom.sources import audio_files, captures, catalog_files, playlists, sinks

MEDIA = """#EXTM3U
#EXT-X-VERSION:3
#EXT-X-TARGETDURATION:10
#EXT-X-MEDIA-SEQUENCE:42
#EXTINF:9.5,CATEGORY:news
a.ts
#EXT-X-DISCONTINUITY
#EXTINF:8,AD_BREAK
b.ts
"""
MASTER = """#EXTM3U
#EXT-X-STREAM-INF:BANDWIDTH=128000,CODECS="mp4a.40.2",RESOLUTION=1x1
low.m3u8
#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH=1,BANDWIDTH=256000
high.m3u8
"""


def test_playlists(spark, tmp_path):
    for name, body in (("media.m3u8", MEDIA), ("vod.m3u8", MEDIA + "#EXT-X-ENDLIST\n"), ("master.m3u8", MASTER), ("bad.m3u8", "<html>")):
        (tmp_path / name).write_text(body)
    raw = playlists.read_playlists(spark, str(tmp_path)).withColumn("playlist_url", F.regexp_extract("playlist_url", "[^/]*$", 0))
    heads = {r.playlist_url: r for r in playlists.playlists(raw).collect()}
    assert (heads["media.m3u8"].is_live, heads["media.m3u8"].version, heads["media.m3u8"].media_sequence, heads["media.m3u8"].target_duration) == (True, 3, 42, 10.0)
    assert not heads["vod.m3u8"].is_live and heads["master.m3u8"].is_master and not heads["bad.m3u8"].is_valid
    rows = playlists.segments(raw).where("playlist_url = 'media.m3u8'").orderBy("pos").collect()
    assert [(r.pos, r.uri, r.duration, r.title, r.discontinuity) for r in rows] == [(0, "a.ts", 9.5, "CATEGORY:news", False), (1, "b.ts", 8.0, "AD_BREAK", True)]
    rows = playlists.variants(raw).orderBy("pos").collect()
    assert [(r.bandwidth, r.codecs, r.resolution) for r in rows] == [(128000, "mp4a.40.2", "1x1"), (256000, None, None)]


def test_documents():
    nan = {"a": float("nan"), "b": [1.0, {"c": float("inf")}], "d": None}
    assert json.loads(sinks.formatted(nan)) == {"a": 0.0, "b": [1.0, {"c": 0.0}], "d": None}
    assert sinks.formatted({"a": {"b": [1, 2]}}, "csv").splitlines() == ["name,value", "a.b[0],1", "a.b[1],2"]
    assert "a.b[0]  1" in sinks.formatted({"a": {"b": [1, 2]}}, "table")
    assert json.loads(sinks.formatted({"a": 1}, "unknown")) == {"a": 1}


def test_catalog_files(spark, tmp_path):
    pytest.importorskip("yaml")
    for name in ("c.yaml", "c.json", "c.conf"):
        path = tmp_path / name
        catalog_files.write_document(str(path), catalog_files.example_catalog())
        assert catalog_files.read_catalog(spark, str(path)).count() == 6
    catalog_files.write_document(str(tmp_path / "s.yaml"), {"benchmark": {"operation_timeout": "340s"}, "test": {"timeout": "5s"}})
    assert catalog_files.read_run_settings(str(tmp_path / "s.yaml")).operation_timeout == 340 * 10**9
    assert catalog_files.read_settings(str(tmp_path / "s.yaml")) == {"test.timeout": 5 * 10**9}


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav(width):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(100)
        top = (1 << (8 * width - 1)) // 2
        frame = bytes([192, 64]) if width == 1 else top.to_bytes(width, "little", signed=True) + (0).to_bytes(width, "little")
        w.writeframes(frame * 5)
    pcm, rate, channels = audio_files.decode_wav(out.getvalue())
    assert (rate, channels, len(pcm)) == (100, 2, 5) and pcm[0] == pytest.approx(0.0 if width == 1 else 0.25)


def recordings(folder, rate=8000, seconds=8):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=2000), 50)[: rate * (seconds + 2)] * np.sin(np.arange(rate * (seconds + 2)) / 4) * 8000
    folder.mkdir()
    delays = {"primary.m3u8": 0.0, "backup.m3u8": 0.25, "hls_ti.m3u8": 1.0, "stream_ti": 0.5}
    for name, d in delays.items():
        lead = int(d * rate)
        (folder / name).write_bytes(audio_files.encode_wav(np.clip(np.r_[rng.normal(size=lead), x][: rate * seconds], -32767, 32767).astype(int).tolist(), rate))
    (folder / "broken").write_bytes(b"not sound")
    return delays


def test_recordings_of_streams(spark):
    streams = [
        ("g_one", "pri_source", "http://h.com/pri/master.m3u8?x=1"), ("g_one", "ti_hls", "http://h.com/ti/master.m3u8"), ("g_one", "ais", "http://h.com/ais/master.m3u8"), ("g_one", "ti_mp3", "http://h.com/live"),
        ("g_two", "own", "data/two/own.wav"), ("g_two", "whole", "file:///data/rec/abs/x.wav"), ("g_two", "twice", "http://h.com/none"), ("g_two", "gone", "http://h.com/gone"), ("g_two", "other", "data/own.wav"),
    ]
    paths = ["pri/master.m3u8.wav", "h.com/ti/master.m3u8", "elsewhere/master.m3u8", "one_ti_mp3_30s.wav", "data/two/own.wav", "abs/x.wav", "two_twice_30s.wav", "deep/two_twice_60s.wav", "own.wav", "master.m3u8"]
    audio = spark.createDataFrame([(f"file:/data/rec/{p}",) for p in paths], "path string")
    found = audio_files.found_recordings(spark.createDataFrame(streams, "broadcast_key string, stream_name string, url string"), audio, "/data/rec")
    got = {r.stream_name: (r.path.removeprefix("file:/data/rec/"), r.recordings) for r in found.collect()}
    assert got.pop("twice")[1] == 2
    assert got == {"pri_source": ("pri/master.m3u8.wav", 1), "ti_hls": ("h.com/ti/master.m3u8", 1), "ti_mp3": ("one_ti_mp3_30s.wav", 1), "own": ("data/two/own.wav", 1), "whole": ("abs/x.wav", 1)}


def test_one_recording_one_stream(spark):
    """A recording that the names of several streams would fit is an error for all of them; one that is named in full isn't."""
    streams = [
        ("g_b", "one", "https://cdn1.example.com/x/master.m3u8"), ("g_b", "two", "https://cdn2.example.com/x/master.m3u8"), ("g_b", "full", "https://cdn3.example.com/x/master.m3u8"),
        ("g_n", "pri_source", "https://a.example.com/p"), ("h_n", "pri_source", "https://b.example.com/p"), ("h_n", "ti_hls", "https://b.example.com/q"),
        ("g_s", "a", "https://same.example.com/s"), ("g_t", "b", "https://same.example.com/s"),
    ]
    streams = spark.createDataFrame(streams, "broadcast_key string, stream_name string, url string").withColumns({"error": F.lit(None).cast("string"), "type": F.lit("hls")})
    names = ["x/master.m3u8.wav", "cdn3.example.com/x/master.m3u8.wav", "n_pri_source.wav", "h_n_ti_hls.wav", "same.example.com/s.wav"]
    audio = spark.createDataFrame([(f"file:/rec/{n}", [0.5] * 100, 100, 1, None) for n in names], "path string, pcm array<double>, sample_rate int, channels int, error string")
    got = {(r.broadcast_key, r.stream_name): r for r in audio_files.measure(streams, audio, 1.0, "/rec").collect()}
    wrong = {k for k, r in got.items() if r.error and r.error.startswith("failed to load audio: a recording of several streams for https://")}
    assert wrong == {("g_b", "one"), ("g_b", "two"), ("g_n", "pri_source"), ("h_n", "pri_source")} and all(got[k].pcm is None for k in wrong)
    assert all(r.error is None and len(r.pcm) == 100 and r.ttfb_ns is None for k, r in got.items() if k not in wrong)


def test_replayed(spark, tmp_path):
    recordings(tmp_path / "audio")
    rows = audio_files.decoded(audio_files.replayed(spark, str(tmp_path / "audio"), 2))
    query = rows.writeStream.format("memory").queryName("replayed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("replayed").collect()
    assert len(got) == 5 and sum(r.error is None and len(r.pcm) == 64_000 for r in got) == 4 and len(query.recentProgress) >= 2


def test_compare(spark, tmp_path):
    recordings(tmp_path / "audio")
    url = "https://example.com"
    streams = {"pri_source": ("primary.m3u8", "source"), "bk_source": ("backup.m3u8", "source"), "ti_hls": ("hls_ti.m3u8", "cdn"), "ti_mp3": ("stream_ti", "cdn"), "ss_ais_hls": ("broken", "cdn"), "ss_ais_mp3": ("missing", "cdn")}
    doc = {"broadcast_groups": {"news": {"name": "News", "content_type": "news", "broadcasts": {"one": {"name": "News One", "streams": {k: {"url": f"{url}/{f}", "role": r, "type": "hls"} for k, (f, r) in streams.items()}}}}}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    out = tmp_path / "out" / "result.json"
    args = cli.parser().parse_args(["compare", "--catalog", str(tmp_path / "c.json"), "--audio", str(tmp_path / "audio"), "--segment-duration", "8s", "--output-file", str(out), "--output-format", "json", "--metrics", str(tmp_path / "m"), "--detailed-analysis", "--verbose", "--index", "0"])
    cli.compare(spark, args)
    result = json.loads(out.read_text())["benchmark_summary"]["broadcast_measurements"]["news_one"]
    lags = result["liveness_metrics"]
    assert lags["hls_cloudfront_lag"]["status"] == "MATCH" and lags["hls_cloudfront_lag"]["lag_seconds"] == pytest.approx(1.0, abs=0.005)
    assert lags["icecast_cloudfront_lag"]["lag_seconds"] == pytest.approx(0.5, abs=0.005) and lags["source_lag"]["lag_seconds"] == pytest.approx(0.25, abs=0.005)
    assert "hls_ais_lag" not in lags and "decode" in result["stream_measurements"]["ss_ais_hls"]["error"]
    assert result["stream_measurements"]["ss_ais_mp3"]["error"].startswith("failed to load audio: connection")
    whole = json.loads(out.read_text())
    assert whole["quality_metrics"]["stream_validity_rate"] == pytest.approx(4 / 6) and whole["performance_metrics"]["latency_source"]["count"] == 1
    assert whole["reliability_metrics"]["error_distribution"] == {"format": 1, "network": 1}
    metrics = spark.read.json(str(tmp_path / "m"))
    assert metrics.where("metric = 'streaming.latency.benchmark.ms'").count() == 3
    quiet = cli.parser().parse_args(["compare", "--catalog", str(tmp_path / "c.json"), "--audio", str(tmp_path / "audio"), "--skip-fingerprint", "--output-file", str(out)])
    cli.compare(spark, quiet)
    assert "liveness_metrics" not in json.loads(out.read_text())["benchmark_summary"]["broadcast_measurements"]["news_one"]


def test_captures(spark, tmp_path):
    rows = [{"stream": "s", "ts": "2024-01-01T00:00:00Z", "title": "A - B", "bitrate": 128, "headers": {"server": "x"}}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    r = captures.read_captures(spark, str(tmp_path)).first()
    assert r.title == "A - B" and r.headers == {"server": "x"} and r.codec is None


def test_environment(monkeypatch):
    monkeypatch.setenv("LAGLOOM_TEST_TIMEOUT", "3s")
    monkeypatch.setenv("LAGLOOM_TEST_CONCURRENT", "true")
    monkeypatch.setenv("LAGLOOM_AUDIO_CHANNELS", "1")
    assert cli.environment() == {"test.timeout": 3 * 10**9, "test.concurrent": True, "audio.channels": 1}


def test_layers_of_settings(spark, tmp_path, monkeypatch, capsys):
    """A file found on the search path, environment and flags, each over the one before."""
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("LAGLOOM_SETTINGS", raising=False)
    assert catalog_files.found_settings() is None
    (tmp_path / "home" / ".config" / "lagloom").mkdir(parents=True)
    (tmp_path / "home" / ".config" / "lagloom" / "lagloom.json").write_text("{}")
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "lagloom.json").write_text(json.dumps({"test": {"timeout": "7s", "max_concurrency": 9}, "output": "csv"}))
    assert catalog_files.found_settings() == "configs/lagloom.json"
    monkeypatch.setenv("LAGLOOM_TEST_TIMEOUT", "8s")
    args = cli.parser().parse_args(["settings", "--set", "test.timeout=9s", "--set", "audio.channels=1"])
    layers = cli.layers_of(args)
    merged = config.layered(*layers.values())
    assert (merged["test.timeout"], merged["test.max_concurrency"], merged["audio.channels"], merged["output_format"]) == (9 * 10**9, 9, 1, "csv")
    cli.settings_table(spark, args)
    told = {line.split("\t")[0]: line.split("\t")[1:] for line in capsys.readouterr().out.splitlines()}
    assert told["test.timeout"] == [str(9 * 10**9), "flags", "environment, file, defaults"]
    assert told["output_format"] == ['"csv"', "file", "defaults"] and told["audio.channels"] == ["1", "flags", "defaults"] and told["audio.sample_rate"] == ["44100", "defaults", ""]
    for wrong in ("test.timeout", "no.such=1"):
        with pytest.raises(ValueError, match="not a setting"):
            cli.flags([wrong])


def test_rules_told(spark, tmp_path, capsys):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.m3u8").write_text("#EXTM3U\n#EXT-X-TARGETDURATION:4\n#EXTINF:9,\na.ts\n#EXT-X-ENDLIST\n")
    cli.hls(spark, cli.parser().parse_args(["hls", "--playlists", str(tmp_path / "p")]))
    assert "over_target_duration\terror\t1.0" in capsys.readouterr().out
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"name": "few", "severity": "info", "broken": "count(uri) < 3", "found": "count(uri)"}]}))
    cli.hls(spark, cli.parser().parse_args(["hls", "--playlists", str(tmp_path / "p"), "--rules", str(tmp_path / "r.json")]))
    out = capsys.readouterr().out
    assert "few\tinfo\t1.0" in out and "over_target" not in out
    (tmp_path / "c.json").write_text(json.dumps({"stream": "s", "bytes_received": 3, "title": "t"}))
    cli.icecast(spark, cli.parser().parse_args(["icecast", "--captures", str(tmp_path / "c.json"), "--check"]))
    assert "no_content_type\terror" in capsys.readouterr().out
