"""Catalogues and settings from YAML or JSON files.

These documents are small and are read on the driver; what comes out is a table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lagloom.operators.config import RunSettings, flatten

SCHEMA = (
    "group_key string, group_name string, group_content_type string, group_enabled boolean, broadcast_key string, broadcast_name string, "
    "broadcast_content_type string, broadcast_enabled boolean, stream_name string, url string, type string, role string, content_type string, enabled boolean"
)


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML; JSON files need nothing") from e
    return yaml


def parse(text: str, suffix: str = "") -> dict[str, Any]:
    """A document by the extension of its file: .json is JSON, .yaml and .yml are YAML, anything else is tried as YAML, then as JSON."""
    if suffix.lower() == ".json":
        return json.loads(text)
    if suffix.lower() in (".yaml", ".yml"):
        return _yaml().safe_load(text) or {}
    try:
        found = _yaml().safe_load(text) or {}
    except ImportError:
        return json.loads(text)
    except Exception:
        return json.loads(text)
    return found


def read_document(path: str) -> dict[str, Any]:
    file = Path(path)
    found = parse(file.read_text(encoding="utf-8"), file.suffix)
    if not isinstance(found, Mapping):
        raise ValueError(f"{path} holds no mapping")
    return dict(found)


def catalog_rows(document: Mapping[str, Any]) -> list[tuple]:
    """A row for each stream of a catalogue; an empty group or broadcast has a row of its own."""
    rows = []
    for gk, g in (document.get("broadcast_groups") or {}).items():
        g = g or {}
        head = (str(gk), g.get("name"), g.get("content_type"), g.get("enabled"))
        broadcasts = g.get("broadcasts") or {}
        if not broadcasts:
            rows.append(head + (None,) * 10)
        for bk, b in broadcasts.items():
            b = b or {}
            middle = (str(bk), b.get("name"), b.get("content_type"), b.get("enabled"))
            streams = b.get("streams") or {}
            if not streams:
                rows.append(head + middle + (None,) * 6)
            for sk, s in streams.items():
                s = s or {}
                rows.append(head + middle + (str(sk), s.get("url"), s.get("type"), s.get("role"), s.get("content_type"), s.get("enabled")))
    return rows


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(catalog_rows(read_document(path)), SCHEMA)


def read_settings(path: str) -> dict[str, Any]:
    """General settings of a file with dotted keys, without those of a run."""
    return {k: v for k, v in flatten({k: v for k, v in read_document(path).items() if k != "benchmark"}).items()}


def found_settings(name: str = "lagloom") -> str | None:
    """The first settings file on the search path: what the variable LAGLOOM_SETTINGS names, ./configs, the home folder, its .config, /etc."""
    if own := os.environ.get("LAGLOOM_SETTINGS"):
        return own
    folders = [Path("configs"), Path.home(), Path.home() / ".config" / name, Path("/etc") / name]
    return next((str(f) for folder in folders for end in ("yaml", "yml", "json") if (f := folder / f"{name}.{end}").is_file()), None)


def read_run_settings(path: str) -> RunSettings:
    return RunSettings.read(read_document(path).get("benchmark") or {})


def example_catalog() -> dict[str, Any]:
    """A catalogue of one broadcast with all five kinds of delivery; its URLs lead nowhere."""
    url = "https://example.com/live"
    streams = {
        "pri_source": {"url": f"{url}/primary.m3u8", "type": "hls", "role": "source"},
        "bk_source": {"url": f"{url}/backup.m3u8", "type": "hls", "role": "source"},
        "ti_hls": {"url": f"{url}/ti/master.m3u8", "type": "hls", "role": "cdn"},
        "ti_mp3": {"url": f"{url}/ti/stream", "type": "icecast", "role": "cdn"},
        "ss_ais_hls": {"url": f"{url}/ais/master.m3u8", "type": "hls", "role": "cdn"},
        "ss_ais_mp3": {"url": f"{url}/ais/stream", "type": "icecast", "role": "cdn"},
    }
    return {"version": "1", "broadcast_groups": {"news": {"name": "News", "content_type": "news", "broadcasts": {"one": {"name": "News One", "streams": streams}}}}}


def example_settings() -> dict[str, Any]:
    from dataclasses import asdict

    return {"benchmark": asdict(RunSettings().filled())}


def write_document(path: str, document: Mapping[str, Any]) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(document, indent=2) if file.suffix == ".json" else _yaml().safe_dump(dict(document), sort_keys=False)
    file.write_text(text, encoding="utf-8")
