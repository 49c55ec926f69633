"""Results: documents as JSON, YAML, CSV or a table, and metric rows; for samples see sound_files."""

from __future__ import annotations

import csv
import io
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def scrub(value: Any) -> Any:
    """value with every NaN and infinity, however deep, replaced by 0."""
    if isinstance(value, float):
        return value if math.isfinite(value) else 0.0
    if isinstance(value, dict):
        return {k: scrub(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [scrub(v) for v in value]
    return value


def _flat(value: Any, name: str = "") -> list[tuple[str, Any]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _flat(v, f"{name}.{k}" if name else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in _flat(v, f"{name}[{i}]")]
    return [(name, value)]


def formatted(document: dict, kind: str = "json") -> str:
    """A document as text; an unknown kind is JSON."""
    if kind == "yaml":
        from lagloom.sources.catalog_files import _yaml

        return _yaml().safe_dump(document, sort_keys=False)
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([("name", "value"), *_flat(document)])
        return out.getvalue()
    if kind == "table":
        rows = [(k, "" if v is None else str(v)) for k, v in _flat(document)]
        wide = max((len(k) for k, _ in rows), default=0)
        return "".join(f"{k.ljust(wide)}  {v}\n" for k, v in rows)
    try:
        return json.dumps(document, indent=2, default=str, allow_nan=False) + "\n"
    except ValueError:
        return json.dumps(scrub(document), indent=2, default=str, allow_nan=False) + "\n"


def write_text(path: str | None, text: str) -> None:
    """To a file, whose folder is made if need be; to the console without one."""
    if not path:
        print(text, end="")
        return
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, encoding="utf-8")


def write_metrics(rows: DataFrame, path: str) -> None:
    """Metric rows as lines of JSON."""
    rows.select("metric", "value", "tags").write.mode("append").json(path)


def write_metric_stream(rows: DataFrame, path: str, checkpoint: str):
    """Metric rows of a stream, each batch once."""
    return rows.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").start(path)
