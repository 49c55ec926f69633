"""Checks of measured streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_validation(kind: Column, sample_rate: Column, channels: Column, samples: Column, duration_s: Column, expected_s: float) -> Column:
    """struct(is_valid, errors, playlist_structure, http_headers, audio_format, bitrate_consistent).

    No rate, no channels or no samples make a stream invalid. A duration over a second short or over five
    seconds long is told among the errors but does not. Bitrates always count as consistent, and the
    structure of a protocol as right for streams of that protocol.
    """
    problems = F.array_compact(
        F.array(
            F.when(F.coalesce(sample_rate, F.lit(0)) <= 0, "invalid sample rate"),
            F.when(F.coalesce(channels, F.lit(0)) <= 0, "invalid channel count"),
            F.when(F.coalesce(samples, F.lit(0)) == 0, "no audio data"),
        )
    )
    off = F.coalesce(duration_s, F.lit(0.0)) - expected_s
    late = F.when((off < -1) | (off > 5), F.format_string(f"unexpected audio duration: got %.1fs, expected {expected_s:.1f}s", F.coalesce(duration_s, F.lit(0.0))))
    fine = F.size(problems) == 0
    return F.struct(
        fine.alias("is_valid"),
        F.concat(problems, F.array_compact(F.array(late))).alias("errors"),
        (F.coalesce(kind, F.lit("")) == "hls").alias("playlist_structure"),
        (F.coalesce(kind, F.lit("")) == "icecast").alias("http_headers"),
        fine.alias("audio_format"),
        F.lit(True).alias("bitrate_consistent"),
    )
