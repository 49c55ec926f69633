"""Scalar functions on numbers: rounding, clean-up, units, scores and bands.

NaN compares as false here, as in most languages: Spark alone takes it for the largest number,
so every comparison is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def real(x: Column) -> Column:
    return ~F.isnan(x)


def at_least(x: Column, low) -> Column:
    return real(x) & (x >= low)


def over(x: Column, low) -> Column:
    return real(x) & (x > low)


def below(x: Column, high) -> Column:
    return real(x) & (x < high)


def round_places(x: Column, places: int) -> Column:
    """x times a power of ten, rounded half away from zero, divided again; not a decimal rounding of x."""
    scale = float(10**places)
    y = x * scale
    whole = F.floor(F.abs(y)).cast("double")
    # Taking the part beyond the whole first: adding a half to the largest number below a half gives one.
    return F.when(F.isnan(y) | (F.abs(y) >= 2.0**52), y).otherwise(F.signum(y) * (whole + F.when(F.abs(y) - whole >= 0.5, 1.0).otherwise(0.0))) / scale


def finite(x: Column) -> Column:
    """x, or 0 where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == INFINITY), 0.0).otherwise(x)


def finite_array(xs: Column) -> Column:
    return F.transform(xs, finite)


def finite_map(xs: Column) -> Column:
    return F.transform_values(xs, lambda _, v: finite(v))


def seconds_to_ms(x: Column) -> Column:
    """Whole milliseconds, cut off towards zero."""
    return (x * 1000).cast("long")


def ns_to_ms(ns: Column) -> Column:
    return F.call_function("try_divide", ns - ns % 1_000_000, F.lit(1_000_000)).cast("long")


def kbps(bps: Column) -> Column:
    return ((bps - bps % 1000) / 1000).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


# Points of a stream's quality score over its base of 50, and the bands of ratings.
BITRATE_POINTS = [(320, 20), (192, 15), (128, 10), (96, 5)]
RATE_POINTS = [(48000, 15), (44100, 10), (22050, 5)]
CODEC_POINTS = {"flac": 15, "aac": 10, "ogg": 10, "opus": 10, "mp3": 5}
RATINGS = [(90, "Excellent"), (70, "Good"), (50, "Fair")]
HEALTH_BANDS = [(0.9, "excellent"), (0.7, "good"), (0.5, "fair")]


def steps(x: Column, points: list, otherwise):
    """The value of the first step that x reaches."""
    found = F.when(F.lit(False), F.lit(otherwise))
    for low, value in points:
        found = found.when(at_least(x.cast("double"), low), F.lit(value))
    return found.otherwise(F.lit(otherwise))


def quality_score(bitrate: Column, sample_rate: Column, codec: Column, has_audio: Column) -> Column:
    """0 to 100, from a stream's metadata and whether it gave audio."""
    codecs = F.when(F.lit(False), F.lit(0))
    for name, points in CODEC_POINTS.items():
        codecs = codecs.when(codec == name, F.lit(points))
    total = F.lit(50) + steps(bitrate, BITRATE_POINTS, 0) + steps(sample_rate, RATE_POINTS, 0) + codecs.otherwise(F.lit(0)) + F.when(has_audio, 10).otherwise(0)
    return F.least(F.lit(100), total).cast("double")


def rating(score: Column) -> Column:
    return steps(score, RATINGS, "Poor")


def buffer_band(health: Column) -> Column:
    return F.when(over(health, 0.8), "Excellent").when(over(health, 0.5), "Good").otherwise("Poor")


def health_band(score: Column) -> Column:
    return steps(score, HEALTH_BANDS, "poor")
