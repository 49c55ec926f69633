"""Functions on arrays of samples, all of them Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_square(pcm: Column) -> Column:
    """The mean of the squares, without a root; 0 for no samples."""
    total = F.aggregate(pcm, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(F.try_divide(total, F.size(pcm).cast("double")), F.lit(0.0))


def is_silent(pcm: Column, level: float = 0.001) -> Column:
    """Whether no sample exceeds the level; NaN doesn't."""
    return F.forall(pcm, lambda x: F.isnan(x) | (F.abs(x.cast("double")) <= level))


def pcm16(pcm: Column) -> Column:
    """Samples held to -1..1 and turned into 16-bit integers, cut off towards zero; NaN gives 0."""
    return F.transform(pcm, lambda x: F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("smallint"))


def first_seconds(pcm: Column, seconds: float, rate: Column) -> Column:
    """The samples of the first seconds, whole samples only."""
    n = (F.lit(float(seconds)) * rate).cast("int")
    return F.when(F.size(pcm) > n, F.slice(pcm, F.lit(1), n)).otherwise(pcm)


def duration(pcm: Column, rate: Column, whole_seconds: bool = False) -> Column:
    """Seconds of samples; files from disk count whole seconds only."""
    seconds = F.try_divide(F.size(pcm).cast("double"), rate.cast("double"))
    return F.floor(seconds).cast("double") if whole_seconds else seconds


def overlap(a: Column, b: Column, lag: Column) -> Column:
    """struct(a, b): what the two have in common where b comes lag samples later (earlier if negative)."""
    skip_a, skip_b = F.greatest(F.lit(0), -lag), F.greatest(F.lit(0), lag)
    n = F.greatest(F.lit(0), F.least(F.size(a) - skip_a, F.size(b) - skip_b))
    return F.struct(F.slice(a, skip_a + 1, n).alias("a"), F.slice(b, skip_b + 1, n).alias("b"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of one length; null if one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def correlation_at(a: Column, b: Column, lag: Column) -> Column:
    """The normalised correlation of a with b moved back by lag samples; 0 without overlap or loudness."""
    both = overlap(a, b, lag)
    return F.coalesce(cosine(both["a"], both["b"]), F.lit(0.0))
