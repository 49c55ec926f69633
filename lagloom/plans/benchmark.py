"""A comparison run over all broadcasts at once: measurements in, lags, metrics and a document out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.operators import alignment, liveness, pairing, quality, stats
from lagloom.operators.config import RunSettings
from lagloom.operators.kept import once


#: Pairs of a task in which samples meet, where there are fewer tasks than cores take, and at most.
FEW, MANY = 512, 16384


class Results:
    """What a run tells, of its broadcasts, streams, alignments, comparisons and liveness."""

    def metrics(self) -> DataFrame:
        return liveness.metric_rows(liveness.pivot(self.liveness), self.broadcasts)

    def performance(self) -> DataFrame:
        compared = self.comparisons
        # Kept, as percentiles of large series ask for the values again and again.
        return stats.performance_metrics(once(stats.metric_values(self.broadcasts, self.streams, self.alignments, compared, self.liveness)))

    def quality(self) -> DataFrame:
        compared = self.comparisons
        return quality.quality_metrics(self.broadcasts, self.streams, self.alignments, compared)

    def reliability(self) -> DataFrame:
        return quality.reliability_metrics(self.broadcasts, self.streams)


@dataclass
class Run(Results):
    """A run whose tables are there already."""

    broadcasts: DataFrame
    streams: DataFrame
    alignments: DataFrame
    comparisons: DataFrame
    liveness: DataFrame


@dataclass
class Comparison(Results):
    """broadcasts and streams are plans. Alignments and comparisons are computed when they are first asked for, and once: all that a run tells is made of them.

    Comparisons that are asked for first, as by all that needs both, have envelopes and fingerprints made in one reading of the samples.
    """

    broadcasts: DataFrame
    streams: DataFrame
    pairs: DataFrame
    fine: DataFrame
    settings: RunSettings
    places: int
    hop: int

    @cached_property
    def kept_pairs(self) -> DataFrame:
        return once(self.pairs, "broadcast_key")  # met twice: by envelopes, and by what is found

    @cached_property
    def tasks(self) -> int:
        """Tasks in which pairs meet envelopes, samples and fingerprints: as many as their number asks for, whatever the session's number of shuffle partitions."""
        return pairing.tasks_for(self.kept_pairs, FEW, MANY)

    @cached_property
    def shapes(self) -> DataFrame:
        return once(alignment.shapes(self.fine, self.hop))

    @cached_property
    def alignments(self) -> DataFrame:
        sound = self.fine.select("broadcast_key", "stream_name", "pcm", "sample_rate")
        aligned = alignment.align_streams(self.kept_pairs, sound, self.settings.max_alignment_offset, self.settings.min_alignment_confidence, self.hop, self.__dict__.get("shapes"), self.tasks)
        return once(self.kept_pairs.join(aligned, ["broadcast_key", "alignment_name"]).withColumn("error", F.when(~F.col("is_valid"), "cannot truncate: alignment is not valid")), "broadcast_key")

    @cached_property
    def comparisons(self) -> DataFrame:
        if self.settings.skip_fingerprint_comparison:
            return self.pairs.where(F.lit(False)).select("broadcast_key", "alignment_name", F.lit(None).cast("double").alias("overall_similarity"), F.lit(False).alias("is_valid_match"), F.lit(None).cast("string").alias("error"))
        made = alignment.fingerprints(self.fine) if "alignments" in self.__dict__ else self.shapes
        prints = made.select("broadcast_key", "stream_name", F.col("fingerprint").alias("value"))
        both = alignment.by_pair(pairing.valid_alignments(self.alignments).repartition(self.tasks, "broadcast_key"), prints).withColumnsRenamed({"value1": "fingerprint1", "value2": "fingerprint2"})
        named = both.withColumn("alignment_name", F.concat("alignment_name", F.lit("_fingerprint")))
        return once(alignment.compare(named, self.settings.min_fingerprint_similarity).select("broadcast_key", "alignment_name", "overall_similarity", "is_valid_match", "error"), "broadcast_key")

    @cached_property
    def liveness(self) -> DataFrame:
        compared = self.comparisons
        return liveness.classify(pairing.with_fingerprints(self.alignments, compared), self.settings.min_fingerprint_similarity, self.places)


def run(broadcasts: DataFrame, streams: DataFrame, settings: RunSettings, places: int = 3, hop: int = alignment.HOP) -> Comparison:
    """broadcasts: broadcast_key, name, content_type, total_s, error. streams: stream_measurements with pcm.

    What a result doesn't need isn't computed. Pairs are joined to envelopes and fingerprints; samples are
    shuffled once, by broadcast, for the seconds that the fine search needs. hop: samples to a value of an envelope.
    """
    streams = pairing.within_deadline(pairing.measurable(streams), F.col("total_ns"), settings.operation_timeout, "a measurement")
    broadcasts = pairing.within_deadline(broadcasts, F.col("total_s") * 1e9, settings.benchmark_timeout, "a broadcast")
    fine = pairing.without_errors(streams)
    guarded = pairing.guard(broadcasts, streams)
    pairs = pairing.passing(pairing.pair_streams(fine), guarded)
    return Comparison(guarded.withColumn("health_score", F.lit(None).cast("double")), streams, pairs, fine, settings, places, hop)


def documents(r: Results, verbose: bool = False) -> DataFrame:
    """(broadcast_key, document): each broadcast's part of the result as JSON, without samples and fingerprints.

    NaN and infinity become 0. Verbose adds maps of streams, alignments and comparisons.
    """
    slots = list(liveness.COMPARISONS)
    wide = liveness.pivot(r.liveness).select("broadcast_key", F.struct(*slots).alias("liveness_metrics"))
    out = r.broadcasts.join(wide, "broadcast_key", "left")
    parts = [F.col("name").alias("broadcast_name"), "content_type", F.col("total_s").alias("total_benchmark_time_seconds"), "liveness_metrics", F.lit(None).cast("string").alias("overall_validation"), "error"]
    if verbose:
        fine = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)).alias(c)
        ms = lambda c: ((F.col(c) - F.col(c) % 1_000_000) / 1_000_000).cast("long")

        def mapped(df: DataFrame, key: str, name: str, *fields) -> DataFrame:
            return df.groupBy("broadcast_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.struct(*fields))))).alias(name))

        s = mapped(r.streams, "stream_name", "stream_measurements", F.struct("url", "type", "role", "content_type", "enabled").alias("endpoint"), ms("ttfb_ns").alias("time_to_first_byte"), ms("total_ns").alias("total_processing_time"), F.when(F.col("pcm").isNotNull(), F.col("duration_s")).alias("audio_duration_seconds"), F.col("validation").alias("stream_validation"), "error")
        a = mapped(r.alignments, "alignment_name", "alignment_measurements", fine("latency_seconds"), F.col("is_valid").alias("is_valid_alignment"), F.struct(fine("temporal_offset"), fine("offset_confidence")).alias("alignment_result"), "error")
        c = mapped(r.comparisons, "alignment_name", "fingerprint_comparisons", "is_valid_match", F.struct(fine("overall_similarity")).alias("similarity_result"), "error")
        out = out.join(s, "broadcast_key", "left").join(a, "broadcast_key", "left").join(c, "broadcast_key", "left")
        parts += ["stream_measurements", "alignment_measurements", "fingerprint_comparisons"]
    return out.select("broadcast_key", F.to_json(F.struct(*parts), {"ignoreNullFields": "true"}).alias("document"))
