"""Time offset and likeness of two recordings.

Signals are short arrays of features at a low rate: an envelope of PCM, a hop of samples to a value.
Short lags are searched with Spark expressions; long ones with a Fourier transform in an
Arrow function, n log n for a pair. Fingerprints are vectors of log-band energies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.audio import cosine, correlation_at
from lagloom.functions.numbers import at_least

# The frames of a fingerprint, its frequencies, its coefficients, and what each kind of feature weighs.
WINDOW, HOP, LOW_HZ, HIGH_HZ, COEFFICIENTS = 1024, 256, 80.0, 8000.0, 12
WEIGHTS = {"mfcc": 0.50, "spectral": 0.25, "temporal": 0.15, "speech": 0.10}
#: Bins and frames of a median that tells tones from beats, and frames worked on at once.
MEDIAN, FRAMES = 17, 512
#: Values of spectra, and of what is made of them, for each sample: windows overlap.
SPECTRA = 4
#: Seconds of sound that the search for the last samples of an offset goes over.
FINE_S = 10
#: Values of recordings that are worked on at once.
TOGETHER = 1 << 17


def best_lag(a: Column, b: Column, most: int) -> Column:
    """struct(correlation, lag): the lag in samples, from -most to most, at which b moved back is most like a.

    Of equal correlations the shortest lag counts, the positive one of two. For short signals; see align().
    """
    tried = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda s: F.struct(correlation_at(a, b, s).alias("correlation"), (-F.abs(s)).alias("near"), s.alias("lag")))
    top = F.array_max(tried)
    return F.struct(top["correlation"].alias("correlation"), top["lag"].alias("lag"))


def envelope(pcm: np.ndarray, hop: int = HOP) -> np.ndarray:
    """Loudness of each hop of samples, along the last axis."""
    n = pcm.shape[-1] // hop
    return np.sqrt(np.square(np.nan_to_num(pcm[..., : n * hop].reshape(*pcm.shape[:-1], n, hop))).mean(-1))


def alike(*keys: np.ndarray, values: int = 1) -> Iterator[np.ndarray]:
    """Places of rows whose keys are all the same, as many at once as have TOGETHER values, or one."""
    if not len(keys[0]):
        return
    which = np.unique(np.stack(keys), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(which, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
        step = max(1, TOGETHER // max(1, int(values[own[0]]) if np.ndim(values) else values))
        for at in range(0, len(own), step):
            yield own[at : at + step]


class Lists:
    """A column of lists of numbers: how long each is, and rows of those that are of one length. Null counts as empty, what is null in a list as NaN."""

    def __init__(self, column: pa.Array):
        self.begins, there = column.offsets.to_numpy()[:-1], column.is_valid().to_numpy(zero_copy_only=False)
        self.lengths = np.where(there, np.diff(column.offsets.to_numpy()), 0)
        self.values = np.asarray(column.values, np.float64)

    def rows(self, places: np.ndarray) -> np.ndarray:
        return self.values[self.begins[places][:, None] + np.arange(self.lengths[places[0]])]


def correlate_rows(a: np.ndarray, b: np.ndarray, most: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the best lag of b behind a, from least (-most without) to most, and the normalised correlation there, over the overlap of each lag."""
    (count, n), m = a.shape, b.shape[1]
    low, high = max(-most if least is None else least, 1 - n), min(most, m - 1)
    if not n or not m or low > high:
        return np.zeros(count, np.int64), np.zeros(count)
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    lags = np.arange(low, high + 1)
    # So long that no lag that is asked for meets another one's products.
    least_size = max(high + n, m - low)
    power = (least_size - 1).bit_length()
    size = 3 << power - 2 if power > 1 and 3 << power - 2 >= least_size else 1 << power
    both = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[:, lags]
    left, right = (np.concatenate([np.zeros((count, 1)), np.cumsum(x * x, 1)], 1) for x in (a, b))
    begin, end = np.maximum(0, -lags), np.minimum(n, m - lags)
    scale = np.sqrt((left[:, end] - left[:, begin]) * (right[:, end + lags] - right[:, begin + lags]))
    floor = 1e-9 * (np.sqrt(left[:, -1:] * right[:, -1:]) + 1e-300)
    fit = np.where((scale > floor) & (end - begin >= min(n, m, 8)), both / np.maximum(scale, floor), 0.0)
    near = np.lexsort((-lags, np.abs(lags)))
    at = near[np.argmax(fit[:, near] >= fit.max(1, keepdims=True) - 1e-12, axis=1)]
    return lags[at], np.clip(fit[np.arange(count), at], -1, 1)


def correlate(a: np.ndarray, b: np.ndarray, most: int, least: int | None = None) -> tuple[int, float]:
    """correlate_rows() of a single row."""
    lag, fit = correlate_rows(a[None], b[None], most, least)
    return int(lag[0]), float(fit[0])


def coarse_lags(x: np.ndarray, y: np.ndarray, rate: int, max_offset_s: float, hop: int = HOP) -> tuple[np.ndarray, ...]:
    """Of rows of envelopes: lag in hops, confidence, and begin and length, in hops of the first, of the loudest stretch they share."""
    lag, confidence = correlate_rows(x, y, int(max_offset_s * rate / hop) + 1)
    begin, length = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for own in alike(lag):
        by = int(lag[own[0]])
        low, high = max(0, -by), min(x.shape[1], y.shape[1] - by)
        n = max(0, min(high - low, -(-FINE_S * rate // hop)))
        if n:
            loud = np.pad(np.cumsum(x[own, low:high] * y[own, low + by : high + by], 1), ((0, 0), (1, 0)))
            begin[own], length[own] = low + np.argmax(loud[:, n:] - loud[:, :-n], axis=1), n
    return lag, confidence, begin, length


def spans(lag, begin, length, hop: int = HOP) -> tuple:
    """First sample and number of samples of both sides for the fine search; the second with room for two hops more on each side."""
    first = np.maximum(0, (begin + lag - 2) * hop)
    return begin * hop, length * hop, first, (begin + lag + length + 2) * hop - first


def fine_lags(p: Lists, q: Lists, lag: np.ndarray, confidence: np.ndarray, begin: np.ndarray, length: np.ndarray, rate: np.ndarray, max_offset_s: float, hop: int = HOP) -> tuple[np.ndarray, np.ndarray]:
    """Offset in seconds and confidence, from the samples p and q of the spans; 0 where there is no rate."""
    start, _, first, _ = spans(lag, begin, length, hop)
    samples, confidence = lag * hop, confidence.copy()
    middle = start + samples - first  # where q would begin if the lag were right to the sample
    for own in alike(p.lengths, q.lengths, middle, values=p.lengths + q.lengths):
        at = int(middle[own[0]])
        fine, near = correlate_rows(np.nan_to_num(p.rows(own)), np.nan_to_num(q.rows(own)), at + 2 * hop, at - 2 * hop)
        sure = near > 0
        samples[own] = np.where(sure, first[own] + fine - start[own], samples[own])
        confidence[own] = np.where(sure, np.maximum(confidence[own], near), confidence[own])
    limit = np.floor(max_offset_s * rate).astype(np.int64)
    rated = rate > 0
    return np.where(rated, np.clip(samples, -limit, limit) / np.maximum(rate, 1), 0.0), np.where(rated, np.maximum(0.0, confidence), 0.0)


def judged(found: DataFrame, min_confidence: float) -> DataFrame:
    """found with is_valid and latency_seconds: the offset if the confidence suffices, else 0."""
    fine = at_least(F.col("offset_confidence"), min_confidence)
    return found.withColumns({"is_valid": fine, "latency_seconds": F.when(fine, F.col("temporal_offset")).otherwise(0.0)})


def align(pairs: DataFrame, max_offset_s: float = 15.0, min_confidence: float = 0.4, hop: int = HOP) -> DataFrame:
    """pairs (broadcast_key, alignment_name, pcm1, pcm2, sample_rate) to temporal_offset, offset_confidence, is_valid, latency_seconds.

    A first search goes over envelopes of one value a hop; a second one around the lag found, sample by
    sample, over the loudest stretch that both share. A positive offset means that the second stream is later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x, y, rate in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                if not x.is_valid or not y.is_valid or not rate:
                    made.append((0.0, 0.0))
                    continue
                a, b = (np.asarray(v.values, np.float64) for v in (x, y))
                coarse = coarse_lags(envelope(a, hop)[None], envelope(b, hop)[None], rate, max_offset_s, hop)
                i, n, j, m = (int(v[0]) for v in spans(coarse[0], *coarse[2:], hop))
                sides = [Lists(pa.array([v], pa.list_(pa.float64()))) for v in (a[i : i + n], b[j : j + m])]
                made.append([v[0] for v in fine_lags(*sides, *coarse, np.array([rate]), max_offset_s, hop)])
            offsets, sure = zip(*made, strict=True) if made else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(offsets, pa.float64()), pa.array(sure, pa.float64())], ["broadcast_key", "alignment_name", "temporal_offset", "offset_confidence"])

    found = pairs.select("broadcast_key", "alignment_name", "pcm1", "pcm2", "sample_rate").mapInArrow(run, "broadcast_key string, alignment_name string, temporal_offset double, offset_confidence double")
    return judged(found, min_confidence)


def as_lists(rows: list) -> pa.Array:
    """A column of lists from arrays; null where there is None."""
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in rows])
    none = np.array([x is None for x in rows] + [False], bool)
    there = [x for x in rows if x is not None]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=none), pa.array(np.concatenate([np.zeros(0), *there])))


def envelope_column(pcm: pa.Array, hop: int = HOP) -> pa.Array:
    """The envelope of each list of samples; empty without samples."""
    sound, made = Lists(pcm), [None] * len(pcm)
    for own in alike(sound.lengths, values=sound.lengths):
        for i, x in zip(own, envelope(sound.rows(own), hop), strict=True):
            made[i] = x
    return as_lists(made)


def envelopes(sound: DataFrame, hop: int = HOP) -> DataFrame:
    """(broadcast_key, stream_name, sample_rate, envelope) of sound (broadcast_key, stream_name, pcm, sample_rate); empty without samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), envelope_column(batch.column(2), hop)], ["broadcast_key", "stream_name", "sample_rate", "envelope"])

    return sound.select("broadcast_key", "stream_name", "pcm", F.col("sample_rate").cast("int")).mapInArrow(run, "broadcast_key string, stream_name string, sample_rate int, envelope array<double>")


def by_pair(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(broadcast_key, alignment_name, stream1, stream2, value1, value2) of pairs of which both streams have a row in values (broadcast_key, stream_name, value).

    values is read once. Everything of a broadcast meets in one place, as its pairs do.
    """
    sides = F.array(*[F.struct(F.col(f"stream{n}").alias("stream_name"), F.lit(n).alias("side"), "alignment_name") for n in (1, 2)])
    asked = pairs.select("broadcast_key", F.explode(sides).alias("s")).groupBy("broadcast_key").agg(F.collect_list("s").alias("asked"))
    own = F.filter("asked", lambda r: r["stream_name"] == F.col("stream_name"))
    met = values.join(asked, "broadcast_key").select("broadcast_key", "stream_name", "value", F.explode(own).alias("r")).select("broadcast_key", "r.alignment_name", "r.side", "stream_name", F.struct("value").alias("value"))
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c))).alias(c.replace("_name", "") + str(n))
    whole = met.groupBy("broadcast_key", "alignment_name").agg(side(1, "stream_name"), side(2, "stream_name"), side(1, "value"), side(2, "value")).where("value1 is not null and value2 is not null")
    return whole.select("broadcast_key", "alignment_name", "stream1", "stream2", F.col("value1.value").alias("value1"), F.col("value2.value").alias("value2"))


def align_streams(pairs: DataFrame, sound: DataFrame, max_offset_s: float = 15.0, min_confidence: float = 0.4, hop: int = HOP, made: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """What align() gives, for pairs (broadcast_key, alignment_name, stream1, stream2) of the streams of sound.

    Envelopes are made where the samples lie, once for each stream, and only they are joined to pairs. Of the samples only
    the spans of the fine search move on, after one shuffle of each stream. Rates are those of the first stream. made: their envelopes, if they are there already.
    tasks: into how many of them broadcasts are dealt; without, as many as the session shuffles to.
    """
    dealt = lambda df: df if tasks is None else df.repartition(tasks, "broadcast_key")
    loud = (envelopes(sound, hop) if made is None else made).select("broadcast_key", "stream_name", F.struct("sample_rate", "envelope").alias("value"))
    both = by_pair(dealt(pairs), loud).select("broadcast_key", "alignment_name", "stream1", "stream2", F.col("value1.envelope").alias("envelope1"), F.col("value2.envelope").alias("envelope2"), F.col("value1.sample_rate").alias("rate1"))
    names = ["broadcast_key", "alignment_name", "stream1", "stream2", "rate", "lag", "confidence", "begin", "length", "first1", "count1", "first2", "count2"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, x, y = batch.column(4).fill_null(0).to_numpy(), Lists(batch.column(5)), Lists(batch.column(6))
            found = [np.zeros(len(rates), kind) for kind in (np.int64, np.float64, np.int64, np.int64)]
            for own in alike(x.lengths, y.lengths, rates, values=x.lengths + y.lengths):
                if rates[own[0]]:
                    for column, values in zip(found, coarse_lags(x.rows(own), y.rows(own), int(rates[own[0]]), max_offset_s, hop), strict=True):
                        column[own] = values
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c) for c in (*found, *spans(found[0], *found[2:], hop))]], names)

    schema = "broadcast_key string, alignment_name string, stream1 string, stream2 string, rate int, lag long, confidence double, begin long, length long, first1 long, count1 long, first2 long, count2 long"
    coarse = both.select("broadcast_key", "alignment_name", "stream1", "stream2", F.col("rate1").alias("rate"), "envelope1", "envelope2").mapInArrow(search, schema)
    known = [F.col(c) for c in ("alignment_name", "rate", "lag", "confidence", "begin", "length")]
    sides = [F.struct(F.col(f"stream{n}").alias("stream_name"), F.lit(n).alias("side"), F.col(f"first{n}").alias("first"), F.col(f"count{n}").alias("count"), *known) for n in (1, 2)]
    # A stream is asked for by the pairs it is in, which are those of one broadcast: dealt by broadcasts, samples and the pieces cut from them stay in one place.
    asked = dealt(coarse.select("broadcast_key", F.explode(F.array(*sides)).alias("s"))).groupBy("broadcast_key").agg(F.collect_list("s").alias("asked"))
    own = F.filter("asked", lambda r: r["stream_name"] == F.col("stream_name"))
    # Cut outside of the lambda, where Spark need not make an object of every sample.
    met = sound.select("broadcast_key", "stream_name", "pcm").join(asked.hint("shuffle_hash"), "broadcast_key").select("broadcast_key", "pcm", F.explode(own).alias("r"))
    pieces = met.select("broadcast_key", "r.*", F.slice("pcm", (F.col("r.first") + 1).cast("int"), F.col("r.count").cast("int")).alias("piece"))
    keys = ["broadcast_key", "alignment_name"]
    whole = pieces.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == n, F.col("piece"))).alias(f"piece{n}") for n in (1, 2)], *[F.max(c).alias(c) for c in ("rate", "lag", "confidence", "begin", "length")])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, *known = (c.fill_null(0).to_numpy() for c in batch.columns[4:])
            offsets, sure = fine_lags(Lists(batch.column(2)), Lists(batch.column(3)), *known, rate, max_offset_s, hop)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(offsets), pa.array(sure)], [*keys, "temporal_offset", "offset_confidence"])

    ordered = whole.select(*keys, "piece1", "piece2", "rate", "lag", "confidence", "begin", "length")
    return judged(ordered.mapInArrow(refine, "broadcast_key string, alignment_name string, temporal_offset double, offset_confidence double"), min_confidence)


@lru_cache(16)
def _bands(rate: int, count: int = 26) -> np.ndarray:
    """Triangles over the frequencies of a window, evenly spaced by mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(LOW_HZ), mel(min(HIGH_HZ, rate / 2)), count + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / rate)
    up = (f[None, :] - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)[:, None]
    down = (edges[2:, None] - f[None, :]) / np.maximum(edges[2:] - edges[1:-1], 1e-9)[:, None]
    return np.maximum(0, np.minimum(up, down))


def _running_median(x: np.ndarray, width: int, axis: int) -> np.ndarray:
    """The median of each value's neighbourhood along an axis, edges repeated."""
    half = width // 2
    padded = np.pad(x, [(half, half) if a == axis % x.ndim else (0, 0) for a in range(x.ndim)], mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, width, axis=axis), axis=-1)


def harmonic_parts(power: np.ndarray) -> np.ndarray:
    """For each frame (row) of spectra the logarithms of what goes on in time, tones, against what goes through all frequencies, beats.

    Medians along time leave tones, medians along frequency leave beats; each bin is dealt between both by
    their squares.
    """
    tones, beats = _running_median(power, MEDIAN, -2), _running_median(power, MEDIAN, -1)
    share = np.square(tones) / (np.square(tones) + np.square(beats) + 1e-20)
    whole = power.sum(-1) + 1e-12
    return np.stack([(power * share).sum(-1) / whole, (power * (1 - share)).sum(-1) / whole], axis=-1)


@lru_cache(16)
def _pitch_classes(rate: int) -> np.ndarray:
    """Which of the twelve classes of pitch, from A on, a frequency of a window is of; what lies outside of the range is of none."""
    f = np.fft.rfftfreq(WINDOW, 1 / rate)
    heard = (f >= LOW_HZ) & (f <= HIGH_HZ)
    classes = np.zeros((len(f), 12))
    at = np.round(12 * np.log2(f[heard] / 440.0)).astype(int) % 12
    classes[np.flatnonzero(heard), at] = 1
    return classes


def features(pcm: np.ndarray, rate: int, speech: bool = True, harmonic: bool = False, chroma: bool = False) -> np.ndarray:
    """Means and deviations over frames, each kind of feature scaled by the root of its weight; of rows of samples, a row each.

    Kinds: cepstral coefficients, spectral shape and loudness always; zero crossings with speech, the shares of tones
    and of beats with harmonic, the classes of pitch with chroma. The weight of speech is dealt evenly among
    the kinds that are on beside the first three; what is off is 0, so that all fingerprints are of one length.
    """
    pcm = np.nan_to_num(np.asarray(pcm, np.float64))
    if pcm.shape[-1] < WINDOW or rate <= 0:
        pcm = np.pad(pcm, [(0, 0)] * (pcm.ndim - 1) + [(0, max(0, WINDOW - pcm.shape[-1]))])
    total = []
    bands, classes = _bands(max(rate, 1)), _pitch_classes(max(rate, 1))
    n, window = len(bands), np.hanning(WINDOW)
    cosines = np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(1, COEFFICIENTS + 1)[:, None])
    frames = np.lib.stride_tricks.sliding_window_view(pcm, WINDOW, axis=-1)[..., ::HOP, :]
    for at in range(0, frames.shape[-2], FRAMES):
        part = frames[..., at : at + FRAMES, :]
        power = np.square(np.abs(np.fft.rfft(part * window, axis=-1)))
        mel = np.log(power @ bands.T + 1e-10)
        f = np.arange(power.shape[-1]) / power.shape[-1]
        mass = power.sum(-1) + 1e-12
        centre = power @ f / mass
        spread = np.sqrt(np.maximum(power @ (f * f) / mass - centre**2, 0))
        loud = np.log(np.square(part).mean(-1) + 1e-10)
        cross = (np.diff(np.signbit(part), axis=-1) != 0).mean(-1) if speech else np.zeros(part.shape[:-1])
        parts = harmonic_parts(power) if harmonic else np.zeros((*part.shape[:-1], 2))
        pitch = power @ classes / mass[..., None] if chroma else np.zeros((*part.shape[:-1], 12))
        total.append(np.concatenate([mel @ cosines.T / n, np.stack([centre, spread, loud / 10, cross], axis=-1), parts, pitch], axis=-1))
    rows = np.concatenate(total, axis=-2)
    beside = WEIGHTS["speech"] / max(1, speech + harmonic + chroma)
    kinds = np.repeat([WEIGHTS["mfcc"], WEIGHTS["spectral"], WEIGHTS["temporal"], beside * speech, beside * harmonic, beside * chroma], [COEFFICIENTS, 2, 1, 1, 2, 12])
    return np.concatenate([rows.mean(-2) * np.sqrt(kinds), rows.std(-2) * np.sqrt(kinds)], axis=-1)


def fingerprint_column(pcm: pa.Array, rates: np.ndarray, *on: np.ndarray) -> pa.Array:
    """The fingerprint of each list of samples, of the kinds of features that are on; null without samples or rate."""
    sound, made = Lists(pcm), [None] * len(pcm)
    for own in alike(sound.lengths, rates, *on, values=sound.lengths * SPECTRA):
        if rates[own[0]] and sound.lengths[own[0]]:
            for i, x in zip(own, features(sound.rows(own), int(rates[own[0]]), *[bool(c[own[0]]) for c in on]), strict=True):
                made[i] = x
    return as_lists(made)


def _typed(streams: DataFrame) -> DataFrame:
    """What a fingerprint is made of: names, samples, rate, and which features count, as the content type's settings say; without a content type those of news."""
    from lagloom.operators.config import with_content_settings

    typed = streams if "content_type" in streams.columns else streams.withColumn("content_type", F.lit("news"))
    return with_content_settings(typed).select("broadcast_key", "stream_name", "pcm", F.col("sample_rate").cast("int"), "speech_features", "harmonic_features", "chroma_features")


def fingerprints(streams: DataFrame) -> DataFrame:
    """(broadcast_key, stream_name, fingerprint) of streams with pcm, sample_rate and, if there is one, content_type; null without samples.

    Which features count is what the content type's settings say; without a content type it is that of news.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [np.array([v or 0 for v in batch.column(c).to_pylist()], np.int64) for c in range(3, 7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fingerprint_column(batch.column(2), *numbers)], ["broadcast_key", "stream_name", "fingerprint"])

    return _typed(streams).mapInArrow(run, "broadcast_key string, stream_name string, fingerprint array<double>")


def shapes(streams: DataFrame, hop: int = HOP) -> DataFrame:
    """What envelopes() and fingerprints() give, in one row for each stream: samples are read once for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [np.array([v or 0 for v in batch.column(c).to_pylist()], np.int64) for c in range(3, 7)]
            made = [envelope_column(batch.column(2), hop), fingerprint_column(batch.column(2), *numbers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *made], ["broadcast_key", "stream_name", "sample_rate", "envelope", "fingerprint"])

    return _typed(streams).mapInArrow(run, "broadcast_key string, stream_name string, sample_rate int, envelope array<double>, fingerprint array<double>")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints; null if one is missing or flat."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def compare(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """pairs with fingerprint1 and fingerprint2 to overall_similarity, is_valid_match and error."""
    alike = likeness(F.col("fingerprint1"), F.col("fingerprint2"))
    return pairs.withColumn("overall_similarity", alike).withColumns(
        {"is_valid_match": F.coalesce(at_least(F.col("overall_similarity"), least), F.lit(False)), "error": F.when(F.col("overall_similarity").isNull(), "fingerprint comparison failed: nothing to compare")}
    )
