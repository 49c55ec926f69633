"""Time offset of long recordings, whose sound comes as rows of blocks, so that no recording is ever one row.

Blocks are (broadcast_key, stream_name, sample_rate, block, pcm): block n holds the samples from n * size on.
Correlations of two blocks are sums over what they share, so those of whole recordings are sums over
pairs of blocks, which Spark adds up by lag. What a task holds doesn't grow with the length of a recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.operators.alignment import HOP, TOGETHER, Lists, alike, as_lists, envelope_column, fine_lags, judged
from lagloom.operators.kept import once

#: Samples of a block, a multiple of the hop: six seconds at 44100 Hz.
SIZE = 1 << 18
#: Pairs whose sums a task adds up before it hands them on, or more if they have few lags.
HELD = 64

#: Blocks of a broadcast whose samples meet in one place, over six minutes at 44100 Hz.
STRETCH = 64

KEYS = ["broadcast_key", "alignment_name"]
SUMS = ["dot", "energy1", "energy2", "shared"]


def cut(sound: DataFrame, size: int = SIZE) -> DataFrame:
    """The blocks of sound (broadcast_key, stream_name, sample_rate, pcm); none without samples. For recordings that fit a row; see sources.sound_blocks for others."""
    blocks = F.sequence(F.lit(0), ((F.size("pcm") - 1) / size).cast("int"))
    kept = sound.where("size(pcm) > 0").select("broadcast_key", "stream_name", "sample_rate", "pcm", F.explode(blocks).alias("block"))
    return kept.select("broadcast_key", "stream_name", "sample_rate", "block", F.slice("pcm", F.col("block") * size + 1, F.lit(size)).alias("pcm"))


def block_envelopes(blocks: DataFrame, hop: int = HOP) -> DataFrame:
    """(broadcast_key, stream_name, sample_rate, block, envelope) of blocks; empty without a whole hop of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], envelope_column(batch.column(4), hop)], ["broadcast_key", "stream_name", "sample_rate", "block", "envelope"])

    made = blocks.select("broadcast_key", "stream_name", F.col("sample_rate").cast("int"), F.col("block").cast("long"), "pcm")
    return made.mapInArrow(run, "broadcast_key string, stream_name string, sample_rate int, block long, envelope array<double>")


def partial_rows(a: np.ndarray, b: np.ndarray, shift: int, most: int) -> tuple[int, np.ndarray]:
    """Of rows of two blocks, b beginning `shift` values after a: the first lag from -most to most at which they meet, and for each row and lag from there dot, energies and length of what they share."""
    (count, n), m = a.shape, b.shape[1]
    low, high = max(-most, shift - n + 1), min(most, shift + m - 1)
    if low > high:
        return 0, np.zeros((count, len(SUMS), 0))
    size = 1 << (n + m - 1).bit_length()
    lags = np.arange(low - shift, high - shift + 1)
    dot = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[:, lags]
    begin, end = np.maximum(0, -lags), np.minimum(n, m - lags)
    x, y = (np.pad(np.cumsum(v * v, 1), ((0, 0), (1, 0))) for v in (a, b))
    shared = np.broadcast_to((end - begin).astype(np.float64), dot.shape)
    return low, np.stack([dot, x[:, end] - x[:, begin], y[:, end + lags] - y[:, begin + lags], shared], axis=1)


def partial_sums(a: np.ndarray, b: np.ndarray, shift: int, most: int) -> tuple[int, np.ndarray]:
    """partial_rows() of a single row."""
    low, sums = partial_rows(a[None], b[None], shift, most)
    return low, sums[0]


def lag_sums(met: DataFrame, hops: int) -> DataFrame:
    """KEYS, lag and SUMS, of pairs of blocks (KEYS, most, apart, mean1, mean2, envelope1, envelope2). A task adds up its own pairs of blocks first."""

    def out(held: dict) -> pa.RecordBatch:
        keys, totals = list(held), list(held.values())
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([k[2] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *[as_lists([t[i] for t in totals]) for i in range(len(SUMS))]], [*KEYS, "most", *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        room = 0
        for batch in batches:
            pairs = list(zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True))
            most, apart, *means = (c.to_numpy() for c in batch.columns[2:6])
            x, y = Lists(batch.column(6)), Lists(batch.column(7))
            for own in alike(x.lengths, y.lengths, most, apart, values=(x.lengths + y.lengths + 2 * most + 1) * len(SUMS)):
                lags = 2 * int(most[own[0]]) + 1
                sides = [v.rows(own) - mean[own, None] for v, mean in zip((x, y), means, strict=True)]
                low, sums = partial_rows(*sides, int(apart[own[0]]) * hops, lags // 2)
                for i, part in zip(own, sums, strict=True):
                    total = held.get(pairs[i])
                    if total is None:
                        room += lags * len(SUMS)
                        if len(held) >= HELD and room > TOGETHER:
                            yield out(held)
                            held, room = {}, lags * len(SUMS)
                        total = held[pairs[i]] = np.zeros((len(SUMS), lags))
                    total[:, low + lags // 2 : low + lags // 2 + part.shape[1]] += part
        if held:
            yield out(held)

    lists = ", ".join(f"{s} array<double>" for s in SUMS)
    parts = met.select(*KEYS, "most", "apart", "mean1", "mean2", "envelope1", "envelope2").mapInArrow(run, f"broadcast_key string, alignment_name string, most long, {lists}")
    each = parts.select(*KEYS, "most", F.posexplode(F.arrays_zip(*SUMS)).alias("at", "s")).select(*KEYS, (F.col("at") - F.col("most")).alias("lag"), "s.*")
    return each.where("shared > 0").groupBy(*KEYS, "lag").agg(*[F.sum(s).alias(s) for s in SUMS])


def loudness(over: DataFrame, hops: int) -> DataFrame:
    """KEYS, stream1, stream2, rate, lag, confidence, block1 and loud: how loud both are where two blocks (.., apart, envelope1, envelope2) lie over each other at the lag."""
    named = [*KEYS, "stream1", "stream2", "rate", "lag", "confidence", "block1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, loud = Lists(batch.column(9)), Lists(batch.column(10)), np.zeros(batch.num_rows)
            moved = batch.column(5).to_numpy() - batch.column(8).to_numpy() * hops  # value i of the one lies over value i + moved of the other
            for own in alike(x.lengths, y.lengths, moved, values=x.lengths + y.lengths):
                by, n, m = int(moved[own[0]]), x.lengths[own[0]], y.lengths[own[0]]
                low, high = max(0, -by), min(n, m - by)
                if low < high:
                    loud[own] = (x.rows(own)[:, low:high] * y.rows(own)[:, low + by : high + by]).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(loud)], [*named, "loud"])

    kinds = "broadcast_key string, alignment_name string, stream1 string, stream2 string, rate int, lag long, confidence double, block1 long, loud double"
    return over.select(*named, "apart", "envelope1", "envelope2").mapInArrow(run, kinds)


def align_blocks(pairs: DataFrame, blocks: DataFrame, max_offset_s: float = 15.0, min_confidence: float = 0.4, hop: int = HOP, size: int = SIZE) -> DataFrame:
    """What alignment.align_streams gives, for pairs (broadcast_key, alignment_name, stream1, stream2) of streams that come as blocks.

    Envelopes are searched as a whole, up to max_offset_s either way; the last samples are then searched over the block of the
    first stream that is loudest on both sides. Rates are those of the first stream. A missing block, or one
    without samples, counts as not recorded; a pair of which a side has no sound has offset 0 and confidence 0.
    """
    if size % hop:
        raise ValueError("a block must be of whole hops")
    hops = size // hop
    # Samples are read twice: here, for envelopes, which are kept, and for the pieces of the fine search.
    made = once(block_envelopes(blocks, hop))
    shapes = made.where("size(envelope) > 0")
    rates = made.groupBy("broadcast_key", F.col("stream_name").alias("stream1")).agg(F.max("sample_rate").alias("rate"))
    total = lambda f: F.sum(F.aggregate("envelope", F.lit(0.0), f))
    streams = shapes.groupBy("broadcast_key", "stream_name").agg(total(lambda s, x: s + x).alias("loud"), total(lambda s, x: s + x * x).alias("energy"), F.sum(F.size("envelope")).alias("n"), F.max("block").alias("last"))
    mean = F.col("loud") / F.col("n")
    streams = streams.select("broadcast_key", "stream_name", mean.alias("mean"), "n", "last", F.greatest(F.lit(0.0), F.col("energy") - mean * F.col("loud")).alias("energy"))

    def side(df: DataFrame, which: int, **columns: str) -> DataFrame:
        return df.select("broadcast_key", F.col("stream_name").alias(f"stream{which}"), *[F.expr(c).alias(f"{k}{which}") for k, c in columns.items()])

    # Joined the same way at every size, with what is small for a key in memory: nothing is sorted, and shuffles grow as the tables do.
    hashed = lambda df: df.hint("shuffle_hash")
    known = hashed(pairs.select(*KEYS, "stream1", "stream2")).join(rates, ["broadcast_key", "stream1"]).where("rate > 0")
    for n in (1, 2):
        known = hashed(known).join(side(streams, n, mean="mean", n="n", last="last", energy="energy"), ["broadcast_key", f"stream{n}"])
    known = once(known.withColumn("most", F.floor(F.lit(max_offset_s) * F.col("rate") / hop) + 1))

    # Which blocks of the second stream a block of the first may meet; both are found by stream and block, so that no recording is one key.
    away = F.ceil(F.col("most") / hops)
    first = hashed(known.select(*KEYS, "stream1", "stream2", "most", "mean1", "mean2", "last2", away.alias("away"))).join(side(shapes, 1, block="block", envelope="envelope"), ["broadcast_key", "stream1"])
    asked = first.withColumn("block2", F.explode(F.filter(F.sequence(F.col("block1") - F.col("away"), F.col("block1") + F.col("away")), lambda n: n.between(0, F.col("last2")))))
    met = asked.withColumn("apart", F.col("block2") - F.col("block1")).join(hashed(side(shapes, 2, block="block", envelope="envelope")), ["broadcast_key", "stream2", "block2"])
    sums = lag_sums(met, hops)

    # Kept to nine digits, so that the order of sums doesn't decide between equal lags; of these the shortest counts, the positive one of two.
    scale = F.sqrt(F.greatest(F.col("s.energy1"), F.lit(0.0)) * F.greatest(F.col("s.energy2"), F.lit(0.0)))
    floor = F.sqrt(F.col("k.energy1") * F.col("k.energy2")) * 1e-9
    heard = (scale > floor) & (F.col("shared") >= F.least("n1", "n2", F.lit(8)))
    fit = F.when(heard, F.round(F.col("dot") / scale, 9)).otherwise(0.0)
    best = F.max(F.struct(fit.alias("confidence"), (-F.abs("lag")).alias("near"), F.col("lag").alias("lag"))).alias("top")
    limits = known.select(*KEYS, "n1", "n2", "energy1", "energy2")
    coarse = sums.alias("s").join(hashed(limits.alias("k")), KEYS).groupBy(*KEYS).agg(best)
    coarse = known.select(*KEYS, "stream1", "stream2", "rate").join(hashed(coarse), KEYS).select(*KEYS, "stream1", "stream2", "rate", F.col("top.lag").cast("long").alias("lag"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "top.confidence")).alias("confidence"))

    # The loudest block: at the lag found, a block of the first stream lies over one or two of the second.
    whole = F.floor(F.col("lag") / hops)
    over = hashed(coarse).join(side(shapes, 1, block="block", envelope="envelope"), ["broadcast_key", "stream1"]).withColumn("apart", F.explode(F.array(whole, whole + 1))).withColumn("block2", F.col("block1") + F.col("apart"))
    over = over.join(hashed(side(shapes, 2, block="block", envelope="envelope")), ["broadcast_key", "stream2", "block2"])
    loud = loudness(over, hops).groupBy(*KEYS, "stream1", "stream2", "rate", "lag", "confidence", "block1").agg(F.sum("loud").alias("loud"))
    chosen = loud.groupBy(*KEYS, "stream1", "stream2", "rate", "lag", "confidence").agg(F.max(F.struct(F.round("loud", 9).alias("loud"), (-F.col("block1")).alias("early"))).alias("top"))
    chosen = chosen.select(*KEYS, "stream1", "stream2", "rate", "lag", "confidence", (-F.col("top.early")).alias("at"))

    # The samples of that block, and those of the second stream around it, from up to three blocks.
    begin = F.greatest(F.lit(0), (F.col("at") * hops + F.col("lag") - 2) * hop)
    end = (F.col("at") * hops + F.col("lag") + hops + 2) * hop
    known = [F.col(c) for c in ("alignment_name", "rate", "lag", "confidence", "at")]
    wanted1 = F.array(F.struct(F.lit(1).alias("side"), F.col("stream1").alias("stream_name"), F.col("at").alias("block"), (F.col("at") * size).alias("begin"), ((F.col("at") + 1) * size).alias("end"), *known))
    wanted2 = F.transform(F.sequence(F.floor(begin / size), F.floor((end - 1) / size)), lambda b: F.struct(F.lit(2).alias("side"), F.col("stream2").alias("stream_name"), b.alias("block"), begin.alias("begin"), end.alias("end"), *known))
    wanted = chosen.where(end > 0).select("broadcast_key", F.explode(F.concat(wanted1, wanted2)).alias("w"))
    # Samples move once, dealt by stretches of a broadcast, whose copies are alike and so are small together. They are met as they come, by
    # what is wanted of the stretch, which is little: they are never sorted or held, however large the tables.
    stretch = lambda block: F.floor(block / STRETCH).alias("stretch")
    asked = wanted.groupBy("broadcast_key", stretch(F.col("w.block"))).agg(F.collect_list("w").alias("asked"))
    heard = blocks.select("broadcast_key", "stream_name", F.col("block").cast("long").alias("block"), "pcm").where("size(pcm) > 0").withColumn("stretch", stretch(F.col("block")))
    own = F.filter("asked", lambda w: (w["stream_name"] == F.col("stream_name")) & (w["block"] == F.col("block")))
    met = heard.join(hashed(asked), ["broadcast_key", "stretch"]).select("broadcast_key", "pcm", F.explode(own).alias("w")).select("broadcast_key", "pcm", "w.*")
    low = F.greatest(F.lit(0), F.col("begin") - F.col("block") * size)
    piece = F.slice("pcm", (low + 1).cast("int"), F.greatest(F.lit(0), F.least(F.lit(size), F.col("end") - F.col("block") * size) - low).cast("int"))
    pieces = met.select(*KEYS, "rate", "lag", "confidence", "at", F.struct("side", (F.col("block") * size + low - F.col("begin")).alias("to"), piece.alias("pcm")).alias("piece"))
    together = pieces.groupBy(*KEYS, "rate", "lag", "confidence", "at").agg(F.collect_list("piece").alias("pieces"))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, lag, confidence, at = (c.to_numpy() for c in batch.columns[2:6])
            own, (which, to, pcm) = batch.column(6).offsets.to_numpy(), batch.column(6).values.flatten()
            which, to, pcm = which.to_numpy(), to.to_numpy(), Lists(pcm)
            sides = ([], [])
            for first, last in zip(own[:-1], own[1:], strict=True):
                for k, whole in enumerate(sides, 1):
                    mine = [i for i in range(first, last) if which[i] == k]
                    whole.append(np.zeros(max((to[i] + pcm.lengths[i] for i in mine), default=0)))
                    for i in mine:
                        whole[-1][to[i] : to[i] + pcm.lengths[i]] = pcm.values[pcm.begins[i] : pcm.begins[i] + pcm.lengths[i]]
            offsets, sure = fine_lags(*(Lists(as_lists(x)) for x in sides), lag, confidence, at * hops, np.full(len(at), hops), rate, max_offset_s, hop)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(offsets), pa.array(sure)], [*KEYS, "temporal_offset", "offset_confidence"])

    found = together.select(*KEYS, "rate", "lag", "confidence", "at", "pieces").mapInArrow(refine, "broadcast_key string, alignment_name string, temporal_offset double, offset_confidence double")
    found = pairs.select(*KEYS).join(found, KEYS, "left").fillna(0.0, ["temporal_offset", "offset_confidence"])
    return judged(found, min_confidence)
