"""State of keys with timers of event time: rows put back in order, windows of sound, silent streams.

Each operator here has a batch twin, which gives the same rows on the same input.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Timers and several states of a key need the RocksDB store; a provider that the session names is left alone."""
    if spark.conf.get(PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


_ZERO = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _ms(at: datetime.datetime) -> int:
    """Milliseconds since 1970, rounded up: a timer that has fired has the whole moment behind it."""
    return -(-((at.astimezone() - _ZERO) // datetime.timedelta(microseconds=1)) // 1000)


class _Timed(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, and are then handled in order of (time, order columns).

    At most one timer is set, at the first moment something is due. after is what remains of a key.
    """

    def __init__(self, schema: T.StructType, key: list[str], time: str, order: list[str], after: str):
        self.schema, self.key, self.time, self.order, self.after = schema, key, time, order, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.kept = handle.getValueState("kept", self.after)
        self.timer = handle.getValueState("timer", "at long")

    def place(self, row: Row) -> tuple:
        return tuple((row[c] is not None, row[c]) if row[c] is not None else (False,) for c in [self.time, *self.order])

    def due(self, kept: tuple | None, rows: list[Row]) -> int | None:
        """The moment in ms at which the key is to be looked at again."""
        return min((_ms(r[self.time]) for r in rows), default=None)

    def wake(self, at: int | None) -> None:
        set_ = self.timer.get()[0] if self.timer.exists() else None
        if at == set_:
            return
        if set_ is not None:
            self.handle.deleteTimer(set_)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [r for r in rows if r[self.time] is not None]
        if new:
            self.waiting.appendList([tuple(r) for r in new])
            kept = self.kept.get() if self.kept.exists() else None
            at = min(_ms(r[self.time]) for r in new)
            other = self.timer.get()[0] if self.timer.exists() else None
            at = min(x for x in (at, other, self.due(kept, [])) if x is not None)
            self.wake(at)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows = [Row(*self.schema.names)(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if _ms(r[self.time]) <= now), key=self.place)
        later = [r for r in rows if _ms(r[self.time]) > now]
        kept = tuple(self.kept.get()) if self.kept.exists() else None
        out, kept = self.handled(key, kept, ready, now)
        if later:
            self.waiting.put([tuple(r) for r in later])
        else:
            self.waiting.clear()
        if kept is None:
            self.kept.clear()
        else:
            self.kept.update(kept)
        self.wake(self.due(kept, later))
        return iter(out)

    def handled(self, key: Any, kept: tuple | None, rows: list[Row], now: int) -> tuple[list[Row], tuple | None]:
        raise NotImplementedError


class Changes(_Timed):
    """Rows whose value differs from the one before; what is kept is the last value and its time, until the stream has been silent."""

    def __init__(self, schema: T.StructType, key: list[str], time: str, order: list[str], value: str, keep_empty: bool, silent_s: float | None):
        super().__init__(schema, key, time, order, f"at long, value {schema[value].dataType.simpleString()}")
        self.value, self.keep_empty, self.silent = value, keep_empty, None if silent_s is None else int(silent_s * 1000)

    def due(self, kept: tuple | None, rows: list[Row]) -> int | None:
        ends = kept[0] + self.silent + 1 if kept is not None and self.silent is not None else None
        return min((x for x in (super().due(kept, rows), ends) if x is not None), default=None)

    def handled(self, key: Any, kept: tuple | None, rows: list[Row], now: int) -> tuple[list[Row], tuple | None]:
        out = []
        for r in rows:
            v, at = r[self.value], _ms(r[self.time])
            if not self.keep_empty and (v is None or str(v) == ""):
                continue
            if kept is None or v != kept[1] or self.silent is not None and at - kept[0] > self.silent:
                out.append(r)
            kept = (at, v)
        if kept is not None and self.silent is not None and now > kept[0] + self.silent:
            kept = None
        return out, kept


class Silences(_Timed):
    """A row for each time that a key has been silent for longer than it may; what is kept is when it was last heard, and whether that is told."""

    def __init__(self, schema: T.StructType, key: list[str], time: str, most_s: float, message: str):
        super().__init__(schema, key, time, [], "at long, told boolean")
        self.most, self.message = int(most_s * 1000), message

    def handleInitialState(self, key: Any, initialState: Row, timerValues) -> None:
        at = _ms(initialState["started"])
        self.kept.update((at, False))
        self.wake(at + self.most + 1)

    def due(self, kept: tuple | None, rows: list[Row]) -> int | None:
        ends = kept[0] + self.most + 1 if kept is not None and not kept[1] else None
        return min((x for x in (super().due(kept, rows), ends) if x is not None), default=None)

    def handled(self, key: Any, kept: tuple | None, rows: list[Row], now: int) -> tuple[list[Row], tuple | None]:
        out = []

        def silent(at: int) -> Row:
            return Row(*self.key, "since", "ts", "error")(*key, datetime.datetime.fromtimestamp(at / 1000), datetime.datetime.fromtimestamp((at + self.most) / 1000), self.message)

        for r in rows:
            at = _ms(r[self.time])
            if kept is not None and not kept[1] and at - kept[0] > self.most:
                out.append(silent(kept[0]))
            if kept is None or at > kept[0]:
                kept = (at, False)
        if kept is not None and not kept[1] and now - kept[0] > self.most:
            out.append(silent(kept[0]))
            kept = (kept[0], True)
        return out, kept


def follow(df: DataFrame, key: str, time: str, order: list[str], value: str, keep_empty: bool = True, late: str = "10 minutes", silent_s: float | None = None) -> DataFrame:
    """changes.changed() on a stream: rows whose value differs from the one before of the same key, ordered by time, then by order.

    Rows wait in the key's state until the watermark, late behind the youngest row of all keys, has passed them, so that
    what comes out of order within it gives the answer of the batch; later rows are dropped, and rows without a
    time, too. With silent_s a key that has been silent for longer is forgotten: its state is gone, and its next row is a first one.
    """
    with_store(df.sparkSession)
    rows = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    changes = Changes(rows.schema, [key], time, order, value, keep_empty, silent_s)
    return rows.groupBy(key).transformWithState(changes, rows.schema, "Append", "EventTime")


def silences(df: DataFrame, key: str, time: str, most_s: float, late: str = "10 minutes", expected: DataFrame | None = None) -> DataFrame:
    """(key, since, ts, error): a row for each time a key was silent for more than most_s, as soon as the watermark shows it.

    since is when it was last heard, ts when its deadline was over. expected: (key, started) of streams to be heard of, so that one that
    never says anything has its timeout, too. A key that is heard again may be silent again. Rows without a time don't count.
    """
    with_store(df.sparkSession)
    rows = df.select(key, F.col(time).cast("timestamp").alias(time)).withWatermark(time, late)
    kind = df.schema[key].dataType.simpleString()
    one = Silences(rows.schema, [key], time, most_s, f"timeout: no data for {most_s:g}s")
    started = None if expected is None else expected.select(key, F.col("started").cast("timestamp").alias("started")).groupBy(key)
    return rows.groupBy(key).transformWithState(one, f"{key} {kind}, since timestamp, ts timestamp, error string", "Append", "EventTime", initialState=started)


def silences_of(df: DataFrame, key: str, time: str, most_s: float, now, expected: DataFrame | None = None) -> DataFrame:
    """The batch twin of silences(), as of now (a column or a timestamp)."""
    rows = df.select(key, F.col(time).cast("timestamp").alias("since")).where("since is not null")
    if expected is not None:
        rows = rows.unionByName(expected.select(key, F.col("started").cast("timestamp").alias("since")))
    ms = lambda c: F.ceil(F.unix_micros(c).cast("decimal(20, 0)") / 1000).cast("long")
    now = now if hasattr(now, "cast") else F.lit(now)
    until = F.coalesce(F.lead("since").over(Window.partitionBy(key).orderBy("since")), now.cast("timestamp"))
    most = int(most_s * 1000)
    found = rows.withColumn("__until", until).where(ms(F.col("__until")) - ms(F.col("since")) > most)
    ends = F.timestamp_millis(ms(F.col("since")) + most)
    return found.select(key, F.timestamp_millis(ms(F.col("since"))).alias("since"), ends.alias("ts"), F.lit(f"timeout: no data for {most_s:g}s").alias("error"))


SOUND = "broadcast_key string, stream_name string, window long, first_sequence long, sample_rate int, channels int, pcm array<double>, error string"
_WINDOW = Row(*[c.split()[0] for c in SOUND.split(", ")])


class Windows(StatefulProcessor):
    """Sound of a stream, segment after segment, cut into windows of the same length; what is kept is the sound of the open window."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "window long, last long, first long, sample_rate int, channels int, pcm binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.open.get()) if self.open.exists() else (0, None, None, None, None, b"")
        window, last, first, rate, channels, data = state
        pcm = np.frombuffer(data, np.float64)
        for r in sorted(rows, key=lambda r: r["sequence"]):
            if last is not None and r["sequence"] <= last:
                continue
            wrong = r["error"]
            if wrong is None and last is not None and r["sequence"] != last + 1:
                wrong = f"failed to load audio: missing segments {last + 1} to {r['sequence'] - 1}"
            if wrong is None and rate is not None and len(pcm) and r["sample_rate"] != rate:
                wrong = f"failed to load audio: sample rate changed from {rate} to {r['sample_rate']}"
            if wrong is not None:
                # What was open can't be filled: it is told, and the next window begins with this segment's sound.
                yield _WINDOW(*key, window, first if first is not None else r["sequence"], rate, channels, None, wrong)
                window, first, pcm = window + 1, None, pcm[:0]
            last = r["sequence"]
            if r["pcm"] is None:
                continue
            rate, channels = r["sample_rate"], r["channels"]
            first = r["sequence"] if first is None else first
            pcm = np.concatenate([pcm, np.asarray(r["pcm"], np.float64)])
            n = max(1, round(self.seconds * rate))
            while len(pcm) >= n:
                yield _WINDOW(*key, window, first, rate, channels, pcm[:n].tolist(), None)
                window, pcm = window + 1, pcm[n:]
                first = r["sequence"] if len(pcm) else None
        self.open.update((window, last, first, rate, channels, pcm.tobytes()))


def sound_windows(segments: DataFrame, seconds: float) -> DataFrame:
    """broadcast_key, stream_name, window (from 0), first_sequence, sample_rate, channels, pcm, error: a stream of segments as windows of sound.

    A window is so many seconds of one stream, put together across segments and batches in order of sequence; the
    last one, while it isn't full, stays in the stream's state, at most one window and one segment. A segment
    that is missing, can't be decoded or has another rate ends the open window with an error. Segments that come twice count once.
    """
    with_store(segments.sparkSession)
    rows = segments.select("broadcast_key", "stream_name", "sequence", "sample_rate", "channels", "pcm", "error")
    return rows.groupBy("broadcast_key", "stream_name").transformWithState(Windows(seconds), SOUND, "Append", "None")


def as_streams(windows: DataFrame, streams: DataFrame) -> DataFrame:
    """Windows as stream measurements, each window of a broadcast one of its own (`{broadcast}@{window}`), for benchmark.run().

    streams: broadcast_key, stream_name, role, type and what else the catalogue says.
    """
    from lagloom.operators.validate import stream_validation

    rows = windows.select("broadcast_key", "stream_name", "window", "sample_rate", "channels", "pcm", F.col("error").alias("__error"))
    made = streams.drop("error", "pcm", "sample_rate", "channels").join(rows, ["broadcast_key", "stream_name"]).withColumnRenamed("__error", "error")
    made = made.withColumn("broadcast_key", F.concat("broadcast_key", F.lit("@"), F.col("window").cast("string"))).withColumn("duration_s", F.size("pcm") / F.col("sample_rate"))
    check = stream_validation(F.col("type"), F.col("sample_rate"), F.col("channels"), F.size("pcm"), F.col("duration_s"), 0.0)
    nothing = F.lit(None).cast("long")
    return made.withColumns({"validation": F.when(F.col("error").isNull(), check), "ttfb_ns": nothing, "total_ns": nothing}).drop("window")
