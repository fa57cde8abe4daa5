"""The batch operators on streams: documents as they come, and speaker turns with state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.redact import redact
from ..functions.text import estimate_tokens
from ..functions.turns import add_segment


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def prepared_documents(docs: DataFrame, terms: str | None = None) -> DataFrame:
    """(path, text) of a stream, redacted and counted; each row as soon as it comes."""
    text = redact(F.col("text"), terms)
    return docs.select("path", F.lit("done").alias("status"), text.alias("markdown"), estimate_tokens(F.col("text")).alias("tokens_before"), estimate_tokens(text).alias("tokens"))


def timed(rows: DataFrame, at: str, late: str) -> DataFrame:
    """With a watermark; times without a zone are taken in the session's."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def once_delivered(docs: DataFrame, at: str, key: str = "path", late: str = "1 hour") -> DataFrame:
    """Rows that come again within the watermark are dropped."""
    return timed(docs, at, late).dropDuplicatesWithinWatermark([key])


def without_cancelled(docs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """A stream without the files of a table of cancelled ones, read anew with each micro-batch."""
    return docs.join(cancelled.select("path").distinct(), "path", "left_anti")


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window, closed by the watermark."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = timed(events, at, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def speaker_sessions(points: DataFrame, at: str = "ts", gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of each (call, speaker) by pauses between points in time; other speakers don't end them."""
    s = F.session_window(at, gap)
    out = timed(points, at, late).groupBy("call", "speaker", s.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("call", "speaker", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


TURN = "call long, start double, end double, speaker string, text string"
SEGMENT = "start double, end double, speaker string, text string, at long"


class TurnsByTime(StatefulProcessor):
    """Segments wait until the watermark has passed them, and are then joined in order; a turn ends when nothing can join it any more."""

    def __init__(self, max_gap: float):
        self.max_gap = max_gap

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"seq long, {SEGMENT}")  # as they came; each call of the state is a message, so a batch is one
        self.open = handle.getValueState("open", "start double, end double, speaker string, text string, until long")  # when its furthest end is, in ms

    def wake(self, at: int) -> None:
        """One timer a call: the earliest time at which something is to be done."""
        known = list(self.handle.listTimers())
        if not known or at < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        value, first = lambda x: None if x is None or x != x else x, None
        for pdf in rows:
            at = pdf["at"].astype("datetime64[ns]").astype("int64") // 1_000_000
            come = [(int(q), value(s), value(e), value(p), value(t), int(a)) for q, s, e, p, t, a in zip(pdf["seq"], pdf["start"], pdf["end"], pdf["speaker"], pdf["text"], at)]
            if come:
                self.waiting.appendList(come)
                first = min(r[5] for r in come) if first is None else min(first, *(r[5] for r in come))
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = {r[0]: tuple(r) for r in self.waiting.get()}  # the last of repeated ones
        due = sorted((r[5], r[0], *r[1:5]) for r in waiting.values() if r[5] <= now)
        rest = [r for r in waiting.values() if r[5] > now]
        held = self.open.get() if self.open.exists() else None
        had, until = held is not None, held[4] if held else 0
        held = tuple(held[:4]) if held else None
        for at, seq, start, end, speaker, text in due:
            before = held
            held, closed = add_segment(held, start, end, speaker, text, self.max_gap)
            if closed:
                out.append((key[0], *closed))
            if held is not before:
                ends = at + round(1000 * max(0.0, (end if end is not None else start or 0.0) - (start or 0.0)))
                until = ends if closed or before is None else max(until, ends)
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        last = until + round(1000 * self.max_gap)
        if held and last < now:
            out.append((key[0], *held))
            held = None
        if held:
            self.open.update((*held, until))
        elif had:
            self.open.clear()
        for t in self.handle.listTimers():
            if t <= now:
                self.handle.deleteTimer(t)
        todo = [r[5] for r in rest] + ([last + 1] if held else [])
        if todo:
            self.wake(min(todo))
        yield pd.DataFrame(out, columns=["call", "start", "end", "speaker", "text"])

    def close(self):
        pass


def stream_turns(segments: DataFrame, at: str = "at", late: str = "1 minute", max_gap: float = 3.0) -> DataFrame:
    """Turns of (call, seq, start, end, speaker, text) and the time ``at`` of each segment's start, as the batch form makes them, in whatever order segments come.

    Segments wait in the state until the watermark has passed them, so up to ``late`` they may come out of order; repeated
    ones (call, seq) count once.  An open turn is sent when the watermark shows that no segment can join it.  A call's segments
    must start in order of seq.  Start the query inside ``rocks``.
    """
    rows = timed(segments, at, late).select("call", "seq", "start", "end", "speaker", "text", F.col(at).alias("at"))
    return rows.groupBy("call").transformWithStateInPandas(TurnsByTime(max_gap), TURN, "append", "eventTime")
