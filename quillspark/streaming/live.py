"""Batches that run while one watches: in waves, with counts as they go, files skipped by command, and an end on request.

A batch is a listing (path, n_bytes).  Its waves are the micro-batches of a query with a checkpoint, so a batch
that was cancelled or whose driver was lost goes on where it ended: a wave's results replace what the same wave
has left before.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.batch import named_outputs, normal_path
from ..plans.prepare import Options, prepare
from ..sources.scan import read_listed
from .streams import rocks

#: Counts of a wave: all, by status, and the sums of the summary.
COUNTS = ["done", "converted", "failed", "skipped", "tokens", "src_tokens", "out_comparable"]
RESULT = "path string, status string, output string, markdown string, tokens bigint, source_tokens bigint, unread_images int, error string"


def counts() -> list[Column]:
    """What is observed of results on their way to the sink."""
    done = F.col("status") == "done"
    known = done & (F.col("source_tokens") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    values = [F.count(F.lit(1)), F.count_if(done), F.count_if(F.col("status") == "error"), F.count_if(F.col("status") == "skipped"), total(F.when(done, F.col("tokens"))), total(F.when(known, F.col("source_tokens"))), total(F.when(known, F.col("tokens")))]
    return [v.alias(n) for n, v in zip(COUNTS, values)]


def observed(results: DataFrame, name: str = "batch") -> DataFrame:
    """results (status, tokens, source_tokens) of a stream, counted as they pass; ``BatchListener`` gets the counts."""
    return results.observe(name, *counts())


class BatchListener(StreamingQueryListener):
    """Progress of ``observed`` streams: ``lines`` are JSON lines with counts that only grow.  Add it with ``spark.streams.addListener``."""

    def __init__(self, name: str = "batch"):
        self.name, self.total, self.lines, self.ended = name, dict.fromkeys(COUNTS, 0), [], threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["done"]:
            self.total = {c: n + (row[c] or 0) for c, n in self.total.items()}
            self.lines.append(json.dumps({"event": "progress", **self.total}))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.set()


#: Paths are dealt into so many groups; a group's state says which of its paths are to be skipped.
GROUPS = 256


class SkipByCommand(StatefulProcessor):
    """Of each path whether it is to be skipped; it is kept for ``ttl_ms``."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.skip = handle.getMapState("skip", "key string", "skip boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        files = []
        for pdf in rows:
            for k in set(pdf["key"][pdf["command"]]):
                self.skip.updateValue((k,), (True,))
            files.append(pdf[~pdf["command"]])
        # a command that comes with its file counts for it, wherever the two stand
        some = self.skip.exists()
        for pdf in files:
            if len(pdf):
                status = ["skipped" if some and self.skip.containsKey((k,)) else "ready" for k in pdf["key"]]
                yield pd.DataFrame({"path": pdf["path"], "n_bytes": pdf["n_bytes"].astype("int64"), "output": pdf["output"], "status": status})

    def close(self):
        pass


def skip_commands(lines: DataFrame) -> DataFrame:
    """(path) of the lines (value) ``{"cmd": "skip", "file": ...}``; other lines say nothing."""
    said = F.from_json("value", "cmd string, file string")
    return lines.select(said.alias("x")).filter("x.cmd = 'skip' AND x.file <> ''").select(F.col("x.file").alias("path"))


def live_skips(listing: DataFrame, lines: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """A stream's files (path, n_bytes, output) with status ``ready``, or ``skipped`` where a stream of commands has named them.

    A command counts whether it comes before its file or with it; one that comes after its file is too late for it, but
    counts if the file comes again.  Only names go through the state, no contents.
    """
    none = lambda kind: F.lit(None).cast(kind)
    files = listing.select(normal_path(F.col("path")).alias("key"), "path", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), "output", F.lit(False).alias("command"))
    gone = skip_commands(lines).select(normal_path(F.col("path")).alias("key"), "path", F.lit(0).cast("long").alias("n_bytes"), none("string").alias("output"), F.lit(True).alias("command"))
    rows = files.union(gone).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    return rows.groupBy("group").transformWithStateInPandas(SkipByCommand(ttl_ms), "path string, n_bytes long, output string, status string", "append", "processingTime")


class Cancelled(Exception):
    pass


def convert_listed(options: Options = Options()) -> Callable[[DataFrame], DataFrame]:
    """(path, n_bytes, output, status) to results: files that are ready are read in tasks and converted, others stay as they are."""

    def work(rows: DataFrame) -> DataFrame:
        ready = rows.filter("status = 'ready'")
        made = prepare(read_listed(ready.select("path")), options, outputs=ready.select("path", "output"))
        rest = rows.filter("status <> 'ready'").select("path", "status")
        return made.unionByName(rest, allowMissingColumns=True)

    return work


class LiveBatch:
    """One batch under ``out``: its list, waves' results and checkpoint.

    work: (path, n_bytes, output, status) to results.  waves: how many parts the listing is dealt into; the next one
    is begun only when the one before has been written, and ``on_wave`` has been called with its number.  commands: a folder of text files with one command a line.
    """

    def __init__(self, spark: SparkSession, out: str, work: Callable[[DataFrame], DataFrame] | None = None, waves: int = 16, commands: str | None = None, base_dir: str = "", on_wave: Callable[[int], None] | None = None):
        self.spark, self.out, self.work, self.waves = spark, out.rstrip("/"), work or convert_listed(), waves
        self.commands, self.base_dir, self.on_wave = commands, base_dir, on_wave
        self.tag, self.total, self.query = f"batch-{uuid.uuid4().hex}", 0, None
        self._waves: dict[int, dict] = {}
        self._stop, self._finished, self.commands_ended = threading.Event(), threading.Event(), False

    # --- running ---

    def start(self, listing: DataFrame, manifest: DataFrame | None = None, existing: DataFrame | None = None) -> LiveBatch:
        """listing: (path, n_bytes), each path once.  A list that an earlier run has left under ``out`` is gone on with."""
        path = f"{self.out}/list"
        if not self._exists(f"{path}/_SUCCESS"):
            named = named_outputs(listing.select("path", "n_bytes"), manifest, existing)
            named.repartition(self.waves).write.mode("overwrite").parquet(path)
        listed = self.spark.read.parquet(path)
        self.total = listed.count()
        stream = self.spark.readStream.schema(listed.schema).option("maxFilesPerTrigger", 1).parquet(path)
        if self.commands:
            ready = live_skips(stream, self.spark.readStream.schema("value string").text(self.commands))
        else:
            ready = stream.select("path", F.col("n_bytes").cast("long").alias("n_bytes"), "output", F.lit("ready").alias("status"))
        writer = ready.writeStream.option("checkpointLocation", f"{self.out}/checkpoint").foreachBatch(self._wave)
        writer = writer.trigger(processingTime="1 second") if self.commands else writer.trigger(availableNow=True)
        for n, row in self._earlier().items():
            self._waves[n] = row
        self._finished.clear()
        if self._done() >= self.total:
            self._finished.set()
        with rocks(self.spark):
            self.query = writer.start()
        return self

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _earlier(self) -> dict[int, dict]:
        """Counts of waves that an earlier run has written."""
        if not self._exists(f"{self.out}/results"):
            return {}
        rows = self.results().groupBy("wave").agg(*counts()).collect()  # a row a wave
        return {r.wave: {c: r[c] for c in COUNTS} for r in rows}

    def _wave(self, rows: DataFrame, n: int) -> None:
        if self._stop.is_set():
            raise Cancelled("cancelled")  # nothing is begun, and the wave counts as not done
        sc = rows.sparkSession.sparkContext
        sc.addJobTag(self.tag)
        try:
            listed, size = Observation(), f"{self.out}/ready/wave={n}"
            rows.observe(listed, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(size)  # names go through the state once
            if not listed.get["n"]:
                return
            seen = Observation()
            done = self.work(self.spark.read.schema(rows.schema).parquet(size)).observe(seen, *counts())
            done.write.mode("overwrite").parquet(f"{self.out}/results/wave={n}")
            self._waves[n] = {c: seen.get[c] or 0 for c in COUNTS}
            if self.on_wave:
                self.on_wave(n)
        finally:
            sc.removeJobTag(self.tag)
        if self._done() >= self.total:
            self._finished.set()

    def _done(self) -> int:
        return sum(w["done"] for w in self._waves.values())

    def cancel(self, now: bool = False) -> None:
        """Begins no further wave; files in flight are finished and reported, or, ``now``, their jobs are stopped and the wave leaves nothing."""
        self._stop.set()
        if now:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def watch(self, lines: Iterable[str]) -> threading.Thread:
        """Takes commands from ``lines`` (as of standard input) into the folder of commands; their end ends the batch at once."""

        def follow():
            for line in lines:
                if line.strip().startswith("{"):
                    put_text(self.spark, f"{self.commands}/{uuid.uuid4().hex}", line.strip() + "\n")
            if not self._finished.is_set():
                self.commands_ended = True
                self.cancel(now=True)

        thread = threading.Thread(target=follow, daemon=True)
        thread.start()
        return thread

    def wait(self, timeout: float | None = None) -> LiveBatch:
        """Until all files are reported or the batch is cancelled; another failure is raised."""
        waited = 0.0
        try:
            while self.query.isActive and not self._finished.is_set() and (timeout is None or waited < timeout):
                self.query.awaitTermination(0.5)
                waited += 0.5
            if self._finished.is_set() and not self.commands:
                self.query.awaitTermination()  # the last wave is committed
            elif self.query.isActive:
                self.query.stop()
            if (e := self.query.exception()) is not None:
                raise e
        except Exception:
            if not self._stop.is_set():
                raise
        return self

    # --- reports ---

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set() and self._done() < self.total

    @property
    def exit_code(self) -> int:
        """130 if cancelled, 1 if a file failed, else 0."""
        return 130 if self.cancelled else int(any(w["failed"] for w in self._waves.values()))

    def results(self) -> DataFrame:
        """What has been written, with its wave."""
        if not self._exists(f"{self.out}/results"):
            return self.spark.createDataFrame([], f"{RESULT}, wave int")
        return self.spark.read.schema(f"{RESULT}, wave int").parquet(f"{self.out}/results")

    def progress(self) -> list[dict]:
        """The counts after each wave; they only grow, and end at the total if nothing was cancelled."""
        out, so_far = [], dict.fromkeys(COUNTS, 0)
        for n in sorted(self._waves):
            so_far = {c: so_far[c] + self._waves[n][c] for c in COUNTS}
            out.append({"event": "progress", "wave": n, "total": self.total, **so_far})
        return out

    def summary(self) -> dict:
        last = (self.progress() or [dict.fromkeys(COUNTS, 0)])[-1]
        sums = {c: last[c] for c in COUNTS if c != "done"}
        return {"event": "summary", **sums, "saved_vs_raw": max(0, sums["src_tokens"] - sums["out_comparable"]), "cancelled": self.cancelled}

    def events(self) -> DataFrame:
        """(seq, value): the batch's JSON lines.  Of each wave: the files that were begun, what came of each, and the counts so far."""
        spark, end = self.spark, 1 << 40
        line = lambda df, seq, **c: df.select(seq.alias("seq"), F.to_json(F.struct(*[v.alias(k) for k, v in c.items()])).alias("value"))
        own = [(0, json.dumps({"event": "start", "total": self.total, "base_dir": self.base_dir})), *[(4 * p["wave"] + 3, json.dumps({k: v for k, v in p.items() if k != "wave"})) for p in self.progress()], (end, json.dumps(self.summary()))]
        out = spark.createDataFrame(own, "seq long, value string")
        if self._exists(f"{self.out}/ready"):
            begun = spark.read.schema("path string, n_bytes long, output string, status string, wave int").parquet(f"{self.out}/ready").filter("status = 'ready'")
            out = out.union(line(begun, F.col("wave").cast("long") * 4 + 1, event=F.lit("file"), path=F.col("path"), status=F.lit("started"), total=F.lit(self.total)))
        if self._exists(f"{self.out}/results"):
            cols = {c: F.col(c) for c in ("path", "status", "output", "tokens", "source_tokens", "unread_images", "error")}
            out = out.union(line(self.results(), F.col("wave").cast("long") * 4 + 2, event=F.lit("file"), **cols))
        return out


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, to a hidden name and then moved, so that a stream sees it whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{at.getName()}")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(hidden, True)
    out.write(text.encode())
    out.close()
    system.rename(hidden, at)
