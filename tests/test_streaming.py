import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions.register import register
from quillspark.operators.transcript import merge_turns
from quillspark.streaming import live, streams


def finish(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_documents(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([("a", "mail x@y.org"), ("b", "plain"), ("c", "gone")], "path string, text string")
    rows.write.parquet(str(src))
    stream = spark.readStream.schema("path string, text string").parquet(str(src))
    out = finish(streams.prepared_documents(streams.without_cancelled(stream, spark.createDataFrame([("c",)], "path string"))), "docs")
    assert {r.path: r.markdown for r in out.collect()} == {"a": "mail [REDACTED_EMAIL]", "b": "plain"}


def test_windows_and_sessions(spark):
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = finish(streams.windowed_counts(events), "windows", "complete")
    assert got.agg({"n": "sum"}).first()[0] == batch.count()
    points = events.selectExpr("user_id AS call", "event_type AS speaker", "ts")
    assert finish(streams.speaker_sessions(points), "sessions", "complete").agg({"n": "sum"}).first()[0] == batch.count()
    assert finish(streams.once_delivered(events, "ts", "event_id"), "once").count() == batch.count()


def test_turns_in_any_order_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    segs = []
    for c in range(4):
        t = 0.0
        for i in range(60):
            t += rng.choice([0.5, 1.5, 3.0, 4.0, 9.0])
            segs.append((c, i, t, None if i % 11 == 5 else t + rng.choice([0.2, 1.0, 5.0, -1.0]), rng.choice(["A", "A", " A", "B", None, ""]), rng.choice([f" w{i} ", f"w{i}", "", None])))
    schema = "call long, seq long, start double, end double, speaker string, text string"
    at = "timestamp_millis(cast(round(start * 1000) as bigint)) AS at"
    want = merge_turns(spark.createDataFrame(segs, schema).withColumnRenamed("call", "doc_id")).select("doc_id", "start", "end", "speaker", "text").collect()
    rng.shuffle(segs)
    files = [segs[:90], segs[90:150] + segs[:20], segs[150:], [(-1, 0, 1e6, 1e6, None, "")], [(-1, 1, 2e6, 2e6, None, "")]]  # some come twice; the last two only move the watermark
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).selectExpr("*", at)
    with streams.rocks(spark):
        q = streams.stream_turns(stream, late="1 hour").writeStream.format("memory").queryName("turns").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, spark.table("turns").collect())) == sorted(map(key, want)) and len(want) > 100


def test_one_step_for_all_forms(spark):
    register(spark)
    rows = [(1, 1, 0.0, 1.0, "", "a"), (1, 2, 1.0, 2.0, "", "b"), (1, 3, 2.0, None, "A", "c"), (1, 4, 2.5, 3.0, " A ", "d"), (1, 5, None, 9.0, "B", "e"), (1, 6, 4.0, 5.0, "B", " "), (2, 1, 5.0, 4.0, "A", "f")]
    df = spark.createDataFrame(rows, "doc_id long, seq long, start double, end double, speaker string, text string")
    df.createOrReplaceTempView("segs_")
    got = spark.sql("SELECT * FROM merge_turns(TABLE(SELECT * FROM segs_) PARTITION BY doc_id ORDER BY seq)").collect()
    want = merge_turns(df).drop("n_segments").select("doc_id", "seq", "start", "end", "speaker", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(want) == 5
    bad = spark.sql("SELECT * FROM zip_entries('x.zip', X'0102')").collect()
    assert len(bad) == 1 and bad[0].name is None and bad[0].skip.startswith("not an archive")


@pytest.fixture
def listing(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for i in range(12):
        (tmp_path / "files" / f"f{i}.{'exe' if i == 3 else 'txt' if i % 2 else 'html'}").write_text(f"text number {i}")
    rows = [(str(p), p.stat().st_size) for p in sorted((tmp_path / "files").iterdir())]
    return spark.createDataFrame(rows, "path string, n_bytes long")


def lines(batch):
    return [json.loads(r.value) for r in batch.events().orderBy("seq").collect()]


def test_a_batch_reports_as_it_goes(spark, listing, tmp_path):
    batch = live.LiveBatch(spark, str(tmp_path / "out"), waves=4, base_dir="/d").start(listing).wait(120)
    got = lines(batch)
    assert got[0] == {"event": "start", "total": 12, "base_dir": "/d"} and got[-1]["event"] == "summary"
    counts = [e["done"] for e in got if e["event"] == "progress"]
    assert counts == sorted(counts) and counts[-1] == 12 and len(counts) == 4
    status = {}
    for e in got:
        if e["event"] == "file":
            status.setdefault(e["path"], []).append(e["status"])
    assert len(status) == 12 and all(s[0] == "started" and len(s) == 2 for s in status.values())
    assert (got[-1]["converted"], got[-1]["failed"], got[-1]["skipped"]) == (11, 1, 0) and batch.exit_code == 1 and not batch.cancelled
    done = {r.path: r for r in batch.results().collect()}
    assert done[str(tmp_path / "files/f1.txt")].markdown.strip() == "text number 1" and len({r.output for r in done.values() if r.output}) == 11
    assert got[-1]["tokens"] == sum(r.tokens or 0 for r in done.values())


def slow_work(begun, go):
    real = live.convert_listed()

    def work(rows):
        begun.set()
        go.wait(60)
        return real(rows)

    return work


def test_cancelled_in_the_middle_and_gone_on(spark, listing, tmp_path):
    begun, go = threading.Event(), threading.Event()
    batch = live.LiveBatch(spark, str(tmp_path / "out"), slow_work(begun, go), waves=4).start(listing)
    assert begun.wait(60)
    batch.cancel()  # a wave is in flight
    go.set()
    batch.wait(60)
    n = batch.results().count()
    assert 0 < n < 12 and batch.cancelled and batch.exit_code == 130 and not batch.query.isActive
    got = lines(batch)
    assert sum(e["event"] == "file" and e["status"] != "started" for e in got) == n == batch.progress()[-1]["done"]  # in flight, finished, reported
    assert sum(e["event"] == "file" and e["status"] == "started" for e in got) == n and got[-1]["cancelled"]  # nothing else was begun
    again = live.LiveBatch(spark, str(tmp_path / "out"), waves=4).start(listing).wait(120)
    assert again.results().count() == 12 and again.progress()[-1]["done"] == 12 and not again.cancelled
    assert again.results().groupBy("path").count().filter("count > 1").count() == 0


def test_cancelled_at_once(spark, listing, tmp_path):
    @F.udf("string")
    def sleep(p):
        time.sleep(30)
        return p

    begun = threading.Event()

    def work(rows):
        begun.set()
        return rows.select(sleep("path").alias("path"), F.lit("done").alias("status"), F.lit(1).cast("long").alias("tokens"), F.lit(1).cast("long").alias("source_tokens"))

    batch = live.LiveBatch(spark, str(tmp_path / "out"), work, waves=2).start(listing)
    assert begun.wait(60)
    time.sleep(2)
    start = time.time()
    batch.cancel(now=True)
    batch.wait(30)
    assert time.time() - start < 15 and batch.cancelled and batch.exit_code == 130 and batch.progress() == []


def test_skips_before_with_and_after(spark, tmp_path):
    docs, commands = tmp_path / "docs", tmp_path / "commands"
    commands.mkdir()
    docs.mkdir()
    kinds = "path string, n_bytes long, output string"

    def deliver(name, *paths):
        spark.createDataFrame([(p, 1, f"{p}.md") for p in paths], kinds).coalesce(1).write.parquet(str(docs / name))

    def say(text):
        live.put_text(spark, str(commands / f"c{time.time_ns()}"), text)

    say('{"cmd": "skip", "file": "/d/./before"}\nnot json\n{"cmd": "stop"}\n{"cmd": "skip", "file": "/d/with"}\n')
    deliver("1", "/d/with", "/d/late", "/d/plain")
    stream = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(str(docs))
    with streams.rocks(spark):
        q = live.live_skips(stream, spark.readStream.schema("value string").text(str(commands))).writeStream.format("memory").queryName("skips").outputMode("append").trigger(processingTime="1 second").start()

    def until(n):
        end = time.time() + 90
        while spark.table("skips").count() < n and time.time() < end and q.isActive:
            time.sleep(0.5)

    until(3)
    say('{"cmd": "skip", "file": "/d/late"}\n')
    deliver("2", "/d/before", "/d/other")
    until(5)
    deliver("3", "/d/late")
    until(6)
    q.stop()
    got = [(r.path, r.status) for r in spark.table("skips").collect()]
    assert sorted(got) == sorted([("/d/with", "skipped"), ("/d/late", "ready"), ("/d/plain", "ready"), ("/d/before", "skipped"), ("/d/other", "ready"), ("/d/late", "skipped")])


def test_end_of_commands_ends_the_batch(spark, listing, tmp_path):
    begun, go, end = threading.Event(), threading.Event(), threading.Event()
    (tmp_path / "commands").mkdir()

    def said():
        yield json.dumps({"cmd": "skip", "file": str(tmp_path / "files/f1.txt")})
        end.wait(120)

    batch = live.LiveBatch(spark, str(tmp_path / "out"), slow_work(begun, go), waves=3, commands=str(tmp_path / "commands"))
    batch.watch(said())
    time.sleep(1)
    batch.start(listing)
    assert begun.wait(90)
    end.set()
    time.sleep(1)
    go.set()
    batch.wait(90)
    assert batch.cancelled and batch.commands_ended and batch.exit_code == 130 and not batch.query.isActive
    go.set()
    again = live.LiveBatch(spark, str(tmp_path / "out2"), waves=2, commands=str(tmp_path / "commands")).start(listing).wait(120)
    status = {r.path: r.status for r in again.results().collect()}
    assert len(status) == 12 and status[str(tmp_path / "files/f1.txt")] == "skipped" and again.summary()["skipped"] == 1 and again.exit_code == 1


def test_observed_streams_are_counted(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"{i}{j}", "some text") for j in range(4)], "path string, text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = streams.prepared_documents(stream).withColumn("source_tokens", F.lit(5).cast("long"))
    listener = live.BatchListener()
    spark.streams.addListener(listener)
    try:
        finish(live.observed(out), "observed")
        assert listener.ended.wait(30)
    finally:
        spark.streams.removeListener(listener)
    done = [json.loads(x)["done"] for x in listener.lines]
    assert done == [4, 8, 12] and listener.total["src_tokens"] == 60 and listener.total["converted"] == 12


class Handle:
    """A state that counts the messages that it is sent."""

    def __init__(self):
        self.timers, self.messages, self.list, self.value, self.map = set(), 0, [], None, {}

    def getListState(self, *_, **__):
        return self

    def getValueState(self, *_, **__):
        outer = self

        class Value:
            exists = lambda s: outer.value is not None
            get = lambda s: outer.value
            update = lambda s, v: setattr(outer, "value", v)
            clear = lambda s: setattr(outer, "value", None)

        return Value()

    def get(self):
        self.messages += 1
        return iter(self.list)

    def appendList(self, rows):
        self.messages += 1
        self.list += rows

    def put(self, rows):
        self.messages += 1
        self.list = list(rows)

    def clear(self):
        self.list = []

    def listTimers(self):
        self.messages += 1
        return iter(sorted(self.timers))

    def registerTimer(self, t):
        self.messages += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.messages += 1
        self.timers.discard(t)


def test_a_call_sends_few_messages_to_its_state():
    import pandas as pd

    n, handle = 1000, Handle()
    turns = streams.TurnsByTime(3.0)
    turns.init(handle)
    rows = pd.DataFrame({"seq": range(n), "start": [float(i) for i in range(n)], "end": [i + 0.5 for i in range(n)], "speaker": ["A"] * n, "text": ["w"] * n, "at": pd.to_datetime([i * 1000 for i in range(n)], unit="ms")})
    assert list(turns.handleInputRows((1,), iter([rows[::2], rows[1::2]]), None)) == [] and handle.timers == {0}
    clock = lambda t: type("T", (), {"getCurrentWatermarkInMs": lambda s: t})()
    out = list(turns.handleExpiredTimer((1,), clock(499_500), None))[0]
    assert not len(out) and handle.timers == {500_000} and len(handle.list) == 500
    out = list(turns.handleExpiredTimer((1,), clock(1 << 41), None))[0]
    assert out.values.tolist() == [[1, 0.0, n - 0.5, "A", " ".join(["w"] * n)]] and not handle.timers and not handle.list and handle.messages < 40


def test_files_are_skipped_by_groups_of_paths(spark):
    import pandas as pd

    class Map(dict):
        updateValue = lambda self, k, v: self.__setitem__(k, v)
        containsKey = lambda self, k: k in self
        exists = lambda self: bool(len(self))

    skip, state = live.SkipByCommand(1000), Map()
    skip.init(type("H", (), {"getMapState": lambda self, *_, **__: state})())
    rows = pd.DataFrame({"key": ["/a", "/b", "/b", "/c"], "path": ["/a", "/b", "//b", "/c"], "n_bytes": [1, 2, 0, 3], "output": ["a", None, None, "c"], "command": [False, False, True, False]})
    got = pd.concat(skip.handleInputRows((0,), iter([rows[:2], rows[2:]]), None))
    assert got[["path", "status"]].values.tolist() == [["/a", "ready"], ["/b", "skipped"], ["/c", "ready"]] and list(state) == [("/b",)]
