"""Policies and versions against literal cases; the streamed tracker against the batch one."""

import os
import time

import pytest
from pyspark.sql import functions as F

from cueflow.operators import policy
from cueflow.streaming import tracker

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["version_order", "lane_policy", "disk_preflight"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from cueflow.plans.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, D).collect()), key=repr) == sorted(want, key=repr)


def test_lanes_by_memory(spark):
    rows = spark.createDataFrame([(v,) for v in (3.0, 3.75, 6.0, 12.0, 24.0, 48.0)], "v double").select("v", policy.gpu_lanes(F.col("v")).alias("n"))
    assert [r["n"] for r in rows.orderBy("v").collect()] == [1, 2, 2, 4, 8, 16]
    one = spark.range(1).select(policy.probe_ceiling(F.lit("auto"), F.lit(16), F.lit(32 << 30), F.lit(3.75)).alias("c"), policy.disk_needed(F.lit((1 << 63) - 1)).alias("d")).first()
    assert one["c"] == 4 and one["d"] is None
    assert [r["overlap"] for r in policy.scan_modes(spark).orderBy("mode").collect()] == [12.0, 16.0, 24.0]


SCHEMA = "lane long, ord long, at double, text string, confidence double"


def _feed(spark, folder, parts, first=0):
    """Each part as one file, in order of its time."""
    os.makedirs(f"{folder}/in", exist_ok=True)
    for k, part in enumerate(parts, first):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/w{k}")
        (name,) = [x for x in os.listdir(f"{folder}/w{k}") if x.endswith(".parquet")]
        os.rename(f"{folder}/w{k}/{name}", f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (k + 1, k + 1))


def _stream(spark, folder, state, out, batches=None, **how):
    """Runs until all files are read, or is stopped after so many batches; returns the rows so far."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    writer = tracker.track_stream(stream, **how).writeStream.format("parquet").option("path", f"{folder}/{out}").option("checkpointLocation", f"{folder}/{state}")
    if batches is None:
        assert writer.trigger(availableNow=True).start().awaitTermination(180)
    else:
        run = writer.trigger(processingTime="0 seconds").start()
        for _ in range(600):
            if run.lastProgress and run.lastProgress["batchId"] >= batches:
                break
            time.sleep(0.1)
        run.stop()
    return spark.read.schema(tracker.CUES).parquet(f"{folder}/{out}")


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracker.ROCKS_DB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


TEXTS = ["abc", "abc", "abc", None, None, "xyz", "xyz", "xyz", "xyw", None, "abc", "abc", "abc"]
ROWS = [(lane, i, i / 4, t, 0.9) for lane in (1, 2) for i, t in enumerate(TEXTS[lane - 1 :])]
FAR = [(9, 0, 1000.0, "end", 0.9)]


def test_stream_is_the_batch(rocks, tmp_path):
    # rows come out of order; a lane far ahead moves the watermark
    _feed(rocks, tmp_path, (ROWS[::-2], ROWS[-2::-2], FAR))
    got = _stream(rocks, tmp_path, "state", "out").collect()
    want = tracker.track(rocks.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(want) > 2 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_goes_on_after_a_stop(rocks, tmp_path):
    """Stopped after two batches and started again from its folder; what the folder holds is a table meanwhile."""
    cut = [r for r in ROWS if r[2] < 1.6]
    rest = [r for r in ROWS if r[2] >= 1.6]
    parts = (cut, [(9, 0, 6.6, "far", 0.9)])  # the watermark: 1.6 s, after what is there and before what is to come
    _feed(rocks, tmp_path, parts)
    _stream(rocks, tmp_path, "state", "out", batches=2)
    states = tracker.lane_states(rocks, f"{tmp_path}/state")
    assert {r.lane: (r.last, r.waiting) for r in states.collect()}[1] == (1.5, 0)
    emitted = rocks.read.schema(tracker.CUES).parquet(f"{tmp_path}/out")
    plain = {}
    for lane in (1, 2):  # the tracker itself, over what was folded
        s, out = tracker.start_state(), []
        for _, _, at, text, conf in (r for r in cut if r[0] == lane):
            tracker.observe(s, at, text, conf, 4.0, 0.68, lambda t: t, out)
        plain[lane] = (len(out) + (s["active"] is not None), 1.5)
    assert {r.lane: (r.cues, r.frontier) for r in tracker.lane_summary(states, emitted).collect() if r.lane < 9} == plain
    _feed(rocks, tmp_path, (rest, FAR), first=2)
    got = _stream(rocks, tmp_path, "state", "out").filter("lane < 9").collect()
    want = tracker.track(rocks.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_from_checkpoint_rows(rocks, tmp_path):
    """A stream over the later rows with the earlier one's lanes as its initial state, against one over all rows."""
    cut, rest = [r for r in ROWS if r[2] < 0.4], [r for r in ROWS if r[2] >= 0.4]
    os.makedirs(f"{tmp_path}/a")
    _feed(rocks, f"{tmp_path}/a", (cut, [(9, 0, 5.3, "far", 0.9)]))
    first = _stream(rocks, f"{tmp_path}/a", "state", "out").filter("lane < 9").collect()
    states = tracker.lane_states(rocks, f"{tmp_path}/a/state").filter("lane < 9 and not pending and waiting = 0")
    initial = rocks.createDataFrame(states.drop("pending", "waiting").collect(), "lane long, start double, end double, text string, confidence double, last double")
    assert initial.filter("text is not null").count() == 2
    os.makedirs(f"{tmp_path}/b")
    _feed(rocks, f"{tmp_path}/b", (rest, FAR))
    second = _stream(rocks, f"{tmp_path}/b", "state", "out", initial=initial).collect()
    want = tracker.track(rocks.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(map(tuple, first + second)) == sorted(map(tuple, want)) and len(second) > 2


def test_sessions_of_a_stream(spark, tmp_path):
    """Rows within the delay, in any order: as from a table. Later ones are dropped and counted."""
    from cueflow.operators import ledger

    rows = [(k, t, 10 * t) for k in (1, 2) for t in (0, 3, 5, 40, 41, 100, 104)]
    late = [(1, 50, 7), (2, 51, 7)]
    schema = "k int, t long, b long"
    os.makedirs(f"{tmp_path}/in")
    for n, part in enumerate((rows[::2], rows[1::2], [(9, 1000, 0)], [(9, 2000, 0)], [(9, 2001, 0)], late, [(9, 5000, 0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/w{n}")
        (name,) = [x for x in os.listdir(f"{tmp_path}/w{n}") if x.endswith(".parquet")]
        os.rename(f"{tmp_path}/w{n}/{name}", f"{tmp_path}/in/{n}.parquet")
        os.utime(f"{tmp_path}/in/{n}.parquet", (n + 1, n + 1))
    of = lambda df, **how: ledger.session_rates(df, ["k"], F.timestamp_seconds("t"), F.col("b"), "10 seconds", **how)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = of(stream, delay="200 seconds").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    dropped = sum(o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"])
    want = of(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, spark.table("sessions").filter("k < 9").collect())) == sorted(map(tuple, want)) and len(want) == 6 and dropped == len(late)
