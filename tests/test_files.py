"""Subtitle folders: written and read back, files chosen by source, nothing left of a job that failed."""

import os

import pytest
from pyspark.sql import functions as F

from cueflow.sources import files


@pytest.fixture()
def cues(spark):
    rows = [(s, i, i * 2.0, i * 2.0 + 1, f"line {i}\n<i>of {s}</i>" if i % 3 else " ") for s in ("a", "b.en", "ü c") for i in range(40)]
    return spark.createDataFrame(rows, "name string, i int, start double, end double, text string")


def test_folder_there_and_back(spark, cues, tmp_path):
    path = f"{tmp_path}/subs"
    files.write_folder(cues, path, "name", [F.col("i")], F.when(F.trim("text") != "", F.col("text")))
    assert sorted(os.listdir(path)) == ["a.srt", "b.en.srt", "ü c.srt"]
    with open(f"{path}/a.srt", encoding="utf-8") as f:
        assert f.read().startswith("1\n00:00:02,000 --> 00:00:03,000\nline 1\n<i>of a</i>\n\n2\n")
    want = sorted((s, float(i * 2), i * 2.0 + 1, f"line {i}\nof {s}") for s in ("a", "b.en", "ü c") for i in range(40) if i % 3)
    for most in (1, 1 << 20):
        back = files.read_folder(spark, path, partitionBytes=most)
        assert sorted(map(tuple, back.select("source_id", "start", "end", "text").collect())) == want
    assert spark.read.format("cues").option("partitionBytes", 1).load(path).rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="two files of one name"):
        files.write_folder(cues.filter("name = 'a'"), path, "name", [F.col("i")])
    files.write_folder(cues.filter("name = 'a' and i < 2"), path, "name", [F.col("i")], mode="overwrite")
    assert os.listdir(path) == ["a.srt"] and files.read_folder(spark, path).count() == 1


def test_filters_open_no_other_file(spark, cues, tmp_path):
    path = f"{tmp_path}/subs"
    files.write_folder(cues, path, "name", [F.col("i")])
    reader = files.CueReader({"path": path})
    left = list(reader.pushFilters([files.In(("source",), ("a", "zz")), files.EqualTo(("payload",), "x")]))
    assert len(left) == 1 and [p.paths for p in reader.partitions()] == [[f"{path}/a.srt"]]
    got = files.read_folder(spark, path, F.col("source") == "a")
    assert got.select("source_id").distinct().collect() == [("a",)] and got.count() == 26


def test_a_failed_job_leaves_nothing(spark, cues, tmp_path):
    path = f"{tmp_path}/subs"
    files.write_folder(cues.filter("name = 'a'"), path, "name", [F.col("i")])
    bad = cues.withColumn("text", F.when(F.col("i") == 39, F.raise_error(F.lit("no such cue"))).otherwise(F.col("text"))).filter("name <> 'a'")
    with pytest.raises(Exception, match="no such cue"):
        files.write_folder(bad, path, "name", [F.col("i")])
    assert os.listdir(path) == ["a.srt"]
    files.register(spark)
    torn = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "source string, block string").coalesce(1)
    with pytest.raises(Exception, match="together"):
        torn.write.format("cues").mode("append").save(path)
    assert os.listdir(path) == ["a.srt"]


def test_files_are_dealt_by_size():
    parts = files.deal([(f"f{i}", n) for i, n in enumerate([90 << 20, 1 << 20, 1 << 20, 30 << 20, 5])], 32 << 20)
    assert sorted(x for p in parts for x in p) == [f"f{i}" for i in range(5)] and ["f0"] in parts and len(parts) == 4
    assert files.deal([], 1) == []


def _append(path, first, lines, end=True):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{first:020d}.jsonl", "a", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n" * end)


def test_log_stream_delivers_once(spark, tmp_path):
    """Over restarts, files that grow, a cursor, and a line that is still being written."""
    from cueflow.sources import log

    path, out = f"{tmp_path}/log", f"{tmp_path}/out"

    def run(name="a", after=3):
        q = log.entries(spark, path, after, stream=True).writeStream.format("parquet").option("path", f"{out}-{name}").option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(map(tuple, spark.read.schema("sequence long, line string").parquet(f"{out}-{name}").collect()))

    _append(path, 1, [f"l{i}" for i in range(1, 6)])
    assert run() == [(4, "l4"), (5, "l5")]
    _append(path, 6, ["l6", "l7 ü", "l8 begun"], end=False)
    assert run() == [(4, "l4"), (5, "l5"), (6, "l6"), (7, "l7 ü")]
    with open(f"{path}/{6:020d}.jsonl", "a") as f:
        f.write(" and ended\n")
    _append(path, 9, ["l9"])
    assert run() == [(4, "l4"), (5, "l5"), (6, "l6"), (7, "l7 ü"), (8, "l8 begun and ended"), (9, "l9")] == run()
    assert run("b", after=8) == [(9, "l9")] and [tuple(r) for r in log.entries(spark, path, 8).collect()] == [(9, "l9")]
    assert log.entries(spark, f"{tmp_path}/none").count() == 0
    assert [(p.first, p.after, p.until) for p in log.LogStream({"path": path}).partitions({"sequence": 5}, {"sequence": 7})] == [(6, 5, 7)]
