"""Jobs, transfers and logs as ordered rows: states, retries and counters by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions.names import fresh

# Least progress of an attempt, and the steps and bounds of the wait after it in milliseconds.
MEANINGFUL, WAIT, WAIT_MOST, WEAK_WAIT, WEAK_WAIT_MOST = 64 << 10, 100, 750, 250, 4000
FINAL = ("done", "error", "cancelled")


def attempts(df: DataFrame, keys: list, order: list[Column], gained: Column, remaining: Column, http_error: Column) -> DataFrame:
    """df with attempt (from 1), weak (failures without meaningful progress in a row), rotate (another route is due: on an
    HTTP error and on every second weak failure) and wait_ms."""
    strong, run = fresh(df.columns, "strong", "run")
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("attempt", F.row_number().over(w)).withColumn(strong, gained >= F.least(F.lit(MEANINGFUL), F.greatest(F.lit(1), remaining)))
    df = df.withColumn(run, F.count_if(strong).over(w))
    weak = F.count_if(~F.col(strong)).over(Window.partitionBy(*keys, run).orderBy(*order))
    df = df.withColumn("weak", weak).withColumn("rotate", http_error | ((F.col("weak") > 0) & (F.col("weak") % 2 == 0)))
    least = F.greatest(F.lit(1), F.col("weak"))
    wait = F.when(gained > 0, F.least(F.lit(WAIT_MOST), WAIT * F.col("attempt"))).otherwise(F.least(F.lit(WEAK_WAIT_MOST), WEAK_WAIT * least * least))
    return df.withColumn("wait_ms", wait.cast("long")).drop(strong, run)


def routes(df: DataFrame, keys: list, order: list[Column], rotate: Column, endpoints: Column) -> DataFrame:
    """df with endpoint (from 0), round (how often all were used up and asked for anew) and generation, after each row: a
    rotation goes to the next endpoint, after the last to the first of a new round; the generation counts rotations."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("generation", F.count_if(rotate).over(w))
    return df.withColumn("endpoint", (F.col("generation") % endpoints).cast("int")).withColumn("round", F.floor(F.col("generation") / endpoints).cast("long"))


def refetched(df: DataFrame, rounds: DataFrame, keys: list) -> DataFrame:
    """df (with generation, the rotations so far) with round, endpoint and stopped. rounds: keys, round (in order), format_id,
    size, endpoints (how many each fetch offered). Rotations use up a round's endpoints and then go to the next round, which
    must offer the same format (in any case) and, where both sizes are known (> 0), the same size as the one before; from the
    first that does not, all is stopped ("format", "size"), and where there is no further round as well ("rounds")."""
    w = Window.partitionBy(*keys).orderBy("round")
    start, place = fresh([*rounds.columns, *df.columns], "start", "place")
    before = lambda c: F.lag(c).over(w)
    why = F.when(F.lower(before("format_id")) != F.lower("format_id"), "format").when((before("size") > 0) & (F.col("size") > 0) & (before("size") != F.col("size")), "size")
    r = rounds.withColumn(start, F.sum("endpoints").over(w) - F.col("endpoints")).withColumn("stopped", why)
    r = r.withColumn("stopped", F.first("stopped", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("endpoints > 0")
    listed = r.select(*keys, "round", "stopped", start, F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("endpoints").cast("long"))).alias("endpoint", place))
    listed = listed.select(*keys, "round", "stopped", "endpoint", (F.col(start) + F.col("endpoint")).alias("generation"))
    out = df.join(listed, [*keys, "generation"], "left").withColumn("stopped", F.coalesce("stopped", F.when(F.col("round").isNull(), "rounds")))
    going = lambda c: F.when(F.col("stopped").isNull(), F.col(c)).alias(c)
    return out.select(*df.columns, going("round"), going("endpoint"), "stopped")


def job_states(df: DataFrame, keys: list, order: list[Column], status: Column, progress: Column, message: Column) -> DataFrame:
    """keys, status, progress, message, done: as of each job's last row; nothing counts after its first final status, a null
    status or message and a negative progress change nothing; progress is held between 0 and 100, and done is 100."""
    at, final, s, p, m = fresh(df.columns, "at", "final", "status", "progress", "message")
    df = df.select(*keys, F.struct(*order).alias(at), status.alias(s), progress.alias(p), message.alias(m))
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    live = df.withColumn(final, F.coalesce(F.max(F.col(s).isin(*FINAL)).over(w), F.lit(False))).filter(~F.col(final))
    last = lambda c, ok: F.max_by(c, F.when(ok, F.col(at)))
    out = live.groupBy(*keys).agg(last(s, F.col(s).isNotNull()).alias(s), last(p, F.col(p) >= 0).alias(p), last(m, F.col(m).isNotNull()).alias(m))
    held = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col(p), F.lit(0.0))))
    out = out.withColumn(s, F.coalesce(s, F.lit("queued")))
    return out.select(*keys, F.col(s).alias("status"), F.when(F.col(s) == "done", 100.0).otherwise(held).alias("progress"), F.col(m).alias("message"), F.col(s).isin(*FINAL).alias("done"))


def unfinished(jobs: DataFrame, kind: Column | None = None) -> DataFrame:
    """Jobs that are not done, of one kind if given."""
    open_ = ~F.col("done")
    return jobs.filter(open_ if kind is None else open_ & kind)


def rates(df: DataFrame, keys: list, order: list[Column], bytes_: Column, seconds: Column) -> DataFrame:
    """df with bytes_per_second of all so far, by the time passed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("bytes_per_second", F.when(seconds > 0, F.sum(bytes_).over(w) / seconds).otherwise(0.0))


def session_rates(df: DataFrame, keys: list, at: Column, bytes_: Column, gap: str, delay: str | None = None) -> DataFrame:
    """keys, begin, until, rows, bytes, bytes_per_second of each session: rows of a key that follow each other within the gap
    (until: its last row). Of a table or a stream; delay: how late rows of a stream may come before they are dropped (and
    counted in its progress, numRowsDroppedByWatermark). A session of one instant has no speed."""
    time, gained = fresh(df.columns, "time", "bytes")
    df = df.withColumn(time, at).withColumn(gained, bytes_)
    df = df.withWatermark(time, delay) if delay else df
    out = df.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("begin"), F.max(time).alias("until"), F.count("*").alias("rows"), F.sum(gained).alias("bytes"))
    seconds = (F.unix_micros("until") - F.unix_micros("begin")) / 1e6
    return out.select(*keys, "begin", "until", "rows", "bytes", F.when(seconds > 0, F.col("bytes") / seconds).alias("bytes_per_second"))


def peak(df: DataFrame, keys: list, order: list[Column], value: Column, name: str = "peak") -> DataFrame:
    """df with the largest value so far."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*keys).orderBy(*order)))


def errors(df: DataFrame, keys: list, level: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(level == "Error").alias("errors"))


def completed_parts(manifests: DataFrame, plan: DataFrame, files: DataFrame, keys: list) -> DataFrame:
    """The parts (keys, seg, length) of a plan that a manifest lists and whose file has the planned length: `manifests` holds
    (keys, version, total, chunk, completed), `plan` (keys, total, chunk, seg, length), `files` (keys, seg, file_length). A
    manifest of another version, total or chunk counts for nothing."""
    listed = manifests.select(*keys, "total", "chunk", F.explode(F.array_distinct("completed")).alias("seg"))
    right = files.withColumnRenamed("file_length", "length")
    return plan.join(listed, [*keys, "total", "chunk", "seg"], "left_semi").join(right, [*keys, "seg", "length"], "left_semi")


def best_of_two(first: tuple[Column, Column], second: tuple[Column, Column], low: float = 0.68) -> Column:
    """struct<text, confidence> of two readings (text, confidence): the second counts only where the first is unsure and it is surer."""
    better = F.coalesce((first[1] < low) & (second[1] > first[1]), F.lit(False))
    return F.when(better, F.struct(second[0].alias("text"), second[1].alias("confidence"))).otherwise(F.struct(first[0].alias("text"), first[1].alias("confidence")))


def frame_rollup(lines: DataFrame, keys: list, order: Column, text: Column, confidence: Column) -> DataFrame:
    """keys, text (lines that are not blank, in order), confidence (their mean, 0 without any), detected; a frame has a few lines."""
    line = F.struct(order.alias("o"), F.trim(text).alias("t"), F.coalesce(confidence, F.lit(0.0)).alias("c"))
    got = F.sort_array(F.collect_list(F.when(F.trim(text) != "", line)))
    out = lines.groupBy(*keys).agg(got.alias("got"))
    mean = F.when(F.size("got") > 0, F.aggregate("got", F.lit(0.0), lambda a, x: a + x["c"]) / F.size("got")).otherwise(0.0)
    return out.select(*keys, F.array_join(F.transform("got", lambda x: x["t"]), "\n").alias("text"), mean.alias("confidence"), (F.size("got") > 0).alias("detected"))


def bounding_box(points: Column) -> Column:
    """array [left, top, right, bottom] of an array<struct<x,y>>, rounded half to even; empty without points."""
    edge = lambda f, c: F.bround(f(F.transform(points, lambda p: p[c]))).cast("int")
    box = F.array(edge(F.array_min, "x"), edge(F.array_min, "y"), edge(F.array_max, "x"), edge(F.array_max, "y"))
    return F.when(F.size(points) > 0, box).otherwise(F.array().cast("array<int>"))
