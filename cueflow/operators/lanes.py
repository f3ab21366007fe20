"""Lane planning, byte ranges, frontier and progress roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.functions.names import fresh

# Bounds of a byte range, and the phases' weights.
CHUNK_MOST, CHUNK_LEAST = 4 << 20, 1 << 20


def lane_plans(df: DataFrame, duration: Column, lanes: Column, overlap: Column) -> DataFrame:
    """df with index, core_start, core_end, lanes, scan_start, scan_end, a row for each lane: equal cores, overlapped, clipped;
    1 to 16 lanes of two minutes or more. A row without a duration has no lanes."""
    long, n, over = fresh(df.columns, "duration", "lanes", "overlap")
    df = df.withColumn(long, duration.cast("double")).filter(F.col(long).isNotNull()).withColumn(over, overlap.cast("double"))
    most = F.least(lanes, F.lit(16), F.greatest(F.lit(1), F.floor(F.col(long) / 120)))
    df = df.withColumn(n, F.greatest(F.lit(1), most).cast("int"))
    df = df.withColumn("index", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    size = F.col(long) / F.col(n)
    df = df.withColumn("core_start", F.col("index") * size).withColumn("core_end", (F.col("index") + 1) * size).withColumn("lanes", F.col(n))
    df = df.withColumn("scan_start", F.greatest(F.lit(0.0), F.col("core_start") - F.col(over))).withColumn("scan_end", F.least(F.col(long), F.col("core_end") + F.col(over)))
    return df.drop(long, n, over)


def lane_plan(spark: SparkSession, duration: float, lanes: int, overlap: float) -> DataFrame:
    """The same for one duration."""
    return lane_plans(spark.range(1).select(), F.lit(float(duration)), F.lit(lanes), F.lit(float(overlap)))


def lane_observations(plan: DataFrame, fps: float, saved: Column | None = None) -> DataFrame:
    """plan with frame (from 0) and at: the media times that each lane looks at, from where it was left (clipped to its scan)."""
    from_ = F.greatest("scan_start", F.least("scan_end", F.coalesce(saved, F.col("scan_start")) if saved is not None else F.col("scan_start")))
    begin, frames = fresh(plan.columns, "begin", "frames")
    plan = plan.withColumn(begin, from_).withColumn(frames, F.floor((F.col("scan_end") + 0.001 - F.col(begin)) * fps))
    return plan.select(*plan.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col(frames))).alias("frame")).withColumn("at", F.col(begin) + F.col("frame") / fps).drop(begin, frames)


def byte_ranges(df: DataFrame, total: Column, connections: int) -> DataFrame:
    """df with seg, first, last (inclusive): the byte ranges of each row's total (> 0)."""
    size, chunk_ = fresh(df.columns, "total", "chunk")
    chunk = F.least(F.lit(CHUNK_MOST), F.greatest(F.lit(CHUNK_LEAST), F.ceil(total / connections))).cast("long")
    df = df.filter(total > 0).withColumn(size, total.cast("long")).withColumn(chunk_, chunk)
    df = df.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1, F.col(chunk_))).alias("seg", "first"))
    return df.withColumn("last", F.least(F.col("first") + F.col(chunk_), F.col(size)) - 1).drop(size, chunk_)


def _leading(lanes: DataFrame, keys: list, name: str) -> DataFrame:
    """lanes with 1 where all lanes before are completed."""
    w = Window.partitionBy(*keys).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return lanes.withColumn(name, F.coalesce(F.min(F.col("completed").cast("int")).over(w), F.lit(1)))


def frontier(lanes: DataFrame, keys: list) -> DataFrame:
    """keys, frontier: the end of the leading completed lanes, with the part done of the first that is not."""
    (before,) = fresh(lanes.columns, "before")
    done = F.when(F.col("completed"), F.col("core_end")).otherwise(F.greatest(F.col("core_start"), F.least(F.col("core_end"), F.col("media"))))
    return _leading(lanes, keys, before).filter(F.col(before) == 1).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(done)).alias("frontier"))


def pause_frontier(lanes: DataFrame, keys: list) -> DataFrame:
    """keys, frontier: the end of the last of the leading completed lanes; the least media time of all lanes where the first is not completed."""
    (before,) = fresh(lanes.columns, "before")
    leading = (F.col(before) == 1) & F.col("completed")
    return _leading(lanes, keys, before).groupBy(*keys).agg(F.coalesce(F.max_by(F.when(leading, F.col("core_end")), F.when(leading, F.col("index"))), F.min("media")).alias("frontier"))


def scan_summary(lanes: DataFrame, keys: list, elapsed: Column) -> DataFrame:
    """keys, lanes, completed, frames, images, media (seconds of cores looked at), speed (media a second of elapsed time)."""
    core = F.greatest(F.lit(0.0), F.least("core_end", "media") - F.col("core_start"))
    out = lanes.groupBy(*keys).agg(F.count("*").alias("lanes"), F.count_if("completed").alias("completed"), F.sum("frames").alias("frames"), F.sum("images").alias("images"), F.sum(core).alias("media"), F.max(elapsed).alias("elapsed"))
    return out.withColumn("speed", F.when(F.col("elapsed") > 0, F.col("media") / F.col("elapsed")).otherwise(0.0)).drop("elapsed")


def cube(df: DataFrame, keys: list[str], sums: list[str], distinct: dict[str, str]) -> DataFrame:
    """keys (null where all are taken together), level (bits of the keys taken together, the last key lowest), rows, sums, and
    for distinct (column -> name) the estimated numbers of different values. One pass makes the finest groups with sketches
    (HLL, 4,096 registers: within some 5 % nearly always, exact for a few); all coarser ones are made of them."""
    rows = "rows"
    fine = df.groupBy(*keys).agg(F.count("*").alias(rows), *[F.sum(c).alias(c) for c in sums], *[F.hll_sketch_agg(F.col(c), F.lit(12)).alias(n) for c, n in distinct.items()])
    out = fine.cube(*keys).agg(F.grouping_id().cast("long").alias("level"), F.sum(rows).alias(rows), *[F.sum(c).alias(c) for c in sums], *[F.hll_sketch_estimate(F.hll_union_agg(F.col(n))).alias(n) for n in distinct.values()])
    return out.select(*keys, "level", rows, *sums, *distinct.values())


def scan_progress(lanes: DataFrame, keys: list, duration: Column) -> DataFrame:
    """keys, percent: the share of the duration whose cores were looked at, at most 99.5."""
    core = F.greatest(F.lit(0.0), F.least("core_end", "media") - F.col("core_start"))
    out = lanes.groupBy(*keys).agg(F.sum(core).alias("media"), F.max(duration).alias("duration"))
    return out.withColumn("percent", F.when(F.col("duration") > 0, F.greatest(F.lit(0.0), F.least(F.lit(99.5), F.col("media") / F.col("duration") * 100))).otherwise(0.0)).drop("media", "duration")


def valid_cue(start: Column, end: Column, confidence: Column, text: Column) -> Column:
    """Finite numbers, a start of 0 or more, an end not before it, and a text."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(finite(start) & finite(end) & finite(confidence) & (start >= 0) & (end >= start) & text.isNotNull(), F.lit(False))


def valid_topology(lanes: DataFrame, keys: list, duration: Column, parallelism: Column) -> DataFrame:
    """keys, valid: 1 to 16 lanes as announced, numbered from 0, cores that follow each other over the whole duration, scans
    around the cores, and counters that can be (tolerance: 0.001 s)."""
    end, row = fresh(lanes.columns, "end", "row")
    w = Window.partitionBy(*keys).orderBy("index")
    near = lambda a, b: F.abs(a - b) <= 0.001
    c, fine = F.col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    lanes = lanes.withColumn(end, F.lag("core_end").over(w)).withColumn(row, F.row_number().over(w) - 1)
    ok = fine(c("core_start")) & fine(c("core_end")) & fine(c("scan_start")) & fine(c("scan_end")) & fine(c("media")) & (c("index") == c(row)) & (c("core_start") >= 0) & (c("core_end") > c("core_start")) & (c("core_end") <= duration + 0.001)
    ok = ok & (c("scan_start") >= 0) & (c("scan_start") <= c("core_start")) & (c("scan_end") >= c("core_end")) & (c("scan_end") <= duration + 0.001) & c("media").between(c("scan_start") - 0.001, c("scan_end") + 0.001)
    ok = ok & (c("frames") >= 0) & c("images").between(0, c("frames")) & (c(end).isNull() | near(c(end), c("core_start")))
    whole = lanes.groupBy(*keys).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("each"), F.count("*").alias("n"), F.max(parallelism).alias("told"), F.min("core_start").alias("a"), F.max("core_end").alias("b"), F.max(duration).alias("d"))
    valid = c("each") & (c("n") == c("told")) & c("told").between(1, 16) & (c("d") > 0) & near(c("a"), F.lit(0.0)) & near(c("b"), c("d"))
    return whole.select(*keys, F.coalesce(valid, F.lit(False)).alias("valid"))


def last_level(steps: DataFrame, keys: list, level: str, throughput: str, gain: float = 1.10) -> DataFrame:
    """keys, level: the last level before the first whose throughput is less than `gain` times that of the level before; a
    level without throughput (a failure) ends the series as well."""
    ok, all_ = fresh(steps.columns, "ok", "all")
    w = Window.partitionBy(*keys).orderBy(level)
    before = F.lag(throughput).over(w)
    enough = F.when(F.col(throughput).isNull(), F.lit(False)).when(before > 0, F.col(throughput) >= before * gain).otherwise(True)
    steps = steps.withColumn(ok, F.coalesce(enough, F.lit(True)).cast("int")).withColumn(all_, F.min(ok).over(w))
    return steps.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(all_) == 1, F.col(level))), F.lit(1)).alias(level))


PHASES = (("thumbnail", 5.0), ("video", 85.0), ("subtitle", 10.0))


def phase_spans(chosen: list[str], phases: tuple = PHASES) -> dict[str, tuple[float, float]]:
    """phase -> (start, span) in percent of the whole, the weights of the chosen ones taken to make 100."""
    total, at, out = sum(w for n, w in phases if n in chosen), 0.0, {}
    for name, weight in phases:
        if name in chosen:
            out[name] = (at, 100 * weight / total)
            at += 100 * weight / total
    return out


def weighted_progress(df: DataFrame, keys: list, phase: Column, percent: Column, phases: tuple = PHASES) -> DataFrame:
    """keys, percent of the whole: a key's phases are those that it has rows of, their weights taken to make 100; the latest
    of them that has begun counts with its share, those before it as done."""
    weight, place = F.lit(None).cast("double"), F.lit(None).cast("int")
    for i, (name, w) in enumerate(phases):
        weight, place = F.when(phase == name, w).otherwise(weight), F.when(phase == name, i).otherwise(place)
    known = df.select(*keys, place.alias("place"), weight.alias("weight"), percent.alias("done")).filter("place is not null").groupBy(*keys, "place", "weight").agg(F.max("done").alias("done"))
    before = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("start", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    reached = F.when(F.col("done") > 0, F.col("start") + F.col("weight") * F.least(F.lit(100.0), F.col("done")) / 100)
    return known.groupBy(*keys).agg((100 * F.coalesce(F.max(reached), F.lit(0.0)) / F.sum("weight")).alias("percent"))


def transport_rollup(df: DataFrame, keys: list, supported: Column, sums: list[str]) -> DataFrame:
    """all_supported (false without rows) and the sums."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(supported), F.lit(False)).alias("all_supported"), *[F.round(F.sum(c), 4).alias(c) for c in sums])


def share_of_max(df: DataFrame, value: str) -> DataFrame:
    """df with share = value / max(1, largest value): the maximum is one row, joined back."""
    (most,) = fresh(df.columns, "most")
    top = df.agg(F.greatest(F.lit(1.0), F.max(value)).alias(most))
    return df.crossJoin(F.broadcast(top)).withColumn("share", F.col(value) / F.col(most)).drop(most)
