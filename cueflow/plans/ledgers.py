"""Queries over scans, jobs, transfers, settings and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.functions import text as T
from cueflow.operators import lanes, ledger, policy, rank
from cueflow.plans.registry import LINES_SQL, order_lines, query, read
from cueflow.sources import media as M


def order_lanes(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as lanes of 100 seconds each: done where the status is F, looked at in part where it is O; the
    total price counts frames and the tenth of it pictures."""
    o = read(spark, d, "orders").withColumn("index", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    i, done = F.col("index"), F.col("o_orderstatus") == "F"
    media = F.when(done, (i + 1) * 100.0).when(F.col("o_orderstatus") == "O", i * 100.0 + 25).otherwise(i * 100.0 - 5)
    n = F.count("*").over(Window.partitionBy("o_custkey"))
    return o.select("o_custkey", "index", done.alias("completed"), (i * 100.0).alias("core_start"), ((i + 1) * 100.0).alias("core_end"), F.greatest(F.lit(0.0), i * 100.0 - 12).alias("scan_start"),
                    F.least(n * 100.0, (i + 1) * 100.0 + 12).alias("scan_end"), F.greatest(F.lit(0.0), media).alias("media"), F.floor("o_totalprice").cast("long").alias("frames"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("images"),
                    n.cast("int").alias("parallelism"), (n * 100.0).alias("duration"), "o_orderkey")


_LANES = """l0 AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderstatus AS st, floor(o_totalprice) AS frames, floor(o_totalprice / 10) AS images, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
l AS (SELECT *, i * 100.0 AS a, (i + 1) * 100.0 AS b, greatest(0, CASE st WHEN 'F' THEN (i + 1) * 100.0 WHEN 'O' THEN i * 100.0 + 25 ELSE i * 100.0 - 5 END) AS media, st = 'F' AS done FROM l0)"""


@query(f"""WITH {_LANES} SELECT o_custkey, count(*) AS lanes, count(*) FILTER (done) AS completed, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(images) AS BIGINT) AS images,
CAST(sum(greatest(0, least(b, media) - a)) AS DOUBLE) AS media, CAST(round(sum(greatest(0, least(b, media) - a)) / 40, 6) AS DOUBLE) AS speed FROM l GROUP BY 1""")
def scan_summary(spark, d):
    return lanes.scan_summary(order_lanes(spark, d), ["o_custkey"], F.lit(40.0)).withColumn("speed", F.round("speed", 6))


@query(f"WITH {_LANES} SELECT o_custkey, CAST(round(greatest(0, least(99.5, sum(greatest(0, least(b, media) - a)) / (max(n) * 100) * 100)), 6) AS DOUBLE) AS percent FROM l GROUP BY 1")
def scan_progress(spark, d):
    return lanes.scan_progress(order_lanes(spark, d), ["o_custkey"], F.col("duration")).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {_LANES}, p AS (SELECT *, coalesce(min(CAST(done AS INT)) OVER (PARTITION BY o_custkey ORDER BY i), 0) AS run FROM l)
SELECT o_custkey, CAST(coalesce(max(b) FILTER (run = 1), min(media)) AS DOUBLE) AS frontier FROM p GROUP BY 1""")
def pause_frontier(spark, d):
    return lanes.pause_frontier(order_lanes(spark, d), ["o_custkey"])


def checkpoint_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A customer's lanes as checkpoint JSON (an order each); a customer divisible by 9 announces one lane too many."""
    k = F.col("o_custkey")
    cue = lambda start, text: F.struct(start.alias("start"), (start + 1).alias("end"), text.alias("text"), F.lit(0.9).alias("conf"))
    one = F.struct("index", "core_start", "core_end", "scan_start", "scan_end", F.greatest("scan_start", "media").alias("media"), "frames", "images", "completed",
                   F.array(cue(F.col("core_start") + 1, F.col("o_orderkey").cast("string"))).alias("cues"), F.when(~F.col("completed"), cue(F.col("core_start") + 2, F.lit("open"))).alias("active"))
    groups = order_lanes(spark, d).groupBy("o_custkey").agg(F.max("parallelism").alias("n"), F.max("duration").alias("duration"), F.sort_array(F.collect_list(one)).alias("lanes"))
    return groups.select(k.alias("source_id"), F.to_json(F.struct(F.when(k % 9 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("parallelism"), "duration", "lanes")).alias("payload"))


@query("SELECT o_custkey AS source_id, count(*) <= 16 AND o_custkey % 9 <> 0 AS valid FROM orders GROUP BY 1")
def checkpoint_valid(spark, d):
    """Checkpoints whose lanes cover their duration as announced, 16 at most, with cues that can be."""
    rows = M.checkpoint_lanes(checkpoint_payloads(spark, d))
    cues = M.checkpoint_cues(rows).groupBy("source_id").agg(F.bool_and(lanes.valid_cue(F.col("start"), F.col("end"), F.col("conf"), F.col("text"))).alias("cues_valid"))
    shape = lanes.valid_topology(rows, ["source_id"], F.col("duration"), F.col("parallelism"))
    return shape.join(cues, "source_id", "left").select("source_id", (F.col("valid") & F.coalesce("cues_valid", F.lit(True))).alias("valid"))


@query(f"""WITH {_LANES}, c AS (SELECT o_custkey AS source_id, a + 1 AS "start", o_orderkey::VARCHAR AS text FROM l UNION ALL SELECT o_custkey, a + 2, 'open' FROM l WHERE NOT done),
t AS (SELECT source_id, "start", text, count(*) OVER (PARTITION BY source_id) AS cues FROM c)
SELECT source_id, CAST("start" AS DOUBLE) AS "start", text, cues FROM t QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY "start" DESC, text DESC) <= 12""")
def checkpoint_cues(spark, d):
    """The last twelve cues of each checkpoint, active ones included, beside their number."""
    rows = M.checkpoint_cues(M.checkpoint_lanes(checkpoint_payloads(spark, d)))
    rows = rows.withColumn("cues", F.count("*").over(Window.partitionBy("source_id")))
    return rank.last_n(rows, ["source_id"], [F.desc("start"), F.desc("text")], 12).select("source_id", "start", "text", "cues")


@query(f"""WITH {_LANES}, c AS (SELECT *, coalesce(min(CAST(done AS INT)) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM l),
f AS (SELECT o_custkey, max(CASE WHEN done THEN b ELSE greatest(a, least(b, media)) END) FILTER (before = 1) AS frontier, max(n) AS n FROM c GROUP BY 1)
SELECT o_custkey, CAST(round(least(100, frontier / (n * 100) * 100), 6) AS DOUBLE) AS percent FROM f""")
def checkpoint_percent(spark, d):
    rows = order_lanes(spark, d)
    whole = rows.groupBy("o_custkey").agg(F.max("duration").alias("duration"))
    done = lanes.frontier(rows, ["o_custkey"]).join(whole, "o_custkey")
    return done.select("o_custkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("frontier") / F.col("duration") * 100)), 6).alias("percent"))


@query("""WITH s AS (SELECT s_suppkey, (300 + s_suppkey * 37 % 3600)::DOUBLE AS d FROM supplier), n AS (SELECT *, greatest(1, least(8, floor(d / 120)))::BIGINT AS n FROM s),
l AS (SELECT s_suppkey, unnest(range(0, n)) AS i, d, d / n AS size FROM n), p AS (SELECT s_suppkey, i, greatest(0, i * size - 12) AS a, least(d, (i + 1) * size + 12) AS b FROM l)
SELECT s_suppkey, CAST(i AS INT) AS lane, CAST(floor((b + 0.001 - a) * 2.5) + 1 AS BIGINT) AS frames, round(a + floor((b + 0.001 - a) * 2.5) / 2.5, 6) AS "last" FROM p""")
def lane_frames(spark, d):
    """A supplier as a medium of some length: the media times that each of its lanes looks at."""
    media = read(spark, d, "supplier").select("s_suppkey", (F.lit(300) + F.col("s_suppkey") * 37 % 3600).alias("seconds"))
    seen = lanes.lane_observations(lanes.lane_plans(media, F.col("seconds"), F.lit(8), F.lit(12)), 2.5)
    return seen.groupBy("s_suppkey", F.col("index").alias("lane")).agg(F.count("*").alias("frames"), F.round(F.max("at"), 6).alias("last"))


@query("""WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CAST(floor(value * 1000) AS BIGINT) AS gained, event_type = 'error' AS bad FROM events),
s AS (SELECT *, gained >= 65536 AS strong, sum(CAST(gained >= 65536 AS INT)) OVER (PARTITION BY user_id ORDER BY attempt) AS run FROM t),
w AS (SELECT *, sum(CAST(NOT strong AS INT)) OVER (PARTITION BY user_id, run ORDER BY attempt) AS weak FROM s)
SELECT event_id, attempt, CAST(weak AS BIGINT) AS weak, bad OR (weak > 0 AND weak % 2 = 0) AS rotate, CAST(CASE WHEN gained > 0 THEN least(750, 100 * attempt) ELSE least(4000, 250 * greatest(1, weak) * greatest(1, weak)) END AS BIGINT) AS wait_ms FROM w""")
def attempt_policy(spark, d):
    """A user's events as attempts of a transfer: bytes gained, errors, and what follows from them."""
    e = read(spark, d, "events").withColumn("gained", F.floor(F.col("value") * 1000).cast("long"))
    out = ledger.attempts(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("gained"), F.lit(1 << 30), F.col("event_type") == "error")
    return out.select("event_id", F.col("attempt").cast("long").alias("attempt"), "weak", "rotate", "wait_ms")


@query("""WITH g AS (SELECT event_id, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, CAST(n AS BIGINT) AS generation, CAST(n % 3 AS INT) AS endpoint, CAST(n // 3 AS BIGINT) AS round FROM g""")
def route_rotation(spark, d):
    out = ledger.routes(read(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", F.lit(3))
    return out.select("event_id", "generation", "endpoint", "round")


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'view' THEN NULL ELSE event_type END AS st,
  CASE WHEN event_id % 4 = 0 THEN -1.0 ELSE value END AS p FROM events),
k AS (SELECT *, coalesce(max(CAST(coalesce(st IN ('error', 'done'), false) AS INT)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM e),
s AS (SELECT user_id, coalesce(max_by(st, i) FILTER (st IS NOT NULL), 'queued') AS status, coalesce(max_by(p, i) FILTER (p >= 0), 0) AS p, max_by(event_id, i) AS m FROM k WHERE over = 0 GROUP BY 1)
SELECT user_id, status, CASE WHEN status = 'done' THEN 100.0 ELSE round(greatest(0, least(100, p)), 6) END::DOUBLE AS progress, m::VARCHAR AS message, status IN ('done', 'error') AS done FROM s""")
def job_state(spark, d):
    """A user's events as a job: errors and purchases end it, views say nothing of its status, every fourth has no progress."""
    e = read(spark, d, "events")
    t = F.col("event_type")
    status = F.when(t == "error", "error").when(t == "purchase", "done").when(t != "view", t)
    out = ledger.job_states(e, ["user_id"], [F.col("ts"), F.col("event_id")], status, F.when(F.col("event_id") % 4 == 0, -1.0).otherwise(F.col("value")), F.col("event_id").cast("string"))
    return out.withColumn("progress", F.round("progress", 6))


@query("SELECT user_id FROM events GROUP BY 1 HAVING NOT bool_or(event_type IN ('error', 'purchase'))")
def jobs_unfinished(spark, d):
    t = F.col("event_type")
    jobs = ledger.job_states(read(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.when(t == "error", "error").when(t == "purchase", "done"), F.lit(0.0), t)
    return ledger.unfinished(jobs).select("user_id")


@query("""WITH p AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS i, CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 85 WHEN 'purchase' THEN 10 END AS w, max(least(100, value)) AS done FROM events GROUP BY ALL HAVING i IS NOT NULL),
s AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p)
SELECT user_id, round(100 * coalesce(max(CASE WHEN done > 0 THEN a + w * done / 100 END), 0) / sum(w), 6)::DOUBLE AS percent FROM s GROUP BY 1""")
def weighted_progress(spark, d):
    """A user's events as phases; the weights of those that there are make 100."""
    phase = F.when(F.col("event_type") == "view", "thumbnail").when(F.col("event_type") == "click", "video").when(F.col("event_type") == "purchase", "subtitle")
    out = lanes.weighted_progress(read(spark, d, "events"), ["user_id"], phase, F.col("value"))
    return out.select("user_id", F.round("percent", 6).alias("percent"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak, round(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) / (1.0 + event_id), 6)::DOUBLE AS bytes_per_second FROM events")
def transfer_gauges(spark, d):
    order = [F.col("ts"), F.col("event_id")]
    rows = ledger.peak(read(spark, d, "events"), ["user_id"], order, F.col("value"))
    out = ledger.rates(rows, ["user_id"], order, F.col("event_id"), 1.0 + F.col("event_id"))
    return out.select("event_id", "peak", F.round("bytes_per_second", 6).alias("bytes_per_second"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def error_count(spark, d):
    return ledger.errors(read(spark, d, "events"), ["user_id"], F.when(F.col("event_type") == "error", "Error").otherwise("Info"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no, count(*) OVER (PARTITION BY user_id) AS next_cursor FROM events QUALIFY no > least(5, next_cursor)")
def log_after_cursor(spark, d):
    out = rank.after_cursor(read(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.lit(5))
    return out.select("user_id", "event_id", F.col("no").cast("long").alias("no"), "next_cursor")


@query(f"""WITH t AS (SELECT l_orderkey, CAST(n AS INT) AS level, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity::DOUBLE END AS thr FROM {LINES_SQL}),
o AS (SELECT *, lag(thr) OVER (PARTITION BY l_orderkey ORDER BY level) AS prev FROM t),
g AS (SELECT *, min(CASE WHEN thr IS NULL THEN 0 WHEN prev > 0 AND thr < prev * 1.10 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY level) AS ok FROM o)
SELECT l_orderkey, coalesce(max(level) FILTER (ok = 1), 1) AS level FROM g GROUP BY 1""")
def probe_level(spark, d):
    """An order's lines as probes of rising levels; a line without discount failed."""
    l = order_lines(spark, d).select("l_orderkey", F.col("n").alias("level"), F.when(F.col("l_discount") != 0, F.col("l_quantity").cast("double")).alias("throughput"))
    return lanes.last_level(l, ["l_orderkey"], "level", "throughput")


@query(f"""SELECT l_orderkey, coalesce(string_agg(l_linestatus || n, chr(10) ORDER BY n) FILTER (l_returnflag <> 'N'), '') AS text, coalesce(round(avg(l_discount) FILTER (l_returnflag <> 'N'), 9), 0) AS confidence, bool_or(l_returnflag <> 'N') AS detected FROM {LINES_SQL} GROUP BY 1""")
def frame_rollup(spark, d):
    """An order's lines as the lines read in a frame; N lines are blank."""
    text = F.when(F.col("l_returnflag") == "N", " ").otherwise(F.concat("l_linestatus", F.col("n").cast("string")))
    out = ledger.frame_rollup(order_lines(spark, d), ["l_orderkey"], F.col("n"), text, F.col("l_discount"))
    return out.withColumn("confidence", F.round("confidence", 9))


@query("SELECT l_orderkey, CAST(round_even(min(l_quantity::DOUBLE) + 0.5, 0) AS INT) AS x0, CAST(round_even(min(l_tax::DOUBLE * 100), 0) AS INT) AS y0, CAST(round_even(max(l_quantity::DOUBLE) + 0.5, 0) AS INT) AS x1, CAST(round_even(max(l_tax::DOUBLE * 100), 0) AS INT) AS y1 FROM lineitem GROUP BY 1")
def frame_boxes(spark, d):
    point = F.struct((F.col("l_quantity").cast("double") + 0.5).alias("x"), (F.col("l_tax").cast("double") * 100).alias("y"))
    boxes = read(spark, d, "lineitem").groupBy("l_orderkey").agg(ledger.bounding_box(F.collect_list(point)).alias("b"))
    return boxes.select("l_orderkey", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("SELECT event_id, CASE WHEN value < 0.68 AND value * 1.1 > value THEN 'again' ELSE event_type END AS text FROM events")
def best_of_two(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", ledger.best_of_two((F.col("event_type"), v), (F.lit("again"), v * 1.1))["text"].alias("text"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """A line of an order as a rectangle, some of them not within the unit square."""
    dbl = lambda c: F.col(c).cast("double")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (dbl("l_quantity") / 100).alias("x"), dbl("l_discount").alias("y"), (1 - dbl("l_quantity") / 60).alias("w"), (F.lit(0.95) - dbl("l_tax")).alias("h"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 100 AS x, l_discount::DOUBLE AS y, 1 - l_quantity::DOUBLE / 60 AS w, 0.95::DOUBLE - l_tax::DOUBLE AS h FROM lineitem),
v AS (SELECT *, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x < 1 AND y < 1 AND x + w <= 1.000001 AND y + h <= 1.000001 AS ok, greatest(0, least(99, CAST(floor(x * 100) AS INT))) AS l, greatest(0, least(99, CAST(floor(y * 100) AS INT))) AS t FROM r),
c AS (SELECT *, greatest(1, least(100, greatest(l + 1, CAST(ceil((x + w) * 100) AS INT)))) AS rr, greatest(1, least(100, greatest(t + 1, CAST(ceil((y + h) * 100) AS INT)))) AS bb FROM v)
SELECT l_orderkey, l_linenumber, ok AS valid, CASE WHEN ok THEN l::VARCHAR || ' ' || t || ' ' || (rr - l) || ' ' || (bb - t) END AS percents FROM c""")
def region_canonical(spark, d):
    """Rectangles that are valid, in whole percents."""
    at = (F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    c = policy.canonical_region(*at)
    whole = F.concat_ws(" ", *[F.round(c[k] * 100).cast("int").cast("string") for k in "xywh"])
    return regions(spark, d).select("l_orderkey", "l_linenumber", policy.valid_region(*at).alias("valid"), F.when(c.isNotNull(), whole).alias("percents"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 100 AS x, l_discount::DOUBLE AS y, 1 - l_quantity::DOUBLE / 60 AS w, 0.95::DOUBLE - l_tax::DOUBLE AS h FROM lineitem),
p AS (SELECT *, CAST(trunc(x * 1920) AS INT) AS px, CAST(trunc(y * 1080) AS INT) AS py FROM r),
q AS (SELECT *, CAST(trunc(least(1, x + w) * 1920) AS INT) - px AS pw, CAST(trunc(least(1, y + h) * 1080) AS INT) - py AS ph FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x < 1 AND y < 1 AND pw >= 2 AND ph >= 2 THEN px::VARCHAR || ' ' || py || ' ' || pw || ' ' || ph END AS pixels FROM q""")
def region_pixels(spark, d):
    p = policy.pixel_region(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1920), F.lit(1080))
    return regions(spark, d).select("l_orderkey", "l_linenumber", F.when(p.isNotNull(), F.concat_ws(" ", *[p[k].cast("string") for k in "xywh"])).alias("pixels"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN least(30, p_size + 5) > p_size THEN printf('between(t,%.3f,%.3f)', p_size::DOUBLE, least(30.0, p_size + 5.0)::DOUBLE) END AS guard FROM part")
def time_guard(spark, d):
    n = F.col("p_size").cast("double")
    return read(spark, d, "part").select("p_partkey", policy.time_guard(n, n + 5, F.lit(30.0), F.col("p_size") % 5 == 0).alias("guard"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'light' ELSE 'dark' END AS theme, CASE c_nationkey % 3 WHEN 0 THEN 'txt' ELSE 'srt' END AS subtitle_format, CASE c_nationkey % 3 WHEN 1 THEN 'gpu' ELSE 'auto' END AS ocr_device,
CASE WHEN c_nationkey > 0 THEN CAST(c_nationkey AS INT) ELSE 65 END AS ocr_top, CAST(c_nationkey AS INT) AS ocr_left FROM customer""")
def settings_normal(spark, d):
    n = F.col("c_nationkey").cast("int")
    raw = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "light").otherwise("Light").alias("theme"), F.when(n % 3 == 0, "txt").when(n % 3 == 1, "TXT").alias("subtitle_format"), F.when(n % 3 == 1, " GPU ").otherwise("tpu").alias("ocr_device"), n.alias("ocr_top"), n.alias("ocr_left"))
    return policy.normal_settings(raw)


@query("SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 16 ELSE 8 END AS shown, CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 4 END AS used, CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 3 END AS video FROM customer")
def connection_plan(spark, d):
    n = F.col("c_nationkey") % 4
    c = policy.connections(F.when(n == 0, " Stable").when(n == 1, "TURBO").when(n == 2, "x"))
    return read(spark, d, "customer").select("c_custkey", c["shown"].alias("shown"), c["used"].alias("used"), c["video"].alias("video"))


@query("SELECT p_partkey, CAST(greatest(1, least(p_size, 16, greatest(1, p_size * 60 // 120), 8)) AS INT) AS lanes FROM part")
def lanes_explicit(spark, d):
    n = F.col("p_size").cast("int")
    return read(spark, d, "part").select("p_partkey", policy.explicit_lanes(n, n * 60.0, F.lit(8)).cast("int").alias("lanes"))


@query("SELECT doc_id, coalesce(text IS NOT NULL AND n_chars > 100 AND lang IS NOT NULL, false) AS valid, coalesce(text IS NOT NULL AND n_chars % 3 <> 0, false) AS intact FROM documents")
def release_checks(spark, d):
    """A document as a release with its digest, every third with a wrong one; one without a text is none."""
    docs = read(spark, d, "documents")
    raw, digest = F.col("text").cast("binary"), F.sha2(F.col("text").cast("binary"), 256)
    told = F.when(F.col("n_chars") % 3 != 0, F.upper(digest)).otherwise(F.reverse(digest))
    valid = policy.valid_release(F.lit("1.0"), F.col("lang"), F.col("n_chars") - 100, digest)
    return docs.select("doc_id", valid.alias("valid"), T.intact(raw, F.octet_length(raw), told).alias("intact"))


@query(r"""WITH t AS (SELECT event_id, event_type || '=1; ' || upper(event_type) || '=2;bad name=3; k=' || event_id || '; novalue; e=' AS x FROM events)
SELECT event_id, event_type || '=1; k=' || event_id || '; e=' AS pairs FROM events""")
def key_value_pairs(spark, d):
    t = F.col("event_type")
    x = F.concat(F.lit("Cookie: "), t, F.lit("=1; "), F.upper(t), F.lit("=2;bad name=3; k="), F.col("event_id").cast("string"), F.lit("; novalue; e="))
    return read(spark, d, "events").select("event_id", F.array_join(F.transform(T.key_values(x), lambda e: F.concat(e["name"], F.lit("="), e["value"])), "; ").alias("pairs"))


@query(r"""SELECT doc_id, right(t, 50) AS tail, CASE WHEN length(c) > 80 THEN substr(c, 1, 80) || '…' ELSE c END AS compact, CASE WHEN c = '' THEN '-' ELSE replace(replace(replace(trim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(13) || chr(10), ' ⏎ '), chr(13), ' '), chr(10), ' ') END AS line
FROM (SELECT doc_id, t, trim(regexp_replace(t, '[ \t\n\v\f\r]+', ' ', 'g')) AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def text_shortening(spark, d):
    x = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", T.tail(x, 50).alias("tail"), T.compact(x, 80).alias("compact"), T.log_message(x, "-").alias("line"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'Error' WHEN contains(lower(props), '"k": 6') THEN 'Warning' ELSE 'Info' END AS level FROM events""")
def level_promote(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", T.promote_level(F.when(F.col("event_type") == "error", "Error").otherwise("Info"), F.col("props"), ('"K": 6',)).alias("level"))


@query("SELECT o_orderkey, substr(x, instr(x, ':') + 1) AS language, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 WHEN o_orderpriority LIKE '3%' THEN 2 ELSE 3 END AS codec FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'ai:' ELSE '' END || o_orderpriority AS x FROM orders)")
def language_codec(spark, d):
    p = F.col("o_orderpriority")
    codec = F.when(p.startswith("1"), "AVC1.64").when(p.startswith("2"), "hvc1.1").when(p.startswith("3"), "av01.0").otherwise(p)
    return read(spark, d, "orders").select("o_orderkey", T.raw_language(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "ai:").otherwise(""), p)).alias("language"), T.codec_rank(codec).alias("codec"))


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600 % 24, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 7200 AS s FROM orders)")
def clock_label(spark, d):
    s = F.floor("o_totalprice").cast("long") % 7200 + 0.75
    return read(spark, d, "orders").select("o_orderkey", T.clock(s).alias("clock"))


@query(r"""WITH b AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * 977 AS n FROM orders), u AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM b)
SELECT o_orderkey, CASE WHEN k = 0 THEN n || ' B' ELSE regexp_replace(regexp_replace(printf('%.2f', round(n / pow(1024.0, k), 2)), '0+$', ''), '\.$', '') || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END AS size FROM u""")
def byte_label(spark, d):
    n = F.col("o_orderkey").cast("long") * F.col("o_orderkey") * 977
    return read(spark, d, "orders").select("o_orderkey", T.human_bytes(n).alias("size"))


@query("SELECT page_id, replace(url_encode(regexp_replace(url, '[!''()*]', '', 'g')), '%20', '+') AS encoded FROM pages")
def parameter_encode(spark, d):
    return read(spark, d, "pages").select("page_id", T.encode_parameter(F.col("url")).alias("encoded"))


@query("SELECT c_custkey, [c_name, c_mktsegment, 'x'][c_custkey % 3 + 1] AS picked, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE c_mktsegment END AS filled, substr(sha256(c_name || chr(0) || '' || chr(0) || c_mktsegment), 1, 24) AS key FROM customer")
def picks_and_keys(spark, d):
    """A rotating pick, the first filled value and an identity key."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    return read(spark, d, "customer").select("c_custkey", T.pick(F.array(name, seg, F.lit("x")), -k).alias("picked"), T.first_filled(F.when(k % 3 == 0, name).when(k % 3 == 1, " "), seg).alias("filled"), T.identity_key(F.concat(F.lit(" "), name), F.lit(None).cast("string"), seg, length=24).alias("key"))


@query(r"SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/:?#]+)', 1) AS host, nullif(regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1), '') AS path FROM pages")
def url_parts(spark, d):
    part = lambda p: F.try_parse_url("url", F.lit(p))
    return read(spark, d, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), F.when(part("PATH") != "", part("PATH")).alias("path"))


@query("""SELECT user_id, max_by(event_type, event_id) FILTER (event_type <> 'view') AS "last" FROM events GROUP BY 1""")
def last_filled(spark, d):
    value = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    return rank.last_filled(read(spark, d, "events"), ["user_id"], value, F.col("event_id"), "last")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY i) AS types FROM (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY ALL) GROUP BY 1")
def ordered_distinct(spark, d):
    out = rank.ordered_distinct(read(spark, d, "events"), ["user_id"], F.col("event_type"), [F.col("event_id")], "types")
    return out.select("user_id", F.array_join("types", ",").alias("types"))


@query("SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, event_type) AS BIGINT) AS place FROM (SELECT DISTINCT user_id, event_type FROM events)")
def priority_order(spark, d):
    keys = rank.priority_then_name(F.col("event_type"), ["purchase", "error"])
    kinds = read(spark, d, "events").select("user_id", "event_type").distinct()
    return kinds.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*keys)).cast("long"))


@query("SELECT user_id, max(event_id % 10) AS generation FROM events GROUP BY 1")
def max_generation(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max(F.col("event_id") % 10).alias("generation"))
