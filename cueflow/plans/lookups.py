"""Queries over ids, maps, refetched routes, roll-ups at several levels and rendered cues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueflow.functions import sql
from cueflow.functions import text as T
from cueflow.operators import lanes, ledger, policy, rank, render
from cueflow.plans.registry import query, read
from cueflow.sources import media as M


@query("""WITH g AS (SELECT user_id, event_id, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, k, 1 + (user_id + k) % 3 AS n, user_id % 5 = 0 AND k >= 3 AS other, user_id % 7 = 0 AND k >= 2 AS larger FROM (SELECT DISTINCT user_id FROM events), range(8) t(k)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY k) - n AS a FROM r)
SELECT event_id, g::BIGINT AS generation, CASE WHEN NOT (other OR larger) THEN k END::BIGINT AS round, CASE WHEN NOT (other OR larger) THEN g - a END::INT AS endpoint,
  CASE WHEN k IS NULL THEN CASE WHEN user_id % 7 = 0 THEN 'size' WHEN user_id % 5 = 0 THEN 'format' ELSE 'rounds' END WHEN larger THEN 'size' WHEN other THEN 'format' END AS stopped
FROM (SELECT g.user_id, event_id, g, k, a, other, larger FROM g LEFT JOIN s ON s.user_id = g.user_id AND g.g >= a AND g.g < a + n)""")
def route_refetch(spark, d):
    """A user's errors as rotations over rounds of one to three endpoints: of every fifth user the fourth round offers another
    format, of every seventh the third another size; other rounds spell the format differently or know no size."""
    e = read(spark, d, "events")
    turned = ledger.routes(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", F.lit(1)).select("user_id", "event_id", "generation")
    u, k = F.col("user_id"), F.col("round")
    rounds = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("round"))
    name = F.when((u % 5 == 0) & (k >= 3), "30080").when(k % 2 == 0, "Hi").otherwise("HI")
    size = F.when(k == 1, F.lit(1000)).when((u % 7 == 0) & (k >= 2), 1001).when(k >= 2, 1000).otherwise(0)
    rounds = rounds.select("user_id", "round", name.alias("format_id"), size.alias("size"), (1 + (u + k) % 3).alias("endpoints"))
    out = ledger.refetched(turned, rounds, ["user_id"])
    # of a user whose rounds are all stopped before they end, what lies beyond the last is stopped for the same reason
    beyond = F.when(u % 7 == 0, "size").when(u % 5 == 0, "format").otherwise("rounds")
    return out.select("event_id", "generation", "round", "endpoint", F.when(F.col("stopped") == "rounds", beyond).otherwise(F.col("stopped")).alias("stopped"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def key_required(spark, d):
    """Orders with their customer, which must be there."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return rank.require(read(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_name")


@query("""SELECT c_custkey, 'BV' || c_custkey || 'x' AS video, CASE c_custkey % 4 WHEN 0 THEN c_custkey + 1 WHEN 1 THEN c_custkey % 9 + 1 WHEN 2 THEN 7 ELSE 1 END::INT AS part,
  'https' AS scheme, 'h.example' AS host, CASE WHEN c_custkey % 2 = 0 THEN 8443 END::INT AS port, '/video/BV' || c_custkey || 'x' AS path FROM customer""")
def media_ids(spark, d):
    """Ids and urls of videos: the part from the id, from the url's p in any case, from its second p, or none that counts."""
    k = F.col("c_custkey")
    s = k.cast("string")
    id_ = F.when(k % 4 == 0, F.concat(s, F.lit("_P"), (k + 1).cast("string"))).when(k % 4 == 1, F.concat(s, F.lit("_p0"))).otherwise(s)
    ask = F.when(k % 4 == 1, F.concat(F.lit("P="), (k % 9 + 1).cast("string"))).when(k % 4 == 2, "p=x&t=1&p=%37").when(k % 4 == 3, "p=99999999999&q=2").otherwise("p=3")
    url = F.concat(F.lit("HTTPS://h.example"), F.when(k % 2 == 0, ":8443").otherwise(""), F.lit("/video/BV"), s, F.lit("x?"), ask)
    parts = T.url_parts(url)
    return read(spark, d, "customer").select("c_custkey", T.video_id(url).alias("video"), T.part_number(id_, url).alias("part"), *[parts[c].alias(c) for c in ("scheme", "host", "port", "path")])


@query("SELECT c_custkey, c_mktsegment AS kind, c_name AS host, 2 AS n FROM customer")
def header_map(spark, d):
    """Headers whose names differ in case only: the last one stays."""
    m = F.create_map(F.lit("Content-Type"), F.col("c_name"), F.lit("HOST"), F.col("c_name"), F.lit("content-type"), F.col("c_mktsegment"))
    low = T.lower_keys(m)
    return read(spark, d, "customer").select("c_custkey", low["content-type"].alias("kind"), low["host"].alias("host"), F.size(low).alias("n"))


@query("SELECT event_type AS name, event_id::VARCHAR AS value FROM events WHERE event_id % 4 = 0")
def tab_lines(spark, d):
    """An event as a line of seven fields, a comment, a blank line or one of six fields."""
    k, n = F.col("event_id").cast("string"), F.col("event_id") % 4
    fields = F.concat_ws("\t", F.lit("h"), F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), F.lit("0"), "event_type", k)
    line = F.when(n == 0, fields).when(n == 1, F.concat(F.lit("#"), fields)).when(n == 2, F.lit(" \u00a0")).otherwise(F.concat_ws("\t", *[k] * 6))
    return M.lines(read(spark, d, "events").select(line.alias("value")))


@query(r"""SELECT o_orderkey, CASE WHEN v >= 1048576 THEN printf('%.1f MiB/s', round(v / 1048576.0::DOUBLE, 1)) WHEN v >= 1024 THEN printf('%.0f KiB/s', round(v / 1024.0::DOUBLE)) ELSE v || ' B/s' END AS speed FROM (SELECT o_orderkey, o_orderkey * 131 AS v FROM orders)""")
def speed_label(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.speed_label(F.col("o_orderkey") * 131).alias("speed"))


@query("""WITH m AS (SELECT p_partkey, ['accurate', 'balanced', 'fast', 'x'][p_partkey % 4 + 1] AS mode, p_size / 20.0::DOUBLE - 0.25 AS s FROM part),
t AS (SELECT *, CASE WHEN s > 0 THEN least(1.5, greatest(0.6, s)) ELSE 1 END AS f FROM m)
SELECT p_partkey, CASE mode WHEN 'accurate' THEN 4.0 WHEN 'fast' THEN 1.5 ELSE 2.5 END::DOUBLE AS fps, round(CASE mode WHEN 'accurate' THEN 0.10 WHEN 'fast' THEN 0.22 ELSE 0.16 END * f, 9)::DOUBLE AS difference, CASE mode WHEN 'accurate' THEN 0.68 WHEN 'fast' THEN 0.58 ELSE 0.62 END::DOUBLE AS low,
  CASE mode WHEN 'accurate' THEN 12 WHEN 'fast' THEN 24 ELSE 16 END::DOUBLE AS overlap FROM t""")
def scan_mode(spark, d):
    """A part as a scan of some mode and sensitivity."""
    k = F.col("p_partkey")
    mode = F.element_at(F.array(*map(F.lit, ("accurate", "balanced", "fast", "x"))), (k % 4 + 1).cast("int"))
    m = policy.scan_mode(mode, F.col("p_size") / 20.0 - 0.25)
    return read(spark, d, "part").select("p_partkey", m["fps"].alias("fps"), F.round(m["difference"], 9).alias("difference"), m["low"].alias("low"), m["overlap"].alias("overlap"))


@query("""SELECT user_id, event_type, day, grouping_id(user_id, event_type, day)::BIGINT AS level, count(*) AS rows, round(sum(value), 4) AS value, count(DISTINCT event_id % 7) AS texts
FROM (SELECT user_id, event_type, event_id, value, date_part('day', ts)::INT AS day FROM events) GROUP BY CUBE (user_id, event_type, day)""")
def event_cube(spark, d):
    """Events over users, types and days at once, and how many of seven texts each group holds."""
    e = read(spark, d, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("day"), "value", (F.col("event_id") % 7).cast("string").alias("text"))
    return lanes.cube(e, ["user_id", "event_type", "day"], ["value"], {"text": "texts"}).withColumn("value", F.round("value", 4))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events WHERE event_id % 3 = 0)
SELECT user_id, no, no || chr(10) || printf('%02d:%02d:%02d,000 --> %02d:%02d:%02d,500', no // 3600, no // 60 % 60, no % 60, no // 3600, no // 60 % 60, no % 60) || chr(10) || '你好，' || event_id || '！' || chr(10) AS block FROM e""")
def render_accepted(spark, d):
    """Blocks of Han text alone: lines of another script and lone Latin words are refused before blocks are numbered."""
    e, k = read(spark, d, "events"), F.col("event_id").cast("string")
    kept = e.filter("event_id % 3 = 0").withColumn("no", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("double"))
    rest = e.filter("event_id % 3 <> 0").withColumn("no", F.lit(0.0))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 你好，  ，"), k, F.lit("！！"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("ABC…你好"), k)).otherwise(F.concat(F.lit("テスト"), k))
    cues = kept.unionByName(rest).select("user_id", "event_id", F.col("no").alias("start"), (F.col("no") + 0.5).alias("end"), text.alias("text"))
    return render.srt_blocks(cues, ["user_id"], [F.col("event_id")], T.script_normalize(F.col("text")))


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, value AS "start", value + 1 AS "end", event_type || ' "' || event_id || '"' AS text FROM events""")
def cue_json(spark, d):
    """A user's events as a JSON array, and its elements read again."""
    cues = read(spark, d, "events").select("user_id", "event_id", F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.concat("event_type", F.lit(' "'), F.col("event_id").cast("string"), F.lit('"')).alias("text"))
    files = render.cue_json(cues, ["user_id"], F.col("event_id"))
    back = files.select("user_id", F.posexplode(F.from_json("content", "array<struct<Start: double, End: double, Text: string>>")).alias("place", "x"))
    return back.select("user_id", F.col("place").cast("long").alias("place"), F.col("x.Start").alias("start"), F.col("x.End").alias("end"), F.col("x.Text").alias("text"))


@query("""WITH t AS (SELECT user_id, event_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM t)
SELECT user_id, epoch_us(min(ts)) AS begin, epoch_us(max(ts)) AS until, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS bytes, CASE WHEN max(ts) > min(ts) THEN round(sum(event_id) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) END::DOUBLE AS speed FROM s GROUP BY user_id, no""")
def transfer_sessions(spark, d):
    """A user's events as the blocks of transfers that pause for less than six hours."""
    out = ledger.session_rates(read(spark, d, "events"), ["user_id"], F.col("ts").cast("timestamp"), F.col("event_id"), "6 hours")
    return out.select("user_id", F.unix_micros("begin").alias("begin"), F.unix_micros("until").alias("until"), "rows", "bytes", F.round("bytes_per_second", 6).alias("speed"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '你好 ' || event_id END AS line, CASE WHEN event_id % 60 < event_id % 75 OR event_id % 75 < 60 THEN CASE WHEN event_id % 75 < 60 THEN event_id // 60 * 3600.0 + event_id % 60 * 60.0 + event_id % 75 + 0.25 END END::DOUBLE AS seconds,
  printf('%02d:%02d:%02d,%03d', event_id // 3600, event_id // 60 % 60, event_id % 60, event_id % 1000) AS label, round(1 - levenshtein(event_type, reverse(event_type)) / length(event_type), 9)::DOUBLE AS sim FROM events""")
def sql_functions(spark, d):
    """The functions of timed text in SQL alone."""
    sql.register(spark)
    return spark.sql("""SELECT event_id, script_line(CASE WHEN event_id % 4 < 2 THEN concat(' 你好  ', event_id) ELSE concat('ABC…你好', event_id) END) AS line,
        cue_seconds(format_string(' %d:%02d:%02d,25', event_id div 60, event_id % 60, event_id % 75)) AS seconds, srt_time(event_id + event_id % 1000 / 1000) AS label,
        round(cue_similarity(event_type, reverse(event_type)), 9) AS sim FROM {events}""", events=read(spark, d, "events"))
