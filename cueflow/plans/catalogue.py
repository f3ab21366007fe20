"""The registered queries over the driver's tables, with the SQL they are held against.

The driver's tables hold no media: which column stands for a cue, lane or rendition is our choice (said in
each query), the operators are those of the survey's inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.functions import text as T
from cueflow.functions.version import version_key
from cueflow.operators import intervals, lanes, policy, rank
from cueflow.plans.registry import ORACLES, QUERIES, query, read  # noqa: F401
from cueflow.streaming import tracker

def event_cues(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as cues: start in seconds, as long as the value, the type as text."""
    e = read(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("ord"), start.alias("start"), (start + F.col("value") * 600).alias("end"), F.col("event_type").alias("text"))


_CUES = """c0 AS (SELECT user_id AS source_id, event_id AS ord, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 600 AS e0, event_type AS text FROM events),
c AS (SELECT source_id, ord, s, CASE WHEN e0 <= s THEN s + 1.5 ELSE e0 END AS e, text FROM c0)"""
_COALESCE = f"""{_CUES},
r AS (SELECT *, sum(n) OVER (PARTITION BY source_id ORDER BY s, ord) AS run FROM
  (SELECT *, coalesce(CAST(lag(text) OVER (PARTITION BY source_id ORDER BY s, ord) <> text AS INT), 1) AS n FROM c)),
m AS (SELECT *, max(e) OVER (PARTITION BY source_id, run ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(coalesce(CAST(s > reach + 0.15 AS INT), 1)) OVER (PARTITION BY source_id, run ORDER BY s, ord) AS island FROM m),
k AS (SELECT source_id, min(s) AS s, max(e) AS e, min(text) AS text FROM i GROUP BY source_id, run, island)"""


@query(f"WITH {_COALESCE} SELECT source_id, round(s, 3) AS \"start\", round(e, 3) AS \"end\", text FROM k")
def cue_coalesce(spark, d):
    return intervals.coalesce(event_cues(spark, d)).select("source_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@query(f"""WITH {_COALESCE},
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s, e, text) AS no, min(s) OVER () AS zero FROM k),
t AS (SELECT source_id, no, text, CAST(round_even((s - zero) * 1000, 0) AS BIGINT) AS a, CAST(round_even((e - zero) * 1000, 0) AS BIGINT) AS b FROM n)
SELECT source_id, no, printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS timing, text FROM t""")
def cue_render_srt(spark, d):
    cues = intervals.coalesce(event_cues(spark, d))
    zero = cues.agg(F.min("start").alias("zero"))
    no = F.row_number().over(Window.partitionBy("source_id").orderBy("start", "end", "text"))
    at = lambda c: T.srt_time(F.col(c) - F.col("zero"))
    return cues.crossJoin(F.broadcast(zero)).select("source_id", no.cast("long").alias("no"), F.concat(at("start"), F.lit(" --> "), at("end")).alias("timing"), "text")


@query("SELECT user_id, event_type AS text, min(event_id) AS ord FROM events GROUP BY ALL")
def text_distinct_first(spark, d):
    return read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("text")).agg(F.min("event_id").alias("ord"))


@query("""WITH t AS (SELECT doc_id, n_chars::DOUBLE AS d, greatest(1, least(8, n_chars // 120)) AS n FROM documents WHERE n_chars IS NOT NULL), l AS (SELECT doc_id, d, d / n AS size, unnest(range(0, n)) AS i FROM t)
SELECT doc_id, CAST(i AS INT) AS "index", round(i * size, 6) AS core_start, round((i + 1) * size, 6) AS core_end, round(greatest(0, i * size - 12), 6) AS scan_start, round(least(d, (i + 1) * size + 12), 6) AS scan_end FROM l""")
def lane_plan(spark, d):
    """A document's characters as seconds of media."""
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    times = [F.round(c, 6).alias(c) for c in ("core_start", "core_end", "scan_start", "scan_end")]
    return lanes.lane_plans(docs, F.col("n_chars"), F.lit(8), F.lit(12)).select("doc_id", "index", *times)


@query("""WITH t AS (SELECT doc_id, n_chars * 4096 AS total FROM documents WHERE n_chars > 0), c AS (SELECT *, CAST(least(4194304, greatest(1048576, ceil(total / 8))) AS BIGINT) AS chunk FROM t)
SELECT doc_id, CAST(i AS INT) AS seg, i * chunk AS "first", least((i + 1) * chunk, total) - 1 AS "last" FROM c, range(100000) r(i) WHERE i * chunk < total""")
def byte_range_plan(spark, d):
    docs = read(spark, d, "documents").select("doc_id", (F.col("n_chars") * 4096).alias("total"))
    return lanes.byte_ranges(docs, F.col("total"), 8).select("doc_id", "seg", "first", "last")


@query("""WITH c AS (SELECT event_id, date_part('day', ts) * 86400.0 + epoch(ts::TIME) AS t FROM events), l AS (SELECT i, i * 172800.0 AS a, (i + 1) * 172800.0 AS b FROM range(16) r(i))
SELECT event_id, CAST(i AS INT) AS lane FROM c, l WHERE t - 86400 >= a AND (t - 86400 < b OR i = 15 AND t - 86400 <= b) AND t - 86400 BETWEEN a - 24 AND b + 24""")
def lane_ownership(spark, d):
    # a month of seconds in sixteen lanes; every event is seen by each lane that scans it and kept by its owner
    seg = lanes.lane_plan(spark, 2764800.0, 16, 24.0)
    at = (F.dayofmonth("ts") - 1) * 86400.0 + F.unix_micros(F.col("ts").cast("timestamp")) % 86400000000 / 1e6
    e = read(spark, d, "events").select("event_id", at.alias("start"))
    seen = e.join(F.broadcast(seg.select(F.col("index").alias("lane"), "scan_start", "scan_end")), F.col("start").between(F.col("scan_start"), F.col("scan_end"))).select("event_id", "start", "lane")
    return intervals.own(seen, seg).select("event_id", "lane")


@query("""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderstatus = 'F' AS done, o_totalprice AS p FROM orders),
l AS (SELECT *, i * 1e6 AS a, (i + 1) * 1e6 AS b, i * 1e6 + p AS media, coalesce(min(CAST(done AS INT)) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM o)
SELECT o_custkey, round(max(CASE WHEN done THEN b ELSE greatest(a, least(b, media)) END), 2) AS frontier FROM l WHERE before = 1 GROUP BY 1""")
def lane_frontier(spark, d):
    o = read(spark, d, "orders").withColumn("index", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    o = o.select("o_custkey", "index", (F.col("o_orderstatus") == "F").alias("completed"), (F.col("index") * 1e6).alias("core_start"), ((F.col("index") + 1) * 1e6).alias("core_end"), (F.col("index") * 1e6 + F.col("o_totalprice")).alias("media"))
    return lanes.frontier(o, ["o_custkey"]).select("o_custkey", F.round("frontier", 2).alias("frontier"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_linenumber) = 1""")
def best_rendition(spark, d):
    keys = [F.desc(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return rank.first_by(read(spark, d, "lineitem"), ["l_orderkey"], [*keys, F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY l_quantity <= 10 OR NOT bool_or(l_quantity <= 10) OVER (PARTITION BY l_orderkey)")
def height_cap_fallback(spark, d):
    return rank.cap_with_fallback(read(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity") <= 10).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH c AS (SELECT *, substr(o_orderpriority, 1, 1) AS cls FROM orders), m AS (SELECT *, min(cls) OVER (PARTITION BY o_custkey) AS best FROM c)
SELECT o_custkey, o_orderkey, cls FROM m WHERE cls = best QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def class_fallback_rank(spark, d):
    o = read(spark, d, "orders").withColumn("cls", F.substring("o_orderpriority", 1, 1))
    return rank.first_by(rank.best_class(o, ["o_custkey"], F.col("cls")), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "cls")


@query("""SELECT id, origin FROM (SELECT doc_id AS id, 'labels' AS origin, 0 AS r FROM labels UNION ALL SELECT doc_id, 'documents', 1 FROM documents UNION ALL SELECT page_id, 'pages', 2 FROM pages) QUALIFY row_number() OVER (PARTITION BY id ORDER BY r) = 1""")
def precedence_union(spark, d):
    part = lambda t, c: read(spark, d, t).select(F.col(c).alias("id"), F.lit(t).alias("origin"))
    out = rank.precedence_union([part("labels", "doc_id"), part("documents", "doc_id"), part("pages", "page_id")], F.col("id").cast("string"), [F.col("id")])
    return out.select("id", "origin")


@query("""SELECT page_id, k AS url_key FROM (SELECT page_id, regexp_extract(lower(url), '^(https?://[^?#]*)', 1) AS k FROM pages) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1""")
def url_fingerprint_dedupe(spark, d):
    p = read(spark, d, "pages").select("page_id", rank.url_key(F.col("url")).alias("url_key")).filter("url_key is not null")
    return rank.first_by(p, ["url_key"], [F.col("page_id")])


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 12")
def enrich_left(spark, d):
    """Orders with their customer's segment, where it is known."""
    known = read(spark, d, "customer").filter("c_nationkey < 12").select("c_custkey", "c_mktsegment")
    out = rank.enrich(read(spark, d, "orders"), known, F.concat(F.lit("K"), F.col("o_custkey").cast("string")), F.concat(F.lit("k"), F.col("c_custkey").cast("string")))
    return out.select("o_orderkey", "o_custkey", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def done_semi(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) AS t FROM orders), i AS (SELECT o_custkey, o_orderkey AS cue, t AS a, t + 86400 * 200 AS b FROM o)
SELECT o.o_orderkey, min(i.cue) AS cue FROM o JOIN i ON o.o_custkey = i.o_custkey AND o.t BETWEEN i.a AND i.b GROUP BY 1""")
def point_in_interval(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t"))
    # the intervals that hold t are those of the customer's orders of the 200 days up to t
    w = Window.partitionBy("o_custkey").orderBy("t").rangeBetween(-86400 * 200, Window.currentRow)
    o = o.filter("o_custkey is not null and t is not null").withColumn("cue", F.min("o_orderkey").over(w))
    return o.groupBy("o_orderkey").agg(F.min("cue").alias("cue"))


@query("""WITH t AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, CAST(floor(value * 600000) AS BIGINT) * CASE WHEN event_id % 40 = 0 THEN 500 WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS long FROM events),
p AS (SELECT user_id, event_id, 'start' AS side, t FROM t UNION ALL SELECT user_id, event_id, 'end', t + long FROM t UNION ALL SELECT user_id, event_id, 'past', t + long + 1 FROM t)
SELECT p.event_id, side, min(s.event_id) AS first FROM p LEFT JOIN t s ON s.user_id = p.user_id AND p.t BETWEEN s.t AND s.t + s.long GROUP BY ALL""")
def cue_at(spark, d):
    """The first of a user's events under way at the start of each, at its end and just after; some last for days, some no time."""
    e, n = read(spark, d, "events"), F.col("event_id")
    long = F.floor(F.col("value") * 600000).cast("long") * F.when(n % 40 == 0, 500).when(n % 3 == 0, 0).otherwise(1)
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    spans = e.select("user_id", "event_id", t.alias("start"), (t + long).alias("end"))
    at = [F.struct(F.lit(side).alias("side"), x.alias("t")) for side, x in (("start", F.col("start")), ("end", F.col("end")), ("past", F.col("end") + 1))]
    points = spans.select("user_id", "event_id", F.inline(F.array(*at)))
    found = intervals.first_containing(points, spans, ["user_id"], "t", "start", "end", "event_id")
    return found.select("event_id", "side", F.col("span.event_id").alias("first"))


@query("SELECT user_id, bool_and(event_type <> 'error') AS all_supported, round(sum(value), 4) AS value, CAST(sum(event_id) AS BIGINT) AS event_id FROM events GROUP BY 1")
def transport_rollup(spark, d):
    return lanes.transport_rollup(read(spark, d, "events"), ["user_id"], F.col("event_type") != "error", ["value", "event_id"])


@query("WITH s AS (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT event_type, n, round(n / greatest(1.0, max(n) OVER ()), 9) AS share FROM s")
def share_of_max(spark, d):
    s = read(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"))
    return lanes.share_of_max(s, "n").withColumn("share", F.round("share", 9))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def last_n(spark, d):
    return rank.last_n(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS x FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(13), '') AS x FROM t)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda s: regexp_replace(s, '^[ \t\x0B\f]+|[ \t\x0B\f]+$', '', 'g')), lambda s: s <> ''), chr(10)) AS text FROM u""")
def tag_strip_clean(spark, d):
    return read(spark, d, "pages").select("page_id", T.clean_lines(T.strip_tags(F.col("html"))).alias("text"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) || 'Cookie: a=' || doc_id || '; C:\Users\me' || doc_id || '\x http://h/?auth=' || doc_id || '&x=1 SESSDATA = s' || doc_id AS x FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '(?i)(SESSDATA|bili_jct|buvid\d*|DedeUserID|authorization|token|cookie)\s*[:=]\s*([^\s;&]+)', '\1=[ĐÃ ẨN]', 'g'), '(?i)C:\\Users\\[^\\\s]+', 'C:\\Users\\[ĐÃ ẨN]', 'g'), '(?i)([?&](?:token|auth|cookie|sessdata)=)[^&#\s]+', '\1[ĐÃ ẨN]', 'g') AS text FROM t""")
def redact(spark, d):
    """Whole texts, with a line of secrets of each sort at the end."""
    k = F.col("doc_id").cast("string")
    secrets = F.concat(F.lit("\nCookie: a="), k, F.lit("; C:\\Users\\me"), k, F.lit("\\x http://h/?auth="), k, F.lit("&x=1 SESSDATA = s"), k)
    return read(spark, d, "documents").select("doc_id", T.redact(F.concat(F.coalesce("text", F.lit("")), secrets)).alias("text"))


@query(r"""WITH c AS (SELECT page_id, substr(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 150) AS n FROM pages) SELECT page_id, CASE page_id % 7 WHEN 0 THEN '_con.' || page_id WHEN 1 THEN 'CON.a.' || page_id WHEN 2 THEN 'name' || page_id WHEN 3 THEN 'file' WHEN 4 THEN 'file' ELSE CASE WHEN n = '' THEN 'file' ELSE n END END AS name FROM c""")
def filename_sanitize(spark, d):
    """Pages' urls as names, between reserved ones with one ending and with two, tabs at the ends, blanks and nulls."""
    k, n = F.col("page_id").cast("string"), F.col("page_id") % 7
    raw = F.when(n == 0, F.concat(F.lit("con."), k)).when(n == 1, F.concat(F.lit("CON.a."), k)).when(n == 2, F.concat(F.lit("\tname"), k, F.lit("\u00a0"))).when(n == 3, " . ").when(n != 4, F.col("url"))
    return read(spark, d, "pages").select("page_id", T.safe_filename(raw).alias("name"))


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 60 AS m, o_orderkey % 75 AS s, o_orderkey // 60 AS h FROM orders)
SELECT k AS o_orderkey, CASE WHEN s >= 60 THEN NULL ELSE h * 3600.0 + m * 60.0 + s + 0.25 END::DOUBLE AS whole, CASE WHEN s >= 60 THEN NULL ELSE m * 60.0 + s END::DOUBLE AS "short", NULL::DOUBLE AS bad FROM t""")
def timestamp_parse(spark, d):
    """An order's key as times of three parts and of two, and as what is none."""
    k = F.col("o_orderkey")
    raw = F.format_string(" %d:%02d:%02d,25", F.floor(k / 60), k % 60, k % 75)
    bad = F.when(k % 4 == 0, F.concat(F.lit("-"), F.trim(raw))).when(k % 4 == 1, F.format_string("1.5:%02d:00", k % 60)).when(k % 4 == 2, "1e1:05").otherwise("00:01.5:02")
    return read(spark, d, "orders").select("o_orderkey", T.parse_time(raw).alias("whole"), T.parse_time(F.format_string("%d:%02d", k % 60, k % 75)).alias("short"), T.parse_time(bad).alias("bad"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '你好 ' || event_id || '，世界！' WHEN 2 THEN 'VIP会员' || event_id WHEN 4 THEN '今天！' || event_id END AS clean FROM events""")
def script_normalize(spark, d):
    """An event's id within Han text: marks collapse; a lone Latin word (also before an ellipsis) and another script are refused."""
    k, n = F.col("event_id").cast("string"), F.col("event_id") % 7
    raw = F.when(n == 0, F.concat(F.lit("你好  "), k, F.lit("， ，世界！！"))).when(n == 1, F.concat(F.lit("你好 ABC "), k)).when(n == 2, F.concat(F.lit("VIP会员"), k)).when(n == 3, F.concat(F.lit("你好 テスト"), k)).when(n == 4, F.concat(F.lit(" 今天！ ！"), k)).when(n == 5, F.concat(F.lit("ABC…你好"), k)).otherwise(F.concat(F.lit("你好 ABC…"), k))
    return read(spark, d, "events").select("event_id", T.script_normalize(raw).alias("clean"))


@query("SELECT page_id, round(1 - levenshtein(url, reverse(url)) / greatest(length(url), length(reverse(url))), 9) AS sim FROM pages")
def similarity(spark, d):
    """An url (ASCII in the tables, as DuckDB's distance is one of bytes) against itself read backwards."""
    return read(spark, d, "pages").select("page_id", F.round(T.similarity(F.col("url"), F.reverse("url")), 9).alias("sim"))


_ALIKE = "(1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})))"

# a row for each frame: the state after it (candidate: text, start, last, confidence, hits, need; active: start, text,
# confidence; empty frames and since when), and the cue that it ended
_TRACKED = f"""WITH RECURSIVE obs AS (SELECT user_id AS lane, row_number() OVER w AS k, (row_number() OVER w - 1) / 4.0::DOUBLE AS at_, CASE WHEN event_type <> 'error' THEN event_type END AS x, 0.5::DOUBLE + event_id % 50 / 100.0::DOUBLE AS q
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT DISTINCT lane, 0::BIGINT AS k, 0::DOUBLE AS at_, NULL::VARCHAR AS ct, NULL::DOUBLE AS cs, NULL::DOUBLE AS cl, NULL::DOUBLE AS cc, 0 AS ch, 0 AS cn, NULL::DOUBLE AS act, NULL::VARCHAR AS att, NULL::DOUBLE AS acc, 0 AS em, 0::DOUBLE AS si,
    NULL::DOUBLE AS os, NULL::DOUBLE AS oe, NULL::VARCHAR AS ot, NULL::DOUBLE AS oc FROM obs
  UNION ALL SELECT lane, k, at_, CASE WHEN fresh THEN x WHEN held THEN ct2 END, CASE WHEN fresh THEN at_ WHEN held THEN cs END, CASE WHEN fresh OR held THEN at_ END, CASE WHEN fresh THEN q WHEN held THEN cc2 END,
    CASE WHEN fresh THEN 1 WHEN held THEN ch + 1 ELSE 0 END, CASE WHEN fresh THEN needs WHEN held THEN need2 ELSE 0 END,
    CASE WHEN shown THEN cs WHEN NOT over THEN act END, CASE WHEN shown THEN ct2 WHEN over THEN NULL WHEN same AND (q > acc + 0.035 OR length(x) > length(att) + 2) THEN x ELSE att END,
    CASE WHEN shown THEN cc2 WHEN over THEN NULL WHEN same THEN greatest(acc, q) ELSE acc END, CASE WHEN blank AND act IS NOT NULL AND NOT over THEN em + 1 ELSE 0 END, CASE WHEN blank AND em = 0 THEN at_ ELSE si END,
    CASE WHEN act IS NOT NULL AND (over OR shown) THEN act END, CASE WHEN act IS NOT NULL AND (over OR shown) THEN least(act + 30, greatest(act + 0.12, CASE WHEN shown THEN cs ELSE greatest(CASE WHEN em = 0 THEN at_ ELSE si END, act + 0.25) END)) END,
    CASE WHEN over OR shown THEN att END, CASE WHEN over OR shown THEN acc END
  FROM (SELECT *, NOT blank AND NOT same AND NOT again AS fresh, NOT blank AND NOT same AND again AND ch + 1 < need2 AS held, NOT blank AND NOT same AND again AND ch + 1 >= need2 AS shown, blank AND act IS NOT NULL AND em + 1 >= 2 AS over
    FROM (SELECT *, CASE WHEN q > cc + 0.035 OR length(x) > length(ct) + 2 THEN x ELSE ct END AS ct2, greatest(cc, q) AS cc2, greatest(cn, needs) AS need2
      FROM (SELECT t.lane, o.k, o.at_, o.x, o.q, ct, cs, cl, cc, ch, cn, act, att, acc, em, si, o.x IS NULL OR trim(o.x) = '' AS blank, coalesce({_ALIKE.format('o.x', 'att')} >= 0.8, false) AS same,
        coalesce(o.at_ - cl <= 0.75 AND {_ALIKE.format('o.x', 'ct')} >= 0.8, false) AS again, CASE WHEN length(o.x) <= 1 OR o.q < 0.68 THEN 3 ELSE 2 END AS needs FROM t JOIN obs o ON o.lane = t.lane AND o.k = t.k + 1))))
SELECT lane, os AS "start", oe AS "end", ot AS text, oc AS confidence FROM t WHERE os IS NOT NULL
UNION ALL SELECT lane, act, least(act + 30, greatest(act + 0.12, at_ + 0.25, act + 0.25)), att, acc FROM t WHERE act IS NOT NULL AND (lane, k) IN (SELECT lane, max(k) FROM obs GROUP BY 1)"""


@query(_TRACKED)
def cue_tracker(spark, d):
    """A user's events as frames at four a second; errors are empty frames."""
    e = read(spark, d, "events")
    at = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) / 4.0
    obs = e.select(F.col("user_id").alias("lane"), F.col("event_id").alias("ord"), at.alias("at"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("text"), (F.lit(0.5) + F.pmod("event_id", F.lit(50)) / 100.0).alias("confidence"))
    return tracker.track(obs)


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS source_id, event_id AS ord, (date_part('day', ts) - 1) * 86400.0::DOUBLE + epoch(ts::TIME) AS s, value * 600 AS long, event_type || event_id % 3 || '!' AS text, CASE WHEN event_id % 4 > 0 THEN event_id % 9 / 10.0::DOUBLE END AS conf FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s, ord) AS k FROM e),
f AS (SELECT source_id, k, s, s + long AS e, text, conf, 0 AS merges, k AS head FROM r WHERE k = 1
  UNION ALL SELECT source_id, k, CASE WHEN m THEN s ELSE s2 END, CASE WHEN m THEN greatest(e, e2) ELSE e2 END, CASE WHEN m THEN text ELSE t2 END, CASE WHEN m THEN greatest(conf, c2) ELSE c2 END, CASE WHEN m THEN merges + 1 ELSE 0 END, CASE WHEN m THEN head ELSE k END
    FROM (SELECT f.source_id, r.k, f.s, f.e, f.text, f.conf, f.merges, f.head, r.s AS s2, r.s + r.long AS e2, r.text AS t2, r.conf AS c2, r.s <= f.e + 0.25 AND {_ALIKE.format('f.text', 'r.text')} >= 0.82 AS m FROM f JOIN r ON r.source_id = f.source_id AND r.k = f.k + 1))
SELECT source_id, round(s, 6) AS "start", round(e, 6) AS "end", text, conf AS confidence, merges::BIGINT AS merges FROM f QUALIFY row_number() OVER (PARTITION BY source_id, head ORDER BY k DESC) = 1""")
def boundary_reconcile(spark, d):
    """Events of a month as cues that two lanes see at every border: owned, cleaned, and merged where they are alike; of every
    fourth the confidence is not known."""
    seg = lanes.lane_plan(spark, 2764800.0, 16, 24.0)
    at = (F.dayofmonth("ts") - 1) * 86400.0 + F.unix_micros(F.col("ts").cast("timestamp")) % 86400000000 / 1e6
    text = F.concat(F.lit(" "), "event_type", (F.col("event_id") % 3).cast("string"), F.lit("!  !"))
    confidence = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 9 / 10.0)
    e = read(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("ord"), at.alias("start"), (at + F.col("value") * 600).alias("end"), text.alias("text"), confidence.alias("confidence"))
    seen = e.join(F.broadcast(seg.select(F.col("index").alias("lane"), "scan_start", "scan_end")), F.col("start").between(F.col("scan_start"), F.col("scan_end"))).drop("scan_start", "scan_end")
    clean = F.regexp_replace(T.collapse_space(F.col("text")), rf"([{T.MARKS}])(?:\s*\1)+", "$1")
    out = intervals.reconcile(seen, plan=seg, accept=F.when(clean != "", clean))
    return out.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("""WITH v AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 7 AS n, o_orderkey % 50 AS q, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS form FROM orders)
SELECT o_orderkey, dense_rank() OVER (PARTITION BY k ORDER BY q, form, CASE WHEN form = 2 THEN 0 ELSE n END) AS place FROM v""")
def version_order(spark, d):
    """A customer's orders as versions: 1.q-alpha.n before 1.q-Beta n, and these before v1.q+n, whatever follows the plus."""
    k = F.col("o_orderkey")
    q, n = (k % 50).cast("string"), (k % 7).cast("string")
    raw = F.when(k % 3 == 0, F.concat(F.lit("v1."), q, F.lit("+"), n)).when(k % 3 == 1, F.concat(F.lit("1."), q, F.lit("-alpha."), n)).otherwise(F.concat(F.lit("1."), q, F.lit(".0-Beta"), n))
    keyed = read(spark, d, "orders").select("o_orderkey", "o_custkey", version_key(raw).alias("key"))
    place = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("key"))
    return keyed.select("o_orderkey", place.cast("long").alias("place"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS INT) AS cores, p_size::DOUBLE AS vram, ['cpu', ' GPU ', 'Hybrid', 'auto'][p_partkey % 4 + 1] AS mode, p_partkey % 5 = 0 AS none FROM part),
b AS (SELECT *, CASE WHEN cores >= 32 THEN 16 WHEN cores >= 16 THEN 8 WHEN cores >= 8 THEN 4 WHEN cores >= 4 THEN 2 ELSE 1 END AS base, CASE WHEN vram < 3.5 THEN 1 WHEN vram < 7 THEN 2 WHEN vram < 14 THEN 4 WHEN vram < 28 THEN 8 ELSE 16 END AS gpu FROM p),
h AS (SELECT *, least(base, 16, gpu + 1) AS lim FROM b),
l AS (SELECT *, CASE WHEN mode = 'cpu' THEN base WHEN none THEN CASE WHEN mode = 'auto' THEN least(base, 4) ELSE 1 END WHEN mode = 'Hybrid' THEN CASE WHEN lim >= 16 THEN 16 WHEN lim >= 8 THEN 8 WHEN lim >= 4 THEN 4 WHEN lim >= 2 THEN 2 ELSE 1 END ELSE least(base, gpu) END AS lanes FROM h)
SELECT p_partkey, lanes, CASE WHEN mode = 'cpu' OR none THEN lanes ELSE least(base, 16, 2 * lanes) END AS ceiling FROM l""")
def lane_policy(spark, d):
    """Parts as machines: the size gives processors and graphics memory, every fifth has no graphics device."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("int")
    mode = F.element_at(F.array(*map(F.lit, ("cpu", " GPU ", "Hybrid", "auto"))), (k % 4 + 1).cast("int"))
    at = (mode, n, F.lit(32 << 30), F.when(k % 5 != 0, n.cast("double")))
    return read(spark, d, "part").select("p_partkey", policy.lanes(*at).alias("lanes"), policy.probe_ceiling(*at).alias("ceiling"))


@query("SELECT p_partkey, 2 * CAST(p_size AS BIGINT) * 1048576 + 536870912 AS needed FROM part")
def disk_preflight(spark, d):
    return read(spark, d, "part").select("p_partkey", policy.disk_needed(F.col("p_size").cast("long") * 1048576).alias("needed"))
