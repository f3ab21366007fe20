"""Operators over payloads, scans and jobs: cases that the driver's tables don't hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cueflow.functions import sql
from cueflow.functions import text as T
from cueflow.operators import intervals, lanes, ledger, media, policy, rank, render
from cueflow.sources import media as M
from cueflow.sources import parse
from cueflow.streaming import tracker

D = "/root/testdata/sf0.001"


def _one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_every_query_equals_its_sql(spark):
    """All registered queries of these modules on the smallest tables."""
    import os

    import duckdb

    from cueflow.plans import ORACLES, QUERIES, catalogue, ledgers, lookups, payloads

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{D}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    norm = lambda v: round(float(v), 6) if isinstance(v, (float,)) or type(v).__name__ == "Decimal" else v
    for name, f in QUERIES.items():
        if f.__module__ in (catalogue.__name__, ledgers.__name__, lookups.__name__, payloads.__name__) and name in ORACLES:
            df = f(spark, D)
            found = con.execute(ORACLES[name])
            names = [x[0] for x in found.description]
            assert sorted(names) == sorted(df.columns), name
            want = sorted(repr([norm(v) for v in r]) for r in found.fetchall())
            assert sorted(repr([norm(r[c]) for c in names]) for r in df.collect()) == want, name


def test_entities_are_decoded_once(spark):
    cases = {"&amp;lt;b&gt;": "&lt;b>", "&eacute;&#233;&#xE9;&#x1F600;": "ééé😀", "&nosuch; &#xD800; &#99999999; & ;": "&nosuch; &#xD800; &#99999999; & ;", "&apos;&quot;": "'\"", "plain": "plain"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string").withColumn("got", T.decode_entities(F.col("raw")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_times_that_are_none(spark):
    bad = ["-1:02:03", "1.5:00:00", "00:01.5:02", "1e1:05", "5", "60:00", "00:60", "::", "", None, "1:2:3:4", "00:NaN", "00:1e400"]
    rows = spark.createDataFrame([(b,) for b in bad], "raw string").select(T.parse_time(F.col("raw")).alias("s")).collect()
    assert all(r["s"] is None for r in rows)
    good = spark.createDataFrame([("00:01.000",), ("1:02:03,500",), (" 00:05 ",), ("123:00:00",)], "raw string").select(T.parse_time(F.col("raw")).alias("s")).collect()
    assert [r["s"] for r in good] == [1.0, 3723.5, 5.0, 442800.0]


def test_cap_keeps_keys_without_a_verdict(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 50), (3, 50)], "k int, _ok int")
    got = rank.cap_with_fallback(df, ["k"], F.col("_ok") <= 10)
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, None), (1, None), (2, 5), (3, 50)] and got.columns == ["k", "_ok"]


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, "a"), (1, 2, 2, 2, "b")], "k int, _no int, _cls int, _key int, _any string")
    assert rank.first_by(df, ["k"], [F.desc("_no")]).first()["_any"] == "b"
    assert rank.best_class(df, ["k"], F.col("_cls")).columns == df.columns
    assert rank.precedence_union([df, df], F.col("k").cast("string"), [F.col("_no")]).first()["_no"] == 1
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, "x", 7, 7), (1, 1, 1.1, 2.0, "x", 7, 7)], "source_id int, ord int, start double, end double, text string, _run int, _new int")
    assert [tuple(r) for r in intervals.coalesce(cues).collect()] == [(1, 0.0, 2.0, "x")]


def test_payload_kinds_and_rejects(spark):
    rows = [(1, '﻿ \n{"body":[{"from":1,"to":2,"content":"a&amp;b"},{"content":" "}]}'), (2, "[1]"), (3, "x"), (4, None), (5, '{"events":[{"tStartMs":1500,"segs":[{"utf8":"q"},{}]}]}'), (6, "00:01 --> 00:02 x\n--> body\n\n00:03 -->")]
    df = spark.createDataFrame(rows, "source_id int, payload string")
    assert sorted(map(tuple, parse.read_cues(df).collect())) == [(1, 0, 1.0, 2.0, "a&b"), (5, 0, 1.5, 1.5, "q"), (6, 0, 1.0, 2.0, "--> body")]
    assert sorted(map(tuple, parse.rejected(df).collect())) == [(2, "no body or events"), (3, "no cue"), (4, "empty")]


def test_numbers_and_streams(spark):
    raw = '{"formats":[{"format_id":"a","url":"u","vcodec":"avc1","acodec":"NONE","height":" 719.5 ","filesize":-1,"filesize_approx":"10.9"},{"format_id":"b","url":" ","vcodec":"vp9"},{"format_id":"c","url":"u","acodec":"aac","height":"x"}]}'
    f = M.formats(spark.createDataFrame([(1, raw), (2, "{"), (3, None)], "source_id int, payload string"))
    got = {r["format_id"]: tuple(r)[1:] for r in f.select("format_id", media.is_video(), media.is_audio(), media.stream_height(F.col("height")), media.stream_size(F.col("filesize"), F.col("filesize_approx"))).collect()}
    assert got == {"a": (True, False, 720, 10), "b": (False, False, 0, 0), "c": (False, True, 0, 0)}


def test_best_video_ranks_codecs_only_where_asked(spark):
    rows = [(1, i, "u", c, "", h, None, None, None) for i, (c, h) in enumerate([("av01", 720.0), ("hvc1", 720.0), ("avc1", 720.0), ("avc1", None)])]
    f = spark.createDataFrame(rows, "k int, ord int, url string, vcodec string, acodec string, height double, fps double, quality double, tbr double")
    best = lambda cap, avc: media.best_video(f, ["k"], F.lit(cap), F.lit(avc)).first()["ord"]
    assert best(0, True) == 2 and best(0, False) == 0 and best(480, True) == 3
    assert media.best_video(f.filter("height is not null"), ["k"], F.lit(480), F.lit(True)).first()["ord"] == 2


def test_wire_messages():
    assert M.wire_fields(bytes([0x08, 0x96, 0x01, 0x12, 0x02, 0x68, 0x69, 0x1D, 1, 0, 0, 0])) == [(1, 0, 150, None), (2, 2, None, b"hi"), (3, 5, 1, None)]
    for bad in (b"\x00", b"\x0b", b"\x0f", b"\x12\x05hi", b"\x08", b"\x08" + b"\xff" * 10 + b"\x01"):
        with pytest.raises(ValueError):
            M.wire_fields(bad)


def test_pictures_of_a_stream(spark):
    df = spark.createDataFrame([(1, b"x\xff\xd8a\xff\xd9y\xff\xd8b\xff\xd9\xff\xd8c"), (2, b""), (3, None)], "source_id int, payload binary")
    assert [(r["source_id"], r["frame"], bytes(r["picture"])) for r in M.frames(df).collect()] == [(1, 0, b"\xff\xd8a\xff\xd9"), (1, 1, b"\xff\xd8b\xff\xd9")]


def test_topology(spark):
    def lane(k, i, a, b, **other):
        return {"k": k, "index": i, "core_start": a, "core_end": b, "scan_start": max(0.0, a - 1), "scan_end": min(20.0, b + 1), "media": b, "frames": 5, "images": 5, "n": 2, **other}

    good = [lane(1, 0, 0.0, 10.0), lane(1, 1, 10.0005, 20.0)]
    bad = {2: [{}, {"core_start": 10.5}], 3: [{"images": 6}, {}], 4: [{}, {"index": 2}], 5: [{"media": math.nan}, {}], 6: [{"n": 3}, {"n": 3}], 7: [{}, {"scan_end": 19.0}], 8: [{"core_start": 0.5, "scan_start": 0.0}, {}]}
    rows = good + [lane(k, i, *((0.0, 10.0), (10.0, 20.0))[i]) | o for k, os in bad.items() for i, o in enumerate(os)]
    df = spark.createDataFrame(rows, "k int, index int, core_start double, core_end double, scan_start double, scan_end double, media double, frames long, images long, n int")
    got = {r["k"]: r["valid"] for r in lanes.valid_topology(df, ["k"], F.lit(20.0), F.col("n")).collect()}
    assert got == {1: True} | {k: False for k in bad}


def test_job_states_stop_at_the_first_final_one(spark):
    rows = [(1, 0, "running", 10.0, "a"), (1, 1, None, -1.0, None), (1, 2, "error", 40.0, "b"), (1, 3, "done", 100.0, "c"), (2, 0, None, 300.0, "x"), (3, 0, "running", 5.0, "r"), (3, 1, "done", -1.0, "d")]
    df = spark.createDataFrame(rows, "job int, i int, s string, p double, m string")
    got = {r["job"]: tuple(r)[1:] for r in ledger.job_states(df, ["job"], [F.col("i")], F.col("s"), F.col("p"), F.col("m")).collect()}
    assert got == {1: ("error", 40.0, "b", True), 2: ("queued", 100.0, "x", False), 3: ("done", 100.0, "d", True)}


def test_attempts(spark):
    gained = [70_000, 10, 10, 0, 0, 70_000, 0]
    df = spark.createDataFrame([(1, i, g) for i, g in enumerate(gained)], "k int, i int, g long")
    got = [tuple(r)[3:] for r in ledger.attempts(df, ["k"], [F.col("i")], F.col("g"), F.lit(1 << 20), F.lit(False)).orderBy("i").collect()]
    assert got == [(1, 0, False, 100), (2, 1, False, 200), (3, 2, True, 300), (4, 3, False, 2250), (5, 4, True, 4000), (6, 0, False, 600), (7, 1, False, 250)]


def test_small_functions(spark):
    assert _one(spark, T.human_bytes(F.lit(1536)), T.human_bytes(F.lit(-3)), T.clock(F.lit(3599.9)), T.clock(F.lit(3600.0)), T.speed_label(F.lit(1500000.0)), T.encode_parameter(F.lit("a b!~é"))) == ("1.5 KB", "0 B", "59:59", "01:00:00", "1.4 MiB/s", "a+b~%C3%A9")
    assert _one(spark, T.raw_language(F.lit("ai:ai-zh")), media.track_priority(F.lit("ai:ai-zh"), F.lit(False), F.lit(True)), T.codec_rank(F.lit("HEV1.1")), T.log_message(F.lit(" a\r\nb\rc ")), T.compact(F.lit("a  b c"), 3)) == ("ai-zh", 3, 1, "a ⏎ b c", "a b…")
    pairs = _one(spark, T.key_values(F.lit("Cookie: a=1; A=2; b =x=y; bad name=1; c")))[0]
    assert [(p["name"], p["value"]) for p in pairs] == [("a", "1"), ("b", "x=y")]
    assert _one(spark, policy.http_only(F.lit("HTTPS://h/x")), policy.http_only(F.lit("ftp://h")), policy.http_only(F.lit("/x")), policy.explicit_lanes(F.lit(9), F.lit(500.0), F.lit(16))) == ("HTTPS://h/x", None, None, 4)


def test_reconcile_owns_cleans_and_merges(spark):
    """Against a plain fold: cues of lanes that overlap, texts that differ a little, texts that are refused."""
    rng = random.Random(9)
    plan = lanes.lane_plan(spark, 480.0, 4, 12.0)
    cues = [(rng.choice([1, 1, 2]), rng.randrange(4), i, round(rng.random() * 480, 2), rng.choice(["abcdefgh", "abcdefgx", "other one", "no"]), rng.random()) for i in range(500)]
    cues = [(s, n, o, a, round(a + rng.random() * 3, 2), t, c) for s, n, o, a, t, c in cues]
    want = []
    for source in (1, 2):
        out = []
        for _, n, _, a, b, t, c in sorted((x for x in cues if x[0] == source), key=lambda x: (x[3], x[1], x[2])):
            if not (120 * n <= a < 120 * (n + 1) or n == 3 and a == 480) or t == "no":
                continue
            if out and a <= out[-1][1] + 0.25 and (t == out[-1][2] or {t, out[-1][2]} == {"abcdefgh", "abcdefgx"}):
                out[-1][1], out[-1][3], out[-1][4] = max(out[-1][1], b), max(out[-1][3], c), out[-1][4] + 1
            else:
                out.append([a, b, t, c, 0])
        want += [(source, *x) for x in out]
    df = spark.createDataFrame(cues, "source_id long, lane int, ord long, start double, end double, text string, confidence double")
    got = intervals.reconcile(df, plan=plan, accept=F.when(F.col("text") != "no", F.col("text")))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(x[5] for x in want)


def test_tracker_restores_and_says_when_to_stop():
    accept = lambda t: None if t == "bad" else t
    s = tracker.start_state({"start": 1.0, "end": 1.5, "text": "hello", "conf": 0.9}, accept)
    assert tracker.safe_to_stop(s) and tracker.start_state({"start": 0.0, "end": 1.0, "text": "bad", "conf": 1.0}, accept)["active"] is None
    out: list = []
    tracker.observe(s, 2.0, "other", 0.9, 4.0, 0.68, accept, out)
    assert not tracker.safe_to_stop(s)
    tracker.observe(s, 2.25, "other", 0.9, 4.0, 0.68, accept, out)
    assert out == [(1.0, 2.0, "hello", 0.9)] and tracker.safe_to_stop(s)
    tracker.finish(s, 3.0, 4.0, out, accept)
    assert out[1:] == [(2.0, 3.0, "other", 0.9)]


def test_rendered_files(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 1.5, "a"), (1, 1, 2.0, 3.0005, "b"), (1, 2, 4.0, 5.0, ""), (1, 3, 6.0, 7.0, "a")], "k int, ord int, start double, end double, text string")
    blocks = render.srt_blocks(cues, ["k"], [F.col("ord")], F.when(F.col("text") != "", F.col("text")))
    assert render.srt_files(blocks, ["k"]).first()["content"] == "1\n00:00:00,000 --> 00:00:01,500\na\n\n2\n00:00:02,000 --> 00:00:03,000\nb\n\n3\n00:00:06,000 --> 00:00:07,000\na\n\n"
    assert render.plain_text(cues, ["k"], F.col("ord")).first()["content"] == "a\nb\n"
    import json

    assert json.loads(render.cue_json(cues, ["k"], F.col("ord")).first()["content"])[1] == {"Start": 2.0, "End": 3.0005, "Text": "b"}


def test_pictures_over_borders(spark, monkeypatch):
    """Every way to cut a stream into two ranges, and into ranges of every size: the pictures of the whole stream."""
    b, e = b"\xff\xd8", b"\xff\xd9"
    stream = b"\xff" + e + b"ab" + b + b"x\xff" + b + b"1" + e + e + b + e + b"\xff" + b + b"\xff\xff" + e + b"zz" + b + b"open"
    want = [r.picture for r in M.frames(spark.createDataFrame([(1, stream)], "source_id int, payload binary")).orderBy("frame").collect()]
    rows = [(cut * 100, i, p) for cut in range(1, len(stream)) for i, p in enumerate((stream[:cut], b"", stream[cut:]))]
    rows += [(-size, i, stream[at : at + size]) for size in range(1, 9) for i, at in enumerate(range(0, len(stream), size))]
    got = {}
    for r in M.frames_of_ranges(spark.createDataFrame(rows, "source_id int, no int, data binary")).orderBy("source_id", "frame").collect():
        got.setdefault(r.source_id, []).append((r.frame, bytes(r.picture)))
    assert len(want) == 3 and len(got) == len(stream) - 1 + 8 and all(v == list(enumerate(map(bytes, want))) for v in got.values())
    monkeypatch.setattr(M, "PENDING_MOST", 6)
    with pytest.raises(Exception, match="no end"):
        M.frames_of_ranges(spark.createDataFrame([(1, 0, b + b"123"), (1, 1, b"4567")], "source_id int, no int, data binary")).collect()


def test_ranges_are_not_broadcast(spark, tmp_path):
    """Ranges cut from a table, however small Spark takes them for, go through no broadcast; a stream without an id is a stream."""
    data = b"x\xff\xd8abc\xff\xd9--\xff\xd8d\xff\xd9\xff\xd8open"
    spark.createDataFrame([(i or None, data * (1 + i % 3)) for i in range(20)], "source_id int, payload binary").coalesce(1).write.parquet(f"{tmp_path}/streams")
    streams = spark.read.parquet(f"{tmp_path}/streams")
    got = M.frames_of_ranges(M.byte_ranges(streams, 4))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r.source_id or 0, r.frame, bytes(r.picture)) for r in df.collect())
    assert rows(got) == rows(M.frames(streams)) and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_probed_cases(spark):
    """Values that came out wrong once."""
    rows = [(1, "hello"), (2, None), (3, None), (4, "HELLO")]
    df = spark.createDataFrame(rows, "i int, k string")
    got = rank.precedence_union([df, df.filter("i < 3")], F.col("k"), [F.col("i")]).collect()
    assert sorted((r.i, r.src_rank) for r in got) == [(1, 0), (2, 0), (2, 1), (3, 0)]
    names = {"CON.a.txt": "CON.a.txt", "\tname": "name", "con.txt": "_con.txt", "nul": "_nul", "a/b": "a_b", " . ": "file", None: "file", "x" * 200: "x" * 150}
    made = spark.createDataFrame([(k,) for k in names], "n string").select("n", T.safe_filename(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in made} == names
    lines = {"ABC…你好": None, "你好 ABC…": None, "VIP会员…": "VIP会员…", "你好…": "你好…"}
    made = spark.createDataFrame([(k,) for k in lines], "n string").select("n", T.script_normalize(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in made} == lines
    timed = spark.createDataFrame([(1, "00:01 --> 00:02\nhello\n\u00a0\nworld")], "source_id int, payload string")
    assert [r.text for r in parse.read_cues(timed).collect()] == ["hello"]


def test_cues_in_sql(spark):
    """cue_list gives what the DataFrame parser gives, and its rows need no shuffle."""
    some = ["hello", "\ufeff \n1\n00:00:01,5 --> 00:00:02.25 x\n<b>A</b> &amp; &#x4f60;&bogus;&#39;&apos; \n\u00a0\nworld\n\n2\n00:01 --> 1:02\n t \n\n0:0:61 --> 0:0:62\nno", "", None]
    some += ["WEBVTT\r\n\r\n01:02.5 --> 01:03\r\nx\r\n\r\n\r\n1:00:00 --> bad\n1:00:00 --> 1:00:01\ny --> z", "00:00:01 -->\nx", "--> 00:00:01\n\n -->", "[1]", '{"x":1}']
    some += ['{"body":[{"from":1,"to":2.5,"content":" a &lt;b "},{"content":""},{"to":3,"content":"z"},null]}', '{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"a"},{"utf8":null},{"utf8":"b"}]},{"tStartMs":5},null]}']
    df = spark.createDataFrame(list(enumerate(some)), "source_id int, payload string")
    sql.register(spark)
    got = spark.sql("SELECT source_id, c.* FROM (SELECT source_id, cue_list(payload) AS cues FROM {p}), LATERAL inline(cues) c", p=df)
    want = sorted(map(tuple, parse.read_cues(df).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_required_keys(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x")], "k int, w string")
    with pytest.raises(Exception, match="no such key: 2"):
        rank.require(left, right, ["k"]).collect()
    assert [tuple(r) for r in rank.require(left.filter("k = 1"), right, ["k"]).collect()] == [(1, "a", "x")]


def test_refetches(spark):
    rounds = spark.createDataFrame([(1, 0, "A", 0, 2), (1, 1, "a", 5, 1), (1, 2, "a", 6, 3), (1, 3, "b", 6, 1), (2, 0, "x", 1, 0), (2, 1, "x", 1, 1)], "k int, round long, format_id string, size int, endpoints int")
    at = spark.createDataFrame([(k, g) for k in (1, 2) for g in range(8)], "k int, generation long")
    got = {(r.k, r.generation): (r["round"], r.endpoint, r.stopped) for r in ledger.refetched(at, rounds, ["k"]).collect()}
    assert [got[1, g] for g in range(7)] == [(0, 0, None), (0, 1, None), (1, 0, None), (None, None, "size"), (None, None, "size"), (None, None, "size"), (None, None, "size")]
    assert got[1, 7] == (None, None, "rounds") and got[2, 0] == (1, 0, None) and got[2, 1] == (None, None, "rounds")


def test_cube_sketches(spark):
    """Estimates within five per cent of many values, exact for few; sums as without sketches."""
    df = spark.range(60000).selectExpr("id % 3 as k", "id % 2 as d", "1.5D as v", "cast(id % 20011 as string) as t", "cast(id % 9 as string) as few")
    rows = lanes.cube(df, ["k", "d"], ["v"], {"t": "texts", "few": "kinds"}).collect()
    assert len(rows) == 12 and all(r.v == 1.5 * r["rows"] and r.kinds == (3 if r.k is not None else 9) for r in rows)
    for r in rows:
        exact = df.filter(("true" if r.k is None else f"k = {r.k}") + " and " + ("true" if r.d is None else f"d = {r.d}")).select("t").distinct().count()
        assert abs(r.texts - exact) <= 0.05 * exact


def test_a_payload_is_parsed_once(spark):
    """from_json stands once in the optimised plan of each parser."""
    df = spark.createDataFrame([(1, "{}", ".mp4")], "source_id int, payload string, ext string")
    for out in (M.endpoint_items(df), M.probes(df), M.checkpoint_lanes(df), M.formats(df)):
        assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") + out._jdf.queryExecution().optimizedPlan().toString().lower().count("jsontostructs") == 1


def test_resume_parts_of_a_long_document(spark, tmp_path):
    """A document of over a hundred parts: what its manifest lists beside the SQL's parts lies past its plan."""
    import duckdb

    from cueflow.plans import ORACLES, QUERIES

    spark.createDataFrame([(1, 128657), (2, 101377), (3, 10), (7, 128657)], "doc_id long, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["resume_parts"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES["resume_parts"]).fetchall())


def test_endpoints_are_made_within_their_row(spark, tmp_path):
    """Repeated and null keys as the SQL has them, a row a payload; nothing is sorted or aggregated; routes of tables agree."""
    import duckdb

    from cueflow.plans import ORACLES, QUERIES

    spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, None)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("endpoint_map", "endpoint_enrich"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES[name]).fetchall())
        assert not any(x in got._jdf.queryExecution().toString() for x in ("Sort", "Aggregate", "Join"))
    items = [("Hi", " ", "http://a/", None, ["http://b/", "http://a/", None, "ftp://c/"], None), ("HI", None, None, "http://d/", None, ["http://b/"]), (None, "http://e/-7.m4s", None, None, None, None), (" ", "http://f/", None, None, None, None), ("x", "file://g", None, None, ["http://h/"], None)]
    item = "array<struct<id: string, baseUrl: string, base_url: string, url: string, backupUrl: array<string>, backup_url: array<string>>>"
    df = spark.createDataFrame([(1, items), (2, []), (3, None)], f"k int, items {item}")
    endpoints = media.endpoint_urls(df, ["k"], F.col("items"))
    assert sorted(map(tuple, endpoints.collect())) == [(1, "7", ["http://e/-7.m4s"]), (1, "hi", ["http://a/", "http://b/", "http://d/"])]
    formats = spark.createDataFrame([(1, "hI", "own"), (1, "x", "own"), (2, "7", "own")], "k int, format_id string, url string")
    by_join = sorted((r.k, r.format_id, r.urls) for r in media.transport_routes(formats, endpoints, ["k"]).collect())
    by_row = formats.join(df, "k").select("k", "format_id", media.routes_of(F.col("format_id"), F.col("url"), media.endpoint_lists(F.col("items"))).alias("urls"))
    assert sorted(map(tuple, by_row.collect())) == by_join == [(1, "hI", ["http://a/", "http://b/", "http://d/"]), (1, "x", ["own"]), (2, "7", ["own"])]
