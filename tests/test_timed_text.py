"""Fixtures of the timed-text operators, and the coalescing windows against a plain fold."""

import random
from collections import Counter, defaultdict

from cueflow.operators import intervals
from cueflow.streaming import tracker

D = "/root/testdata/sf0.001"


def test_coalesce_is_the_fold(spark):
    rng = random.Random(3)
    cues = [(rng.randrange(3), i, round(rng.random() * 20, 2), 0.0, rng.choice("ab")) for i in range(200)]
    cues = [(s, o, a, round(a + rng.choice([0, 0.1, 0.5, 2]), 2), t) for s, o, a, _, t in cues]
    want = []
    for src in range(3):
        out = []
        for _, _, a, b, t in sorted((c for c in cues if c[0] == src), key=lambda c: (c[2], c[1])):
            b = a + 1.5 if b <= a else b
            if out and out[-1][2] == t and a <= out[-1][1] + 0.15:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b, t])
        want += [(src, *x) for x in out]
    df = spark.createDataFrame(cues, "source_id int, ord int, start double, end double, text string")
    for rows in (1 << 16, 40, 7, 1):  # a source in one cell, in several, in one for nearly every row
        assert sorted(tuple(r) for r in intervals.coalesce(df, cell_rows=rows).select("source_id", "start", "end", "text").collect()) == sorted(want)


def _active(frames, fps, low):
    s, out = tracker.start_state(), []
    for at, text in frames:
        tracker.observe(s, at, text, 0.60, fps, low, lambda t: None if t == "A N" else t, out)
    return s["active"] is not None


def test_tracker_confirmation():
    assert _active([(0, "你好"), (2 / 3, "你好")], 1.5, 0.58)
    assert not _active([(0, "你好"), (0.25, "你好")], 1.5, 0.68)
    assert _active([(0, "你好"), (0.25, "你好"), (0.5, "你好")], 1.5, 0.68)
    assert not _active([(0, "你好"), (0.25, "A N"), (0.5, "你好")], 1.5, 0.58)


def test_folds_hold_no_group(spark):
    """Lanes that span many batches come out as by a plain fold, and no whole lane goes to one Python frame."""
    rng = random.Random(6)
    rows = [(lane, i, i / 4, rng.choice(["abcd", "abcd", "abcd", "wxyz", None]), 0.5 + rng.random() / 2) for lane in (1, 2, None) for i in range(300)]
    cues = [(rng.choice([1, 1, 1, 2]), rng.randrange(4), i, round(rng.random() * 90, 2), rng.choice(["abcdefgh", "abcdefgx", "other"]), rng.random()) for i in range(600)]
    cues = [(s, n, o, a, round(a + rng.random(), 2), t, c) for s, n, o, a, t, c in cues]
    want, merged = [], []
    for lane in (1, 2, None):
        s, out = tracker.start_state(), []
        for _, _, at, text, conf in (r for r in rows if r[0] == lane):
            tracker.observe(s, at, text, conf, 4.0, 0.68, lambda t: t, out)
        tracker.finish(s, 299 / 4 + 0.25, 4.0, out)
        want += [(lane, *x) for x in out]
    for source in (1, 2):
        out = []
        for _, _, _, a, b, t, c in sorted((x for x in cues if x[0] == source), key=lambda x: (x[3], x[1], x[2])):
            if out and a <= out[-1][1] + 0.25 and (t == out[-1][2] or {t, out[-1][2]} == {"abcdefgh", "abcdefgx"}):
                out[-1][1], out[-1][3], out[-1][4] = max(out[-1][1], b), max(out[-1][3], c), out[-1][4] + 1
            else:
                out.append([a, b, t, c, 0])
        merged += [(source, *x) for x in out]
    rng.shuffle(rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "7")
    try:
        tracked = tracker.track(spark.createDataFrame(rows, "lane long, ord long, at double, text string, confidence double"))
        given = spark.createDataFrame(cues, "source_id long, lane int, ord long, start double, end double, text string, confidence double")
        reconciled = intervals.reconcile(given)
        for rows_ in (50, 3):
            assert sorted(map(tuple, intervals.reconcile(given, cell_rows=rows_).collect()), key=repr) == sorted(merged, key=repr)
        assert sorted(map(tuple, tracked.collect()), key=repr) == sorted(want, key=repr) and len(want) > 30
        assert sorted(map(tuple, reconciled.collect()), key=repr) == sorted(merged, key=repr) and any(x[5] for x in merged)
        for df in (tracked, reconciled):
            assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(size)


def test_point_in_interval_makes_no_pairs(spark, tmp_path):
    """Equal to its SQL on a customer with many orders, ties, nulls and repeated keys; no join of a customer with itself."""
    import duckdb

    from cueflow.plans.catalogue import ORACLES, QUERIES

    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(300), None if i % 40 == 0 else f"{1992 + rng.randrange(3)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}") for i in range(400)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, d string").selectExpr("o_custkey", "o_orderkey", "to_date(d) as o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = QUERIES["point_in_interval"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES["point_in_interval"]).fetchall())
    assert "Join" not in got._jdf.queryExecution().toString()


def test_reconcile_is_the_fold(spark):
    """Chains of texts alike to the one before but not to the first, one source with most rows, nulls, ties, clashing names."""
    from cueflow.functions.distance import similarity

    rng = random.Random(5)
    texts = ["aaaaaaaaaa", "aaaaaaaaab", "aaaaaaaabb", "aaaaaaabbb", "zz", "", "aaaaaaaaaaa", None]
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.randrange(2), i, round(rng.random() * 120, 1), rng.choice(texts), rng.choice([None, 0.1, 0.9])) for i in range(700)]
    rows = [(s, n, i, a, round(a + rng.choice([0.0, 0.1, 0.4, 3.0]), 1), t, c, 7, 8) for s, n, i, a, t, c in rows]
    want = []
    for source in (1, 2, None):
        out = []
        for _, _, _, a, b, t, c, *_ in sorted((x for x in rows if x[0] == source), key=lambda x: (x[3], x[1], x[2])):
            o = out[-1] if out else None
            if o and t is not None and o[2] is not None and a <= o[1] + 0.25 and similarity(o[2], t) >= 0.82:
                o[1], o[3], o[4] = max(o[1], b), max((v for v in (o[3], c) if v is not None), default=None), o[4] + 1
            else:
                out.append([a, b, t, c, 0])
        want += [(source, *x) for x in out]
    df = spark.createDataFrame(rows, "source_id long, lane int, ord long, start double, end double, text string, confidence double, _cell int, _key int")
    for n in (1 << 16, 60, 2):
        assert sorted(map(tuple, intervals.reconcile(df, cell_rows=n).collect()), key=repr) == sorted(want, key=repr)
    assert any(x[5] > 3 for x in want) and intervals.reconcile(df.limit(0)).count() == 0


def test_a_hot_source_is_spread(spark):
    """Cells of one source go to many tasks: no window over the source alone sees more than a row a cell."""
    df = spark.range(4000).selectExpr("1 as source_id", "id as ord", "id * 1.0D as start", "id + 0.5D as end", "cast(id div 10 as string) as text")
    out = intervals.coalesce(df, cell_rows=100)
    assert out.count() == 4000
    from cueflow.operators import scan

    placed = scan.cells(df, "source_id", "start", "k", "c", 100).groupBy("c").count().collect()
    assert len(placed) == 40 and max(r["count"] for r in placed) <= 110


def test_first_containing_is_the_search(spark):
    """Nested, long and empty spans, closed ends, ties, negative times, nulls; as many meetings as matching levels at most."""
    rng = random.Random(9)
    spans = [(rng.choice([1, 1, 1, 2, None]), a := rng.randrange(-500, 500), rng.choice([None, a - 1, a, a, a + 1, a + rng.randrange(40), a + 1 << 20]), rng.choice([None, *range(40)])) for _ in range(300)]
    points = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(-510, 520)]), i, "x") for i in range(400)]
    want = []
    for k, t, i, _ in points:
        held = [s for s in spans if None not in (*s, k, t) and s[0] == k and s[1] <= t <= s[2]]
        want.append((i, *(min(held, key=lambda s: (s[3], s[1], s[2])) if held else (None,) * 4)))
    df = spark.createDataFrame(points, "k int, t long, i int, _level string")
    sp = spark.createDataFrame(spans, "k int, a long, z long, o int")
    got = intervals.first_containing(df, sp, ["k"], "t", "a", "z", "o")
    assert got.columns == ["k", "t", "i", "_level", "span"]
    assert sorted(map(tuple, got.select("i", "span.*").collect()), key=repr) == sorted(want, key=repr) and sum(w[1] is not None for w in want) > 100
    assert intervals.first_containing(df, sp.limit(0), ["k"], "t", "a", "z", "o").filter("span is not null").count() == 0


def test_first_containing_broadcasts_nothing(spark):
    """Points and cells are many times their tables' rows, whatever Spark takes their sizes to be: no side goes to the driver."""
    spans = spark.createDataFrame([(1, 0, 9, 1), (1, 5, 1 << 20, 2)], "k int, a long, z long, o int")
    got = intervals.first_containing(spark.createDataFrame([(1, 7), (1, 99)], "k int, t long"), spans, ["k"], "t", "a", "z", "o")
    assert sorted((r["t"], r["span"]["o"]) for r in got.collect()) == [(7, 1), (99, 2)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_containing_makes_no_rows(spark):
    """A point and a span are one row of one shuffle each, whatever the spans' lengths: no row a level or a cell."""
    spans = spark.createDataFrame([(1, 0, 9, 1), (1, 5, 1 << 40, 2)], "k int, a long, z long, o int")
    got = intervals.first_containing(spark.createDataFrame([(1, 7), (1, 99), (2, 7)], "k int, t long"), spans, ["k"], "t", "a", "z", "o")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["k"], r["t"], r["span"] and r["span"]["o"]) for r in got.collect()) == [(1, 7, 1), (1, 99, 2), (2, 7, None)]


def test_first_containing_in_cells_and_batches(spark):
    """A key with most rows, cut into cells or not, in batches of any size: spans within a cell, over some, over all and past
    the last row; NaN and null keys, orders that are texts, names that clash."""
    rng = random.Random(12)
    key = lambda: (rng.choice([1, 1, 1, 1, 2, None]), rng.choice([0.5, 0.5, 0.5, float("nan")]))
    spans = [(*key(), a := rng.randrange(-300, 900), a + rng.choice([0, 0, rng.randrange(9), rng.randrange(200), rng.randrange(900), 1 << 50]), rng.choice([None, *(f"o{i}" for i in range(400))])) for _ in range(500)]
    points = [(*key(), rng.choice([None, *range(-310, 910)]), i) for i in range(700)]
    want = []
    for k, j, t, i in points:
        held = [s for s in spans if None not in (*s, k, t) and (s[0], repr(s[1])) == (k, repr(j)) and s[2] <= t <= s[3]]
        want.append((i, *(min(held, key=lambda s: (s[4], s[2], s[3]))[2:] if held else (None,) * 3)))
    p = spark.createDataFrame(points, "k int, e double, t long, cell int")
    s = spark.createDataFrame(spans, "k long, e double, t long, last long, o string")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for cell_rows, batch in ((1 << 16, "7"), (1 << 16, "10000"), (100, "7"), (9, "10000"), (1, "10000")):
        spark.conf.set(size, batch)
        try:
            got = intervals.first_containing(p, s, ["k", "e"], "t", "t", "last", "o", cell_rows=cell_rows)
            assert got.columns == ["k", "e", "t", "cell", "span"] and got.schema["span"].dataType == s.schema
            assert sorted(map(tuple, got.select("cell", "span.t", "span.last", "span.o").collect()), key=repr) == sorted(want, key=repr)
        finally:
            spark.conf.unset(size)
    assert sum(w[1] is not None for w in want) > 300 and sum(w[1] is None for w in want) > 100


def test_a_hot_key_of_the_look_up_is_spread(spark):
    """One key's points and spans go to many cells, and a cell gets of the spans that cover it whole the first alone."""
    spans = spark.range(4000).selectExpr("1 as k0", "id as t", "id + 3000 as e", "4000 - id as o")
    points = spark.range(4000).selectExpr("1 as k0", "id as t", "cast(null as long) as e", "cast(null as long) as o")
    rows = spans.unionByName(points)
    large = rows.groupBy("k0").agg({"*": "count"}).selectExpr("k0", "40L as n", "0L as low", "3999L as high")
    cells = intervals._cut(rows, large, ["k0"]).groupBy("cell").count().collect()
    assert len(cells) == 40 and max(r["count"] for r in cells) <= 301


def test_least_over_is_the_search():
    import numpy as np

    from cueflow.operators.sweep import least_over

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 100):
        first = rng.integers(0, n, 30)
        past = np.minimum(n, first + rng.choice([0, 1, 2, 5, 16, n], 30))
        assert least_over(first, past, n).tolist() == [min((i for i in range(30) if first[i] <= x < past[i]), default=30) for x in range(n)]
    assert least_over(first[:0], past[:0], 3).tolist() == [0, 0, 0]


def test_cells_cover_their_span_once(spark):
    """The cells of a span are disjoint, hold just its whole numbers and are six a level at most; huge ones are few."""
    rng = random.Random(4)
    starts = [rng.choice([0, 1, -1, rng.randrange(-300, 300), rng.randrange(-(10**4), 10**4)]) for _ in range(400)]
    rows = [(i, a, a + rng.choice([0, 1, 2, 3, 4, 15, 16, 63, 64, rng.randrange(300)])) for i, a in enumerate(starts)] + [(-1, -(1 << 61), (1 << 61) - 1), (-2, (1 << 60) + 1, (1 << 61) + 12345)]
    got = defaultdict(list)
    for r in intervals._with_cells(spark.createDataFrame(rows, "i long, a long, b long"), "a", "b", "level", "no").collect():
        got[r.i].append((r.level, r.no))
    for i, a, b in rows:
        size = [1 << intervals.BITS * k for k, _ in got[i]]
        assert sum(size) == b - a + 1 and len(size) <= 190
        if i >= 0:
            assert sorted(x for n, (_, no) in zip(size, got[i]) for x in range(no * n, no * n + n)) == list(range(a, b + 1))
            assert max(Counter(k for k, _ in got[i]).values()) <= 6


def test_small_sources_are_shuffled_once(spark):
    """Where one cell holds every source nothing is cut into cells; beside a large source the small ones still come out right."""
    rows = [(s, 0, i, i * 0.5, i * 0.5 + 0.6, "ab"[i // 7 % 2] * 9, 0.5) for s, n in ((1, 300), (2, 20), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "source_id long, lane int, ord long, start double, end double, text string, confidence double")
    for op in (intervals.reconcile, intervals.coalesce):
        whole, mixed = op(df), op(df, cell_rows=50)
        assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, mixed.collect()), key=repr) and whole.count() > 40
