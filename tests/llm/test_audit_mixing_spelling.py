"""Operators 11 to 13 against brute-force versions: every order applied filter by filter, a heap of quotients, all pairs of words."""

import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from cueflow.llm import apportion, audit, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(rng, n):
    some = ["one two three " * 20, "ALL CAPITALS HERE", "plain words of a text " * 15, "", None, "cost $5 & more", " ".join(f"w{i}" for i in range(60)), "\x0b\x1fx y"]
    ids = [rng.choice([None, 3, 4, *range(100, 160)]) for _ in range(n)]
    return [(i, rng.choice(some), "en", rng.choice(["a", "a", "a", "b", "", None]), 1) for i in ids]


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_audit_is_every_order(spark):
    rng = random.Random(11)
    docs = _texts(rng, 160)
    labels = [(3, 1, 0), (3, 0, 1), (4, 0, 0), (None, 1, 1), *[(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(100, 140)]]
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    ids_of = defaultdict(list)
    for d, t, *_ in docs:
        ids_of[t or ""] += [d] if d is not None else []

    def fails(d, t):
        t, w = t or "", _words(t)
        out = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and min(ids_of[t]) < d}
        return {k for k, v in out.items() if v}

    want = []
    parts = defaultdict(list)
    for d, t, _, s, _ in docs:
        parts[s or ""].append((d, fails(d, t)))
    for part, rows in parts.items():
        value, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                out = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                value[f] += len(out)
                steps.append((part, "".join(order), step, len(left), len(out), sum(f in r[1] for r in rows) - len(out), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in out), sum(r[0] in toxic for r in out), f))
        want += [(*s[:-1], value[s[-1]]) for s in steps]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as part", "2 as mask", "3 as digest", "4 as spread")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "5 as good", "6 as source")
    got = [tuple(r) for r in audit.audit(df, lab).collect()]
    assert sorted(got) == sorted(want) and len(got) == 600 * len(parts)
    assert audit.audit(df.limit(0), lab).count() == 0 and audit.audit(df, lab.limit(0)).count() == len(got)


def _heap(targets, most_seats, m):
    """The sequence of seats by highest quotient."""
    heap, out = [(-t, i, 0) for i, t in enumerate(targets) if most_seats[i] > 0], []
    heapq.heapify(heap)
    while len(out) < m and heap:
        _, i, k = heapq.heappop(heap)
        out.append(i)
        if k + 1 < most_seats[i]:
            heapq.heappush(heap, (-targets[i] / (2 * k + 3), i, k + 1))
    return out


def _targets(sizes, weights=(5, 2, 1), most=3):
    w, total, full = [weights[i % 3] for i in range(len(sizes))], sum(sizes), set()
    while True:
        share = (total - sum(most * sizes[i] for i in full)) / sum(w[i] for i in range(len(sizes)) if i not in full)
        more = {i for i in range(len(sizes)) if i not in full and most * sizes[i] <= share * w[i]}
        if not more:
            return [float(most * s) if i in full else share * w[i] for i, s in enumerate(sizes)]
        full |= more


@pytest.mark.parametrize("block", [1, 7])
def test_mixing_is_the_heap(spark, block):
    rng = random.Random(12)
    docs = [(rng.choice([None, 5, i]), rng.choice([None, "", " ".join(f"t{rng.randrange(9)}" for _ in range(rng.choice([1, 3, 40, 200])))]), "en", rng.choice(["a"] * 9 + ["b", "c", "ä", None, ""]), 1) for i in range(150)]
    docs += [(900 + i, "rare word", "en", "tiny", 1) for i in range(2)] + [(950, " ", "en", "void", 1)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as size", "2 as at", "3 as seats", "4 as uid")
    got = apportion.mix(df, block=block).collect()
    size = Counter()
    for _, t, _, s, _ in docs:
        size[s] += len(_words(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    targets, caps = _targets([size[s] for s in names]), [3 * -(-size[s] // block) for s in names]
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(_words(t))) for d, t, _, s, _ in docs)
    total = sum(size.values())
    m = (2 * total + block) // (2 * block)
    seats, taken, in_shard, words = _heap(targets, caps, m), Counter(), Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(targets[names.index(r.source)]) and r.source_size == size[r.source]
        spans = Counter(w for p in r.pieces for w in range(p.word_start, p.word_end))
        assert all(0 <= p.word_start < p.word_end <= r.size for p in r.pieces) and max(spans.values(), default=0) <= 3
        taken[r.source] += sum(spans.values())
        for p in r.pieces:
            in_shard[p.shard, r.source, p.block, getattr(p, "pass")] += 1
            words[p.shard] += p.word_end - p.word_start
    for i, s in enumerate(names):
        assert abs(taken[s] - targets[i]) <= 2.5 * block
    blocks = Counter((shard, s) for shard, s, _, _ in in_shard)
    want = Counter((next(j for j in range(apportion.SHARDS) if n < m * (j + 1) // apportion.SHARDS), names[i]) for n, i in enumerate(seats))
    assert blocks == want
    again = apportion.mix(df.repartition(3), block=block).collect()
    key = lambda rows: sorted((repr((r.doc_id, r.source, r.size, r.target, sum(p.word_end - p.word_start for p in r.pieces))) for r in rows))
    assert key(again) == key(got)
    assert apportion.mix(df.limit(0)).count() == 0


def test_mixing_is_its_sql(spark, tmp_path):
    rng = random.Random(13)
    docs = [(i, None if i % 31 == 0 else "w " * rng.choice([0, 1, 50, 4000]), "en", rng.choice(["a"] * 5 + ["b", "c", "d", None]), 1) for i in range(300)]
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, apportion.op12_mixing(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(apportion.ORACLE_SQL).fetchall()) and sum(r[4] for r in got) > 0


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_spelling_is_all_pairs(spark):
    rng = random.Random(13)
    base = ["straße", "wörter", "banana", "bananas", "annanan", "aaaaaa", "aaaaaaa", "colour", "color", "colours", "École", "Ünder", "letters", "abababab", "babababa", "x" * 300]

    def vary(w):
        for _ in range(rng.choice([0, 0, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abßé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("xyz") + w[i + 1 :]])
        return w

    pool = [vary(rng.choice(base)) for _ in range(150)] + base * 3
    docs = [(rng.choice([None, 7, i]), rng.choice([None, "", *[" ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in rng.choices(pool, k=60))] * 8]), "en", "s", 1) for i in range(120)]
    count = Counter()
    for d, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if _one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    want = sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as word", "2 as n", "3 as key")
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.group(df).collect())
    assert got == want and sum(len(x) for x in near.values()) > 100 and any(form[form[w]] for w in words if form[w])
    assert spelling.group(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [d[:2] for d in docs])
    sql = con.execute(f"SELECT word, coalesce(form, ''), root, n, n_near, coalesce(form_n, 0) FROM ({spelling.ORACLE_SQL})").fetchall()
    assert sorted(sql) == want


def test_lists_hold_no_probes():
    """A word's own lists are made without those that it probes; whatever letter is put in, a longer word is met in one."""
    words = ["abcde", "bcdea", "aaaaa", "éabcdé", "abcdefgh"]
    words += [w[:i] + x + w[i:] for w in words for i in range(len(w) + 1) for x in "aez"]
    places = spelling.ranks(Counter(g for w in words for g in spelling.grams(w)))
    lists = {w: spelling.own_keys(w, places) for w in words}
    assert all(len(k) == 6 for k in lists.values()) and all(len(spelling.longer_keys(w, places)) == 18 for w in words)
    for w in words[:5]:
        for i in range(len(w) + 1):
            assert set(spelling.longer_keys(w, places)) & set(lists[w[:i] + "e" + w[i:]])
