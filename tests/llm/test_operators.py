"""The training-data operators on a small table of hard cases."""

import hashlib
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"w{i} thing number{i % 7}" for i in range(120))
ROWS = [
    (1, WORDS), (2, WORDS), (3, WORDS + " tail"), (4, None), (5, ""), (None, "no id here, mail a.b@c.org or +1 (443) 555-5793"),
    (7, "ip 10.0.0.1 and 300.1.1.1 card 4111 1111 1111 1111 end"), (8, "日本語 <|endoftext|> é " * 40), (8, "again the same id"), (9, "x" * 50_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_table():
    from cueflow.llm.sharding import lookup

    t = lookup(("a", "b", "c"), 101)
    assert sorted((t == i).sum() for i in range(3)) == [33, 34, 34]
    assert (lookup(("a", "b"), 101)[t != 2] == t[t != 2]).mean() > 0.5


def test_bpe_round_trip(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cueflow.llm.codec import encode

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r)[:4] for r in encode(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert encode(empty).count() == 0


def test_packing(docs):
    from cueflow.llm.packing import pack

    rows = pack(docs, with_ids=True).collect()
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0 for r in rows)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in r["ids"])) == r["ids_crc32"] for r in rows)
    assert sum(r["length"] for r in rows if r["doc_id"] == 9) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 9)


def test_rules_and_pii(docs, empty):
    from cueflow.llm import pii, rules

    kept = {(r["doc_id"], r["n_words"]): r["kept"] for r in rules.measure(docs).collect()}
    assert kept[1, 360] and not kept[4, 0] and rules.measure(empty).count() == 0
    spans = {r["doc_id"]: [(x["kind"], x["s"]) for x in r["spans"]] for r in pii.find(docs.filter("doc_id is null or doc_id = 7")).collect()}
    assert spans == {None: [("email", 17), ("phone", 30)], 7: [("ip", 3), ("card", 31)]}
    masked = [r["text"] for r in pii.mask(docs.filter("doc_id = 7")).collect()]
    assert masked == ["ip <IP> and 300.1.1.1 card <CARD> end"]


def test_chat_round_trip(spark):
    from cueflow.llm import chat

    rows = [(1, 0, "user", "a % </s> <|end|>\n b"), (1, 1, "assistant", "[INST] %3C ok"), (1, 2, "assistant", None), (None, None, None, "x"), (2, 0, "user", "q")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    text = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[1]["loss_chars"] == 13 and got[1]["n_examples"] == 2
    assert got[None]["n_turns"] == 1 and got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_dedup(docs, empty):
    from cueflow.llm.dedup import classes

    got = {}
    for r in classes(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert got[1] == got[2] == got[3] == {1} and got[4] == got[5] == {4} and got[9] == {9}
    assert classes(empty).count() == 0


def test_forest_finds_exact_neighbours(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from cueflow.llm.forest import search

    x = np.random.default_rng(1).standard_normal((200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8)]
    got: dict = {}
    for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: set(np.argsort(-(x @ x[q] - 1e9 * (np.arange(200) == q)))[:5].tolist()) for q in range(0, 200, 20)}
    assert set(got) == set(want) and np.mean([len(got[q] & want[q]) / 5 for q in want]) >= 0.9


def test_quality_threshold_is_of_all_training_rows(spark, monkeypatch):
    """Labels past the sample's bound: as many training rows are rejected as are marked 0, as on a small table."""
    import random

    import numpy as np

    from cueflow.llm import pairwise

    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        q = int(i % 9 != 0)
        words_ = [rng.choice("abcdefgh") * rng.randrange(1, 9) + ("!" if rng.random() < (0.2 if q else 0.35) else "") for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(words_)))
        marks.append((i, q))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    monkeypatch.setattr(pairwise, "SAMPLE", 100)
    got = {r["doc_id"]: r for r in pairwise.rank(docs, labels).collect()}
    training = [i for i in got if not got[i]["held_out"]]
    zeros, n = sum(not marks[i][1] for i in training), len(training)
    assert zeros < 100 < n - zeros  # ones are thinned, zeros are not
    scores = np.array([got[i]["score"] for i in training])
    assert abs(int((scores < pairwise.CUT).sum()) - zeros) <= 1
    odds = np.log(scores / (1 - scores))
    assert np.quantile(odds, zeros / n) == pytest.approx(np.log(pairwise.CUT / (1 - pairwise.CUT)), abs=1e-9)
    assert {r["doc_id"] for r in pairwise.keep(docs, labels).collect()} == {i for i in got if got[i]["predicted"]}


def test_forest_fills_every_query(spark):
    """Copies of one vector share all bits in all trees: a small group counts once a tree and must not end a search."""
    import numpy as np
    from pyspark.sql import functions as F

    from cueflow.llm.forest import search

    x = np.random.default_rng(2).standard_normal((9, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    groups = [g for g in range(8) for _ in range(40)] + [8] * 8
    df = spark.createDataFrame([(i, x[g].tolist()) for i, g in enumerate(groups)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in search(df, F.col("vec_id") % 4 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == set(range(0, len(groups), 4))
    assert all(sorted(k for k, _ in v) == list(range(1, 21)) and len({i for _, i in v}) == 20 for v in got.values())
    assert all({i for i in range(320, 328) if i != q} <= {i for _, i in got[q]} for q in (320, 324))
    few = [r for r in search(df.filter("vec_id >= 320"), F.col("vec_id") == 320, k=20).collect()]
    assert sorted(r["vec_id"] for r in few) == list(range(321, 328))


def test_forest_descends_to_the_longest_match(spark, monkeypatch):
    """Counts of every prefix length, pages and blocks of few rows: as by comparing all strings; the ranges searched hold what was counted."""
    from collections import Counter

    import numpy as np
    from pyspark.sql import functions as F

    from cueflow.llm import forest

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((300, 6)), np.repeat(rng.standard_normal((1, 6)), 90, 0), rng.standard_normal((9, 6))[rng.integers(0, 9, 100)] + rng.standard_normal((100, 6)) * 1e-9])
    x[20] *= 1.001 * np.sqrt((x * x).sum(1).max() / (x[20] @ x[20]))  # the longest one has no further component: its row is its own match
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(forest, "PAGE_ROWS", 40)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 25)
    monkeypatch.setattr(forest, "BLOCK_QUERIES", 3)
    rows = forest.vectors(df)
    longest = float(np.sqrt((x * x).sum(1).max()) / np.abs(x).max())
    index = forest.hashed(rows, float(np.abs(x).max()), longest, False)
    queries = forest.hashed(rows.filter("vec_id % 20 = 0"), float(np.abs(x).max()), longest, True)
    bits = 4
    pages = forest._by_tree(index).groupBy("tree", F.expr(forest._page("hash", bits)).alias("page")).agg(F.count("*").alias("n"))
    got = {(r["vec_id"], r["level"]): r["total"] for r in forest.descend(index, queries, pages, bits).collect()}
    mask, h, want = (1 << 64) - 1, {r["vec_id"]: r["hashes"] for r in index.collect()}, Counter()
    for q in queries.collect():
        for row in h.values():
            for a, b in zip(q["hashes"], row):
                for level in range(1, 65 - ((a ^ b) & mask).bit_length()):
                    want[q["vec_id"], level] += 1
    assert got == dict(want) and max(level for _, level in got) == 64
    near = forest.search(df, F.col("vec_id") % 20 == 0, k=5, target=60).collect()
    assert {r["query_id"] for r in near} == set(range(0, len(x), 20)) and all(len([r for r in near if r["query_id"] == q]) == 5 for q in range(0, len(x), 20))
    for r in near:
        level = max((n for i, n in got if i == r["query_id"] and got[i, n] >= 60), default=0)
        assert (r["level"], r["n_candidates"]) == (level, got.get((r["query_id"], level), len(x)))
    everything = forest.search(df, F.col("vec_id") % 20 == 0, k=5, target=1 << 40).collect()
    best = {q: sorted((-float(x[q] @ v), i) for i, v in enumerate(x) if i != q)[:5] for q in range(0, len(x), 20)}
    assert all(r["score"] == pytest.approx(-best[r["query_id"]][r["rank"] - 1][0], abs=1e-9) for r in everything)


def test_keep_one_leaves_one_row_of_each_class(spark):
    """Repeated and null ids, against all pairs by plain Python."""
    import random
    from collections import Counter

    from cueflow.llm.dedup import keep_one

    rng = random.Random(4)
    fresh = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    base = [fresh() for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)]
    for i in range(120):  # near copies under ids of their own, ids in use and no id
        t = rng.choice(base) + ([f"x{i}"] if i % 3 else [])
        rows.append(({0: None, 1: rng.randrange(40)}.get(i % 4, 100 + i), " ".join(t)))
    for i in range(20):  # nobody's copies under ids in use and no id; two rows that are equal in all
        rows.append((None if i % 2 else i, " ".join(fresh())))
    lone = " ".join(fresh())
    rows += [(None, lone), (None, lone), (7, lone + " tail"), (8, None), (None, ""), (7, " "), rows[3], rows[3]]

    def cells(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()

    sets, root = [cells(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both >= 0.8 * sum((sets[i] | sets[j]).values()):
                root = [root[j] if r == root[i] else r for r in root]
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    want = [min((r for r, k in zip(rows, root) if k == c), key=order) for c in set(root)]
    got = [tuple(r) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_by_words_where_counts_are_alike(spark):
    """Texts of equal counts, told apart by their words alone, on the held-out fold."""
    import random

    import numpy as np

    from cueflow.llm import pairwise

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    both, own = [word() for _ in range(60)], ([word() for _ in range(40)], [word() for _ in range(40)])
    rows, marks = [], []
    for i in range(600):
        q = i % 2
        rows.append((i, " ".join(rng.sample(sorted(set(both)), 20) + rng.sample(sorted(set(own[q])), 10))))
        marks.append((i, q))
    x = pairwise.features([t for _, t in rows])
    same = x[:, : pairwise.COUNTS]
    assert x.shape[1] == pairwise.COUNTS + sum(pairwise.BUCKETS) and (same.std(0)[[c for c in range(pairwise.COUNTS) if c not in (8, 9, 10)]] < 1e-12).all()
    got = pairwise.rank(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    held = [(r["score"], r["doc_id"] % 2) for r in got if r["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert len(good) > 30 and len(bad) > 30 and np.mean([a > b for a in good for b in bad]) > 0.95


def test_measures_and_hashed_parts_against_plain_python():
    """Counts by plain Python; parts: as many buckets as different parts that don't meet, with the roots of their shares."""
    import re
    from collections import Counter

    import numpy as np

    from cueflow.llm import textnum

    long = " ".join(f"w{i % 977}" for i in range(90_000))
    texts = ["", None, " \n\t", "One two, two THREE!\nOne two, two THREE!\n\n$5 & up", "a", "ab cd ab cd ab", "Äpfel über 12;3 内容 内容", long]
    counts, grams = textnum.described(texts, 1 << 12, 1 << 12, 1 << 12)
    alone, _ = textnum.described(["zz"] * 3, 0, 0, 0)
    assert alone.shape == (3, len(textnum.MEASURED)) and (textnum.measures(texts) == counts).all()
    for text, row, gram in zip(texts, counts, grams):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        of = lambda chars: sum(t.count(c) for c in chars)
        plain = [len(w), sum(map(len, w)), of("#*$%&|<>"), of("!"), len(re.findall("[A-Z]", t)), len(re.findall("[0-9]", t)), of(".,;:?"), t.count("\n") + 1, len(lines) - len(set(lines)), len(set(lower))]
        assert row.tolist() == plain
        raw = t.encode()
        parts = (lower, list(zip(lower, lower[1:])), [raw[i : i + 3] for i in range(len(raw) - 2)])
        for k, part in enumerate(parts):
            got = gram[k << 12 : (k + 1) << 12]
            assert np.isclose((got**2).sum(), 1 if part else 0)
            if len(part) < 100:
                want = sorted(np.sqrt(n / len(part)) for n in Counter(part).values())
                assert np.allclose(sorted(got[got > 0]), want)
