"""The training-data operators against plain Python on small tables, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with helpers and results.
CLASHING = ["slot", "_slot", "_hash", "_all", "_no", "_id", "_kept", "_spans", "_strength", "m", "words", "n_words", "strength", "score"]


def some_texts(n=160, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "dü", "el", "fo", "ga") for b in ("n", "rt", "s", "ll", "mm", "x")]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 200]))]
        if i % 7 == 0:
            words += words[:20]
        if i % 5 == 0:
            words = [w + "!" for w in words]
        text = " ".join(words)
        rows.append((i, text.replace(" co", "\nco") if i % 3 else text))
    mails = ["write to a.b+c@mail.example.com, or ring +49 (30) 1234-5678 now", "host 10.0.0.1 and 999.1.1.1", "card 4111 1111 1111 1111 end", 'x token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" y']
    rows += [(200 + i, m) for i, m in enumerate(mails)]
    return rows + [(300, None), (301, ""), (None, "no id"), (5, "again five"), (5, "again five"), (302, "z " * 60_000), (303, "\t\n ")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = some_texts()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in CLASHING})


def empty_of(df):
    return df.filter("false")


def test_placement(docs):
    from cueflow.llm.sharding import lookup, place

    rows = place(docs, shards=("a", "b", "c"), slots=101).collect()
    table = lookup(("a", "b", "c"), 101)
    assert len(rows) == docs.count() and place(empty_of(docs)).count() == 0
    assert all(r["shard"] == "abc"[table[r["slot"]]] for r in rows) and {r["_slot"] for r in rows} == {"mine"}
    by_key = {}
    for r in rows:
        assert by_key.setdefault(r["doc_id"], r["shard"]) == r["shard"] or r["doc_id"] is None
    assert min(Counter(r["shard"] for r in rows).values()) > 30
    # taking a shard out moves no slot of the others but those that it frees or shifts in turn
    assert (lookup(("a", "b"), 101)[table != 2] == table[table != 2]).mean() > 0.5


def test_pieces_hold_all_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cueflow.llm.packing import pack

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in pack(docs, longest=64).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64
    want = {}
    for i, t in some_texts():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        while at < len(ids):
            n = 64 if len(ids) - at >= 64 else 1 << ((len(ids) - at).bit_length() - 1)
            want.setdefault(i, []).append((at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n])), len(ids)))
            at += n
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert pack(empty_of(docs)).count() == 0


def test_model_counts_and_scores(docs):
    from cueflow.llm import lm

    rows = some_texts()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    train = [tokens(t) for i, t in rows if fold(i) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    got = sorted((tuple(r)[:7] for r in lm.score(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((i, fold(i) == 2, len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=repr)]
    assert all(abs(g[5] - w[5]) < 1e-6 for g, w in zip(got, sorted(want, key=repr)))
    assert all(g[6] < 0 for g in got) and sum(g[6] for g in got if g[2] > 50) > sum(g[5] for g in got if g[2] > 50)
    assert lm.score(empty_of(docs)).count() == 0


def test_score_is_the_interpolation(docs, monkeypatch):
    """Score from plain counts and the weights that were learned, and what they were learned from: EM's cells hold one row a
    token of the deleted fold, with its bigram and word shares among the other training texts."""
    from cueflow.llm import lm

    seen, real = {}, lm.em

    def watched(cells, v, **how):
        seen.update(cells=cells, v=v, weights=real(cells, v, **how))
        return seen["weights"]

    monkeypatch.setattr(lm, "em", watched)
    rows = some_texts()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    bucket = lambda n: min(lm.BUCKETS - 1, n.bit_length())

    def counted(texts):
        word, pair = Counter(), Counter()
        for w in texts:
            word.update(w)
            pair.update(zip(["<s>", *w], w))
        return Counter({**word, "<s>": word["</s>"]}), pair, sum(word.values()), len(word)

    assert not {"<s>", "</s>"} & {w for _, t in rows for w in tokens(t)[:-1]}
    every, less = (counted([tokens(t) for i, t in rows if fold(i) not in out]) for out in ((2,), (2, 3)))
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in lm.score(docs).collect()), key=repr)

    cells = Counter()
    for w in (tokens(t) for i, t in rows if fold(i) == 3):
        for v, x in zip(["<s>", *w], w):
            b = bucket(less[0][v])
            cells[b, "n"] += 1
            cells[b, "p2"] += less[1][v, x] / max(1, less[0][v])
            cells[b, "p1"] += less[0][x] / less[2]
    assert seen["v"] == less[3] and cells
    for b in {b for b, _ in cells}:
        mine = seen["cells"][seen["cells"][:, 0] == b]
        assert mine[:, 1].sum() == cells[b, "n"]
        assert np.allclose([(mine[:, 1] * mine[:, i]).sum() for i in (2, 3)], [cells[b, "p2"], cells[b, "p1"]])
    assert set(seen["cells"][:, 0]) == {b for b, _ in cells}

    want = []
    for i, t in rows:
        w, total = tokens(t), 0.0
        for v, x in zip(["<s>", *w], w):
            a = seen["weights"][bucket(every[0][v])]
            total += math.log10(a[0] * every[1][v, x] / max(1, every[0][v]) + a[1] * every[0][x] / every[2] + a[2] / (every[3] + 1))
        want.append((i, len(w), total))
    want.sort(key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose(sorted(g[2] for g in got), sorted(w[2] for w in want), rtol=0, atol=1e-6)


def test_expectation_maximisation_climbs():
    from cueflow.llm import lm

    rng = np.random.default_rng(3)
    cells = np.column_stack([np.repeat(np.arange(3), 50), rng.integers(1, 90, 150), rng.random(150), rng.random(150) / 10]).astype(float)

    def likelihood(a):
        b = cells[:, 0].astype(int)
        p = a[b, 0] * np.where(b == 0, 0, cells[:, 2]) + a[b, 1] * cells[:, 3] + a[b, 2] / 101
        return float((cells[:, 1] * np.log(p)).sum())

    steps = [likelihood(lm.em(cells, 100.0, rounds=r)) for r in (0, 1, 3, 10, 100)]
    assert all(b > a - 0.05 for a, b in zip(steps, steps[1:])) and np.allclose(lm.em(cells, 100.0).sum(1), 1)


def base_spans(text):
    out = []
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    only = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_base_spans_are_those_of_the_patterns(spark, docs):
    from cueflow.llm import pii

    rng = random.Random(8)
    bits = ["a@b.c", "x..y@@z.com", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (443) 555-5793", "+12345678901234567", "4111-1111-1111-1111", "4111 1111 1111 1112", "é", " ", "-", "@", ".", "12", "token=abcd1234efgh5678ijkl"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(12))) for i in range(150)]
    got = {r["doc_id"]: [(x["kind"], x["s"], x["e"]) for x in r["spans"] if x["base"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: base_spans(t) for i, t in rows}
    again = [[(x["kind"], x["s"], x["e"]) for x in r["spans"] if x["base"]] for r in pii.find(docs.filter("doc_id >= 200")).orderBy("doc_id").collect()]
    assert again == [base_spans(t) for i, t in sorted((r for r in some_texts() if r[0] and r[0] >= 200))]
    assert pii.find(empty_of(docs)).count() == 0 and pii.mask(empty_of(docs)).count() == 0


def test_added_spans_are_decided_by_the_model(spark, monkeypatch):
    from cueflow.llm import pii

    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    good = [(i, f'set the api_key = "{key(i)}" here') for i in range(30)] + [(100 + i, f"mail me: jo{i} (at) mail{i} (dot) com ok") for i in range(30)]
    bad = [(200 + i, f"serial 7{i:03d}00000000{i:03d}9 of order") for i in range(30)] + [(300 + i, "x" * 30 + " plain words only") for i in range(30)]
    real = [(400 + i, f"pay by card 4111 1111 1111 1111 or ring +49 30 1234{i:03d}") for i in range(30)]
    df = spark.createDataFrame(good + bad + real, "doc_id long, text string")
    added = lambda rows: {r["doc_id"] for r in rows if any(not x["base"] for x in r["spans"])}
    found = added(pii.find(df).collect())
    assert {i for i, _ in good} <= found and not {i for i, _ in bad} & found
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df.withColumn("_spans", F.lit("kept"))).collect()}
    assert "<SECRET>" in masked[0] and key(0) not in masked[0] and masked[200] == dict(bad)[200]
    # labelers that say the opposite change what is found
    votes = pii._votes
    flip = lambda k, x, b: votes(k, x, b).withField("check", -votes(k, x, b)["check"]).withField("gazetteer", -votes(k, x, b)["gazetteer"]).withField("form", -votes(k, x, b)["form"]).withField("shape", F.lit(-1))
    monkeypatch.setattr(pii, "_votes", flip)
    assert added(pii.find(df).collect()) != found


def test_reliabilities():
    """A labeler that is always right counts for more than one that guesses."""
    from cueflow.llm import pii

    rng = random.Random(1)
    cells = Counter()
    for _ in range(2000):
        truth = rng.random() < 0.4
        right = 1 if truth else -1
        cells[("card", right, right if rng.random() < 0.9 else -right, rng.choice([-1, 1]), right if rng.random() < 0.9 else -right, 0, 0, True)] += 1
    rows = [dict(zip(pii.CELL, k), n=n) for k, n in cells.items()]
    post, rel = pii.em(rows)
    weight = lambda name: abs(math.log(rel["card", name, 1, 1] / rel["card", name, 1, 0]))
    assert weight("check") > weight("gazetteer") > weight("context")
    assert all((p > 0.5) == (k[1] > 0) for k, p in post.items())


def test_examples_of_a_conversation(spark):
    from cueflow.llm import chat

    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1 <|end|>"), (1, 2, "assistant", "a1"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 4, "assistant", "tie"), (2, 0, "user", "x"), (None, None, "assistant", "[INST] lone"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turn_no": F.lit("mine"), "_conv": F.lit("mine"), "p": F.lit(1)})
    got: dict = {}
    for r in chat.examples(chat.format_turns(df)).collect():
        got.setdefault(r["conv_id"], []).append((r["turn_no"], r["context"], r["target"]))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    safe = lambda t: t.replace("%", "%25").replace("<|end|>", "%3C|end|>").replace("[INST]", "%5BINST]")
    want: dict = {}
    for conv in (1, 2, 3, 9, None):
        before = ""
        for no, (_, _, role, text) in enumerate(sorted((r for r in rows if r[0] == conv), key=order)):
            head = f"<|turn|>{role}\n"
            if role == "assistant":
                want.setdefault(conv, []).append((no, before + head, text or ""))
            before += head + safe(text or "") + "<|end|>\n"
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    back = {r["conv_id"]: r for r in chat.read_back(chat.expand(chat.format_turns(df))).collect()}
    assert back[9]["n_examples"] == 350 and back[2]["n_examples"] == 0 and back[2]["context_chars"] == 0
    assert all(back[k]["context_chars"] == sum(len(c) for _, c, _ in v) and back[k]["loss_chars"] == sum(len(t) for *_, t in v) for k, v in want.items())
    assert chat.read_back(chat.expand(chat.format_turns(empty_of(df)))).count() == 0
    assert "Generate explode" in chat.read_back(chat.expand(chat.format_turns(df)))._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_and_ties(spark):
    from cueflow.llm.forest import search

    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    more = table.filter("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 10_000)
    copies = table.filter("vec_id = 7").withColumn("vec_id", F.explode(F.sequence(F.lit(20_000), F.lit(20_060)))).select("vec_id", "embedding")
    df = table.unionByName(more).unionByName(copies).unionByName(more.limit(5)).withColumn("v", F.lit("mine"))
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect()}
    ids, x = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    got: dict = {}
    for r in search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in [i for i in ids.tolist() if i % 20 == 0]:
        s = np.einsum("j,ij->i", rows[q], x)
        best = sorted((-a, i) for a, i in zip(s.tolist(), ids.tolist()) if i != q)
        mine = sorted(got[q])
        assert [k for k, *_ in mine] == list(range(1, 21)) and all(abs(rows[q] @ rows[i] - v) < 1e-9 for _, i, v in mine)
        assert [(-v, i) for _, i, v in mine] == sorted((-v, i) for _, i, v in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in best[:20]})
        total += 20
    assert hits / total >= 0.9
    # equal vectors: equal scores, smaller ids first
    same = [7, 10_007, *range(20_001, 20_061)]
    lots = [i for _, i, _ in sorted(got[20_000]) if i in same]
    assert len(lots) > 10 and lots == same[: len(lots)]
    assert search(empty_of(df), F.col("vec_id") % 20 == 0).count() == 0


def test_quality_is_learned_from_texts_alone(spark):
    from cueflow.llm import pairwise

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in pairwise.rank(docs, labels).collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(got[i]["score"], marks[i]) for i in marks if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    # held-out labels, languages and sources change nothing
    twisted = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = pairwise.rank(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), twisted)
    assert all(abs(r["score"] - got[r["doc_id"]]["score"]) < 1e-12 for r in other.collect())
    kept = pairwise.keep(docs.withColumn("_strength", F.lit("mine")), labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["predicted"]} and "_strength" in kept.columns


def test_quality_cases(docs, spark):
    from cueflow.llm import pairwise

    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = pairwise.rank(docs, none).collect()
    assert {r["score"] for r in rows} == {0.5} and len(rows) == docs.count() == pairwise.keep(docs, none).count()
    assert pairwise.rank(empty_of(docs), none).count() == 0
    x = pairwise.features([t for _, t in some_texts()])
    assert x.shape == (docs.count(), pairwise.COUNTS + sum(pairwise.BUCKETS)) and np.isfinite(x).all() and x.min() >= 0 and x.max() <= 4


def plain_verdict(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)})
    chars, lines = sum(map(len, words)), [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
    symbols, dup = sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    n = len(words)
    base = n < 10 or 100 * repeat > 20 * n
    bad = base or 10 * symbols > 4 * n or chars < 2 * n or chars > 25 * n or 10 * dup > 4 * len(t.split("\n")) or 10 * t.count("!") > 4 * n or 10 * len(re.findall("[A-Z]", t)) > 6 * chars
    return n, chars, symbols, dup, repeat, base, not bad


def test_rules_against_plain_python(docs):
    from cueflow.llm import rules

    got = sorted((tuple(r) for r in rules.measure(docs).collect()), key=repr)
    assert got == sorted(((i, *plain_verdict(t)) for i, t in some_texts()), key=repr)
    kept = rules.keep(docs)
    assert sorted(r["text"] for r in kept.collect()) == sorted(t for _, t in some_texts() if plain_verdict(t)[-1]) and set(CLASHING) <= set(kept.columns)
    assert rules.measure(empty_of(docs)).count() == 0 and rules.keep(empty_of(docs)).count() == 0
    plan = rules.keep(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 3  # into words once; the others are lines of the two rules on lines


def test_rules_are_ordered_by_rejections_per_cost(spark):
    from cueflow.llm import rules

    texts = ["a" * 30] * 40 + ["b b"] * 30 + ["c " * 20] * 10 + ["fine words here"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    planted = {"starts_a": lambda m: m("word_chars") == 30, "few": lambda m: m("n_words") < 3, "many": lambda m: m("n_words") == 20, "never": lambda m: m("n_words") < 0}
    costs = {"starts_a": 4.0, "few": 1.0, "many": 0.5, "never": 0.01}
    got = rules.order(df, planted, costs=costs)
    # few: 70 rejected per 1.0, then many: 10 per 0.5; starts_a has nothing left to reject, nor has never, which is cheaper
    assert [(x["rule"], x["rejected"]) for x in got] == [("few", 70), ("many", 10), ("never", 0), ("starts_a", 0)]
    tie = rules.order(df, {"one": planted["never"], "two": planted["never"]}, costs={"one": 1.0, "two": 1.0})
    assert [x["rule"] for x in tie] == ["one", "two"]


def test_signatures_agree_as_sets_do():
    from cueflow.llm import dedup

    rng = np.random.default_rng(6)
    for weighted in (False, True):
        agree = expected = 0.0
        for _ in range(25):
            items = rng.integers(1, 1 << 62, 120).astype(np.uint64)
            a, b = np.arange(120) < 100, np.arange(120) >= 20
            wa = wb = None
            if weighted:
                w = rng.random(120) * 3 + 0.1
                wa, wb = w[a], w[b] * 0.8
                full_a, full_b = np.where(a, w, 0), np.where(b, w * 0.8, 0)
                expected += np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
            else:
                expected += 80 / 120
            agree += (dedup.signature(items[a], wa) == dedup.signature(items[b], wb)).mean()
        assert abs(agree - expected) / 25 < 0.04


def cells(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()


def plain_classes(texts):
    sets, root = [cells(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both >= 0.8 * sum((sets[i] | sets[j]).values()):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def near_copies(seed=11):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    base = [fresh(rng.choice([4, 30, 120])) for _ in range(25)]
    texts = [" ".join(t) for t in base]
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 3, 8])):
            t[rng.randrange(len(t))] = f"x{i}"
        texts.append(" ".join(t))
    return [*texts, "", " ", " ".join(fresh(20_000))]


def test_classes_against_all_pairs(spark):
    from cueflow.llm import dedup

    texts = near_copies()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"node": F.lit("mine"), "id": F.lit("mine")})
    root = plain_classes(texts)
    want = {i: min(j for j, r in enumerate(root) if r == root[i]) for i in range(len(texts))}
    assert {r["doc_id"]: r["class_id"] for r in dedup.classes(df).collect()} == want
    kept = dedup.keep_one(df.withColumns({"_hash": F.lit("mine"), "_no": F.lit(1), "_id": F.lit(2)}))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and "_hash" in kept.columns
    assert dedup.keep_one(empty_of(df)).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as P
    from cueflow.llm import packing, pairwise, pii

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "personal_data", "packing"]
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}

    one = stages["quality_rules"](spark, docs, d)
    ids = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and ids == {i for i, t in text_of.items() if plain_verdict(t)[-1]}

    two = stages["quality_classifier"](spark, one, d)
    scores = {r["doc_id"]: r["score"] for r in pairwise.rank(one, labels).collect()}
    ids = {r["doc_id"] for r in two.collect()}
    assert two.columns == docs.columns and ids == {i for i, s in scores.items() if s >= 0.3}

    three = stages["near_dedup"](spark, two, d)
    order = sorted(ids)
    root = plain_classes([text_of[i] for i in order])
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == {min(i for i, r in zip(order, root) if r == c) for c in set(root)}

    four = stages["personal_data"](spark, three, d)
    rows = {r["doc_id"]: r for r in four.collect()}
    assert four.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert not any(base_spans(r["text"]) for r in rows.values() if base_spans(text_of[r["doc_id"]]) and "<" not in r["text"])
    weights = pii.train(three)
    assert all((rows[r["doc_id"]]["text"] == text_of[r["doc_id"]]) == (not r["spans"]) for r in pii.find(three, weights).collect())

    five = stages["packing"](spark, four, d)
    want = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(four).collect())
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in five.collect()) == want
    whole = P.run(spark, d)
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in whole.collect()) == want


def test_ann_of_huge_and_tiny_vectors(spark):
    """Squares and products that overflow or vanish, infinite components, another length: every finite vector has neighbours."""
    import math

    from cueflow.llm import forest

    rows = [(k, [1e200 * k, 1.0]) for k in range(1, 7)] + [(20, [-1e200, 2.0]), (40, [1e-200, 0.0]), (60, [3.0, 4.0]), (7, [math.inf, 0.0]), (8, [1.0]), (9, [math.nan, 1.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as page", "2 as hash")
    got = {}
    for r in forest.search(df, F.col("vec_id") % 20 == 0, k=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = {i: v for i, v in rows if i not in (7, 8, 9, 10)}
    for q in (20, 40, 60):
        every = sorted((-(fine[q][0] * v[0] + fine[q][1] * v[1]), i) for i, v in fine.items() if i != q)[:4]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(every, 1)]
