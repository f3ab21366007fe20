"""Operator 13: spelling variants one edit apart, by a positional q-gram inverted index with a count filter.

Words come from whole texts, counted per task before they are shuffled. Each word, padded at both ends, has positional
q-grams. One edit spoils at most q of a word's grams; the others stand in both words in the same order, at the same
position or, after an inserted letter, one further. So of the q + SHARED rarest grams of each of two near words (rarity:
over all words, whatever the position, one order for all) at least SHARED are common: the count filter's bound, met on the
shortest posting lists alone. An index entry is therefore a list's merge already: it is filed under SHARED grams with
their positions and the word's length, and a word probes the lists of its own length and of the next, with every shift
that one inserted letter can cause. Lists and probes come sorted out of Spark's shuffle and are merged by its merge join,
which splits crowded lists; a heap inside a task would need a word's lists in one place, and those grow with the
vocabulary. A pair is verified by the edit distance where it is found, before it goes anywhere.

The gram counts are at most (alphabet + 2)^q numbers (under 9,000): the only thing that is sent to all tasks. Roots follow
forms by doubling steps; each form has at least twice its word's count, so chains are short.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in h; rows with equal doc_id and
text count each; a run of any length is a word (its grams are all counted, its keys a fixed number); ties of forms go to
the smaller word in code-point order; an empty table gives no rows; other columns, also ones with names used here, are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only, table

# What a word is made of (UTF-8 of a-z and U+00C0 to U+00FF), and the contract's bounds.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
SPOILT_EVERY, LEAST_LETTERS, LEAST_COUNT, TIMES = 97, 5, 3, 2
Q, SHARED = 2, 2
HELD = 1 << 17


def runs(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text with their counts; A-Z alone are lower-cased (bytes.lower does just that)."""
    out: Counter = Counter()
    of = b"" if doc_id is None else str(doc_id).encode()
    for run, n in Counter(RUN.findall((text or "").encode().lower())).items():
        h = zlib.crc32(of + b":" + run)
        if h % SPOILT_EVERY == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        out[run] += n
    return out


def words(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of at least so many letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w, n in runs(doc_id, text.as_py()).items():
                    if len(w) >= letters and (len(w) >= 2 * letters or len(w.decode()) >= letters):
                        held[w] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    rows = only(docs, ("doc_id", "long"), ("text", "string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def grams(word: str, q: int = Q) -> list[str]:
    padded = "\x01" * (q - 1) + word + "\x02" * (q - 1)
    return [padded[i : i + q] for i in range(len(padded) - q + 1)]


def gram_counts(vocabulary: DataFrame, q: int = Q) -> dict[str, int]:
    """How often each gram stands in the words (positions aside): bounded by the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                held.update(grams(w, q))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    made = vocabulary.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in made.collect()}


def ranks(counts: dict[str, int]) -> dict[str, int]:
    """gram -> its place, the rarest first."""
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}


def own_keys(word: str, places: dict[str, int], q: int = Q, shared: int = SHARED) -> list[int]:
    """The lists that file a word. hash() of whole numbers is the same in every process; lists that share a key by chance
    cost a comparison."""
    rarest = sorted([(places[g], at) for at, g in enumerate(grams(word, q))])[: q + shared]
    return [hash((len(word), *sorted(some, key=_at))) for some in combinations(rarest, shared)]


def longer_keys(word: str, places: dict[str, int], q: int = Q, shared: int = SHARED) -> list[int]:
    """Those that it probes for words one letter longer."""
    rarest = sorted([(places[g], at) for at, g in enumerate(grams(word, q))])[: q + shared]
    out = []
    for some in combinations(rarest, shared):
        stay = sorted(some, key=_at)
        shift = [(g, at + 1) for g, at in stay]
        # the letter stands before the last `moved` of these grams
        out += [hash((len(word) + 1, *stay[: shared - moved], *shift[shared - moved :])) for moved in range(shared + 1)]
    return out


_at = itemgetter(1)


def near(vocabulary: DataFrame, counts: dict[str, int], q: int = Q, shared: int = SHARED) -> DataFrame:
    """a, n_a, b, n_b: each pair of words exactly one edit apart, once."""
    places = ranks(counts)

    def filed(w: str, n: str, longer: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, key, of, further = batch.column(0).to_pylist(), [], [], []
                for i, one in enumerate(word):
                    mine, next_ = own_keys(one, places, q, shared), longer_keys(one, places, q, shared) if longer else []
                    key += mine + next_
                    of += [i] * len(mine + next_)
                    further += [False] * len(mine) + [True] * len(next_)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), batch.column(0).take(pa.array(of, pa.int64())), batch.column(1).take(pa.array(of, pa.int64())), pa.array(further, pa.bool_())], names=["key", w, n, "longer"])

        return vocabulary.select("word", "n").mapInArrow(run, f"key long, {w} string, {n} long, longer boolean")

    probes, lists = filed("a", "n_a", True), filed("b", "n_b", False).drop("longer")
    met = probes.join(lists.hint("merge"), "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def forms(vocabulary: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word, where it has `times` the word's count."""
    one = lambda w, n, x, m: pairs.select(F.col(w).alias("word"), F.col(n).alias("n"), F.struct((-F.col(m)).alias("minus"), F.col(x).alias("form")).alias("other"))
    links = one("a", "n_a", "b", "n_b").unionByName(one("b", "n_b", "a", "n_a"))
    alone = vocabulary.select("word", "n", F.lit(None).cast("struct<minus: long, form: string>").alias("other"))
    out = links.unionByName(alone).groupBy("word", "n").agg(F.count("other").alias("n_near"), F.min("other").alias("best"))
    fine = -F.col("best.minus") >= times * F.col("n")
    return out.select("word", "n", "n_near", F.when(fine, F.col("best.form")).alias("form"), F.when(fine, -F.col("best.minus")).alias("form_n"))


def roots(words_: DataFrame, keep: Scratch) -> DataFrame:
    """word, root for the words that have a form, by doubling: after k rounds a root is 2^k forms away or the last."""
    up = keep.write(words_.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = keep.write(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = after.filter("moved").limit(1).count()
        keep.drop(up)
        up = after.drop("moved")
        up.scratch_path = after.scratch_path
        if not moved:
            return up


def group(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    keep = Scratch(docs.sparkSession)
    vocabulary = keep.write(words(docs, letters, least), "vocabulary")
    pairs = near(vocabulary, gram_counts(vocabulary))
    found = keep.write(forms(vocabulary, pairs, times), "forms")
    keep.drop(vocabulary)
    return found.join(roots(found, keep), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


# The checksum of one byte is linear: the xor of those of its bits.
_STEP = "c >> 8"
for _bit in range(8):
    _own = zlib.crc32(bytes([1 << _bit])) ^ zlib.crc32(b"\0")
    _STEP = f"xor({_STEP}, ((xor(c, b) >> {_bit}) & 1) * {_own})"

ORACLE_SQL = rf"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS no, coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM docs) WHERE length(run) >= {LEAST_LETTERS} GROUP BY id, run),
bytes AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END)) AS bs FROM runs),
sums AS (SELECT run, n, xor(list_reduce(bs, lambda c, b: {_STEP}, CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {SPOILT_EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
pairs AS (SELECT x.word AS a, y.word AS b, y.n AS m FROM less x JOIN less y USING (rest, i) WHERE x.word <> y.word
  UNION SELECT l.word, v.word, v.n FROM less l JOIN vocabulary v ON v.word = l.rest UNION SELECT v.word, l.word, l.n FROM less l JOIN vocabulary v ON v.word = l.rest),
best AS (SELECT a, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY a),
first AS (SELECT a, any_value(n_near) AS n_near, any_value(best.m) AS m, min(b) AS b FROM pairs JOIN best USING (a) WHERE pairs.m = best.m GROUP BY a),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN b END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM vocabulary LEFT JOIN first ON a = word),
up AS (SELECT word, form AS root, form AS at FROM found WHERE form IS NOT NULL UNION ALL SELECT up.word, found.form, found.form FROM up JOIN found ON found.word = up.at WHERE found.form IS NOT NULL),
ends AS (SELECT up.word, up.root FROM up JOIN found ON found.word = up.root WHERE found.form IS NULL)
SELECT found.word, form, coalesce(ends.root, found.word) AS root, n, n_near, form_n FROM found LEFT JOIN ends USING (word)"""
