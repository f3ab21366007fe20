"""Operator 8: quality by Bradley-Terry pairwise ranking.

A document's strength is w.x, x being measures of its text alone. In a pair of a document marked 1 and one
marked 0 the first wins; w minimises the logistic loss of feature differences over PAIRS such pairs. The
score is a logistic curve of the strength that passes 0.3 at the strength below which lies the share of
training rows that is marked 0 (a quantile), so `score >= 0.3` is that quantile as a threshold.

Training rows: labelled documents outside the held-out fold. The weights come from at most SAMPLE of each
label, those of the least hashes of their id (a documented bound; what comes to the driver is that many rows of
features). The threshold comes from all of them, whatever the sample: the strengths of all documents are
written once (id, fold and strength), and the exact quantile of the training rows' is taken there.

Measures are counts over the bytes of whole texts and, beside them, the shares of hashed words, pairs of words and
runs of three bytes (BUCKETS of each), made with numpy in batches of rows; a very long text takes
memory in proportion to its own length. The shares have a stronger ridge than the counts: they tell where counts
are alike, and add little where counts tell. Only ids and strengths are shuffled, to meet the labels.

Defined cases: null text is an empty text and has a score; null and repeated doc_id stay, one row each (a repeated
doc_id takes part in training with every row of it); equal texts have equal scores; a label that is null counts as
none, of repeated labels the least counts; without both labels every score is 0.5; an empty table gives no rows;
other columns (lang, source) are never read, `keep` leaves them as they are whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, digest_of, fresh, only, table
from .textnum import described

SAMPLE, PAIRS, CUT = 20_000, 50_000, 0.3
#: Buckets of words, of pairs of words and of runs of three bytes.
BUCKETS = (256, 128, 128)
#: Pairs whose differences are in memory at once.
CHUNK = 4096
FOLDS, HELD_OUT = 5, 0
#: Ranks of percentile_approx are off by 1 / RANKS of the rows at most.
RANKS = 100_000


def features(texts: list[str | None]) -> np.ndarray:
    """Bounded measures, a row for each text: lengths, shares of symbols, marks, capitals, distinct words and equal lines
    (COUNTS of them), and then those of hashed parts."""
    counts, grams = described(texts, *BUCKETS)
    words, word_chars, symbols, bangs, capitals, digits, marks, lines, dup_lines, distinct = counts.T
    n, chars = np.maximum(words, 1), np.maximum(word_chars, 1)
    share = lambda x, top: np.minimum(x, top) / top
    distinct = distinct / n
    return np.column_stack([
        np.log1p(n) / 10, share(symbols / n, 0.1), share(symbols / n, 1), share(symbols / n, 4), share(bangs / n, 0.1), share(bangs / n, 2), share(capitals / chars, 0.1), capitals / chars,
        distinct, np.sqrt(distinct), share(np.log1p(n) * (1 - distinct), 8), dup_lines / lines, share(chars / n, 12), share(lines / n, 1),
        share(digits / chars, 0.2), share(marks / n, 0.5), words < 10, np.minimum(n, 60) / 60, grams,
    ]).astype(np.float64)


COUNTS = 18


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the training rows, one for each doc_id."""
    known = only(labels, ("doc_id", "long"), ("quality", "int")).filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.filter(digest_of(known) % FOLDS != HELD_OUT)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of a bounded sample, in an order of their own."""
    known = training_labels(labels)
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    h = F.xxhash64("doc_id", F.lit(7))
    wanted = F.lit(False)
    for q, n in sizes.items():
        wanted = wanted | ((F.col("quality") == q) & (F.pmod(h, F.lit(1 << 20)) < int(min(1.0, 0.9 * SAMPLE / n) * (1 << 20) if n > SAMPLE else 1 << 20)))
    known = known.filter(wanted).orderBy(h, "doc_id").limit(2 * SAMPLE)
    # 2 x SAMPLE rows of two numbers are broadcast
    rows = only(docs, ("doc_id", "long"), ("text", "string")).join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        for batch in batches:
            x = features(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "quality": batch.column(1), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel(), pa.float32()), x.shape[1]).cast(pa.list_(pa.float32()))})

    # at most 2 x SAMPLE rows of some 2 KB
    found = rows.mapInArrow(run, "doc_id long, quality int, x array<float>").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "x").limit(2 * SAMPLE).toArrow()
    x = [part.flatten().to_numpy() for part in found["x"].chunks if len(part)]
    return (np.concatenate(x) if x else np.zeros(0, np.float32)).reshape(found.num_rows, -1 if found.num_rows else COUNTS + sum(BUCKETS)), found["quality"].to_numpy()


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3, gram_ridge: float = 1e-2) -> list[float]:
    """w, by Newton steps on the pairs; empty where a label is missing. gram_ridge: of the measures after the first COUNTS."""
    if len(set(y.tolist())) < 2:
        return []
    rng = np.random.default_rng(8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    better, worse = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    w = np.zeros(x.shape[1])
    hold = np.where(np.arange(len(w)) < COUNTS, ridge, gram_ridge)
    for _ in range(rounds):
        grad, curve = hold * w, np.diag(hold)
        for at in range(0, PAIRS, CHUNK):
            d = x[better[at : at + CHUNK]].astype(np.float64) - x[worse[at : at + CHUNK]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad = grad + d.T @ (p - 1) / PAIRS
            curve = curve + (d * (p * (1 - p))[:, None]).T @ d / PAIRS
        step = np.linalg.solve(curve, grad)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def with_strength(docs: DataFrame, w: list[float], name: str, text: str = "text") -> DataFrame:
    """docs with their strength; the sum has a fixed order, so that equal texts have equal strengths."""
    at = docs.columns.index(text)
    weights = np.array(w)

    def run(batches):
        for batch in batches:
            strength = (features(batch.column(at).to_pylist()) * weights).sum(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strength, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def strengths(docs: DataFrame, w: list[float]) -> DataFrame:
    """doc_id, held_out, strength."""
    rows = only(docs, ("doc_id", "long"), ("text", "string"))
    rows = rows.select("doc_id", (digest_of(rows) % FOLDS == HELD_OUT).alias("held_out"), "text")
    return with_strength(rows, w, "strength").drop("text")


def threshold(strengths: DataFrame, labels: DataFrame) -> float:
    """The quantile of all training rows' strengths (doc_id, strength) at their share of zeros, as numpy has it:
    exact, from the few distinct strengths between two approximate quantiles."""
    known = strengths.join(training_labels(labels), "doc_id").select("strength", "quality")
    sizes = known.agg(F.count("*").alias("n"), F.sum(1 - F.col("quality")).alias("zeros")).first()
    n, zeros = sizes["n"], sizes["zeros"] or 0
    if not n:
        return 0.0
    at, over = divmod((n - 1) * zeros, n)
    wide = 2 / RANKS
    while True:
        ends = [max(0.0, at / n - wide), min(1.0, (at + 2) / n + wide)]
        low, high = known.agg(F.percentile_approx("strength", ends, RANKS)).first()[0]
        before = known.filter(F.col("strength") < low).count()
        values = known.filter(F.col("strength").between(low, high)).groupBy("strength").count().orderBy("strength").collect()
        upto = before + np.cumsum([r["count"] for r in values])
        if before <= at and upto[-1] > min(at + 1, n - 1):
            break
        wide *= 8
    one, two = (values[int(np.searchsorted(upto, k, "right"))]["strength"] for k in (at, min(at + 1, n - 1)))
    return one + (two - one) * (over / n)


def score(strength_: Column, at: float) -> Column:
    return 1 / (1 + F.exp(-(strength_ - at + float(np.log(CUT / (1 - CUT))))))


def rank(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    w = fit(*training_rows(docs, labels))
    if w:
        rows = Scratch(docs.sparkSession).write(strengths(docs, w), "strengths")
        rows = rows.select("doc_id", "held_out", score(F.col("strength"), threshold(rows, labels)).alias("score"))
    else:
        rows = only(docs, ("doc_id", "long"))
        rows = rows.select("doc_id", (digest_of(rows) % FOLDS == HELD_OUT).alias("held_out"), F.lit(0.5).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good, all columns as they were."""
    w = fit(*training_rows(docs, labels))
    if not w:
        return docs  # every score is 0.5
    scratch = Scratch(docs.sparkSession)
    known = scratch.write(strengths(docs, w).select("doc_id", "strength"), "strengths")
    at = threshold(known, labels)
    scratch.drop(known)
    (name,) = fresh(docs.columns, "strength")
    return with_strength(docs, w, name).filter(score(F.col(name), at) >= CUT).drop(name)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
