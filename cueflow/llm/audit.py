"""Operator 11: what filters in every order do to each part of a corpus, by the multilinear extension of their removals.

A document has a mask: which of the filters fail it. All that the audit says of a part follows from how many documents
have each mask (2^filters counts, of all documents, of good and of toxic ones): the part's removal polynomial is
R(x) = sum over masks m of n_m (1 - product of (1 - x_i) for i in m), multilinear in the filters' shares x. At the corners
(x of 0 and 1) it is the number that a set of filters removes, so survivors, removals and redundant failures of every step
of every order are differences of corners. A filter's Shapley value is the integral over the diagonal of the partial
derivative; its terms c t^(k-1) integrate to c / k, as exact rationals, and times the number of orders it is the filter's
removals summed over all orders.

One narrow pass makes masks; texts travel as digests of 32 bytes. Equal texts (table-wide) are counted by digest, part and
document before any window: a text that a third of all rows share is a few rows a digest. Labels are joined by doc_id;
rows without one are spread. A part is one row of at most 32 counts when its polynomial is made; parts go through
tasks in batches.

Defined cases: a null text is empty; null and empty sources are one part; a null doc_id is not smaller or larger than any
other, so it neither fails E nor makes others fail, and has no labels; rows of equal doc_id and text do not fail by each
other; a doc_id with several labels is good (toxic) if one of them says so; very long texts are measured whole; an empty
table has no parts and gives no rows; other columns, also ones with names used here, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, only, table
from .rules import words

# The filters of the audit, applied to a text, its words and (E) to all texts.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SIGNS = 50, 65, 5, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def own_mask(text: Column) -> Column:
    """Bits 0 to 3 of the mask: what A to D say of a text."""

    def bits(w: Column) -> Column:
        few = F.size(w) < LEAST_WORDS
        poor = 100 * F.size(F.array_distinct(w)) < DISTINCT_SHARE * F.size(w)
        loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_SHARE * F.length(text)
        fails = (few, poor, loud, F.regexp_like(text, F.lit(SIGNS)))
        return sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))

    return let(words(text), bits)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part have each mask."""
    rows = only(docs, ("doc_id", "long"), ("text", "string"), ("source", "string"))
    text, id_ = F.coalesce("text", F.lit("")), F.col("doc_id")
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = rows.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), digest.alias("digest"), own_mask(text).alias("own"), F.when(id_.isNull(), F.xxhash64(text)).otherwise(F.lit(0)).alias("spread"))
    said = only(labels, ("doc_id", "long"), ("quality", "int"), ("toxic", "int")).filter("doc_id is not null")
    said = said.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(said.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    by = ["digest", "part", "own", "good", "toxic"]
    ids = rows.select("digest", "part", "own", zero("good"), zero("toxic"), "doc_id").groupBy(*by, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(id_.isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = ids.groupBy(*by).agg(first, F.sum("n").alias("n"), F.coalesce(F.sum(F.when(id_.isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    least = F.min(F.col("first.doc_id")).over(Window.partitionBy("digest"))
    spared = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("own").alias("mask"), spared.alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - spared).alias("n"))))
    counts = groups.withColumn("least", least).select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.*").filter("n > 0")
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return counts.groupBy("part", "mask").agg(F.sum("n").alias("total"), of("good"), of("toxic")).withColumnRenamed("total", "n")


def polynomial(counts: dict[int, int], filters: int) -> dict[int, int]:
    """Coefficients of the removal polynomial by monomial (a set of filters as bits)."""
    out = dict.fromkeys(range(1, 1 << filters), 0)
    for mask, n in counts.items():
        for t in out:
            if t & mask == t:
                out[t] += n if t.bit_count() % 2 else -n
    return out


def corner(poly: dict[int, int], chosen: int) -> int:
    """What the chosen filters remove together."""
    return sum(c for t, c in poly.items() if t & chosen == t)


def shapley(poly: dict[int, int], i: int) -> Fraction:
    """The integral of the derivative by x_i over the diagonal from 0 to 1."""
    return sum((Fraction(c, t.bit_count()) for t, c in poly.items() if t >> i & 1), Fraction(0))


def steps(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """(order, step, the COUNTS) of every order of a part whose masks have these counts (all, good, toxic)."""
    n, every = len(filters), sum(c[0] for c in counts.values())
    polys = [polynomial({m: c[k] for m, c in counts.items()}, n) for k in range(3)]
    gone, good, toxic = [[corner(p, s) for s in range(1 << n)] for p in polys]
    values = [shapley(polys[0], i) * factorial(n) for i in range(n)]
    alone = [counts.get(1 << i, (0,))[0] for i in range(n)]
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield ("".join(filters[j] for j in order), step, every - gone[after], removed, gone[1 << i] - removed, alone[i], good[after] - good[before], toxic[after] - toxic[before], int(values[i]))
            before = after


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, list_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = list(zip(*steps({x["mask"]: (x["n"], x["good"], x["toxic"]) for x in list_})))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(made[0])), *[pa.array(c, k) for c, k in zip(made, kinds)]], names=["part", "filter_order", "step", *COUNTS])

    counts = masks(docs, labels)
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")).mapInArrow(run, SCHEMA)  # 32 masks a part


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b)"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM w),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM {_LETTERS} a, {_LETTERS} b, {_LETTERS} c, {_LETTERS} d, {_LETTERS} e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CASE step WHEN 1 THEN 0 ELSE list_sum(bits[1:step - 1]) END::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
