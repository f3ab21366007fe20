"""Operator 10: quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a text. On a sample (about SAMPLE_ROWS rows by the hash of id and text, a
documented bound) every rule's rejections are counted and, on TIMED_ROWS of it, its own cost is timed, the words
given; rules are then ordered greedily by rows rejected among those still standing per second. The cascade is one CASE in that order: a
text that a rule rejects never reaches the later ones, and their measures are not made. The order changes the cost
only, never the verdict: a text is kept if no rule rejects it.

A text is split into words once; all measures work on that array or on the text. `keep` makes a measure only when
the cascade reaches a rule that needs it. `measure` also returns the five measures of the contract, so these are
made for every row; the others only where the cascade gets to them.

All measures are expressions over a single row: no shuffle, and nothing larger than one text in memory. A very long
text is measured whole, in time linear in its length (its repeated windows: n log n).

Defined cases: null text counts as empty (no words, rejected for too few); null and repeated doc_id stay, one row
each; rules of equal merit are taken in the order listed; an empty table gives no rows (the rules keep their listed
order); extra columns, also ones named like a measure or like a helper, are left out of the result of `measure` and
kept as they are by `keep`.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, Scratch, let, only, table

SAMPLE_ROWS, TIMED_ROWS, REPEATS = 2000, 200, 8
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{WS}]+"), "")


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(without(text, chars))


def _repeat_words(words_: Column) -> Column:
    """Words in 5-word windows found twice or more: windows as hashes; only texts with equal ones are sorted."""

    def covered(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False))
        at = F.array_sort(F.transform(F.filter(pairs, same), lambda x: x["i"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])

    def windows(hashes: Column) -> Column:
        win = F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)]))
        return let(win, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)))

    return let(F.transform(words_, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < 6, F.lit(0)).otherwise(windows(h)))


def _dup_lines(text: Column) -> Column:
    """Blank lines are looked at only where some line has an equal."""
    filled = lambda lines: F.filter(lines, lambda x: F.length(without(x, SPACES)) > 0)
    return let(F.split(text, "\n"), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(let(filled(x), lambda y: F.size(y) - F.size(F.array_distinct(y)))))


#: measure -> expression of the text and its words
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: F.length(without(t, SPACES)),
    "n_symbols": lambda t, w: _count(t, SYMBOLS),
    "n_dup_lines": lambda t, w: _dup_lines(t),
    "n_repeat_words": lambda t, w: _repeat_words(w),
    "n_bangs": lambda t, w: _count(t, "!"),
    "n_capitals": lambda t, w: F.regexp_count(t, F.lit("[A-Z]")),
    "n_lines": lambda t, w: F.size(F.split(t, "\n")),
}

#: rule -> the condition that rejects, of the measures
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 10,
    "repeated_passages": lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"),
    "symbols": lambda m: 10 * m("n_symbols") > 4 * m("n_words"),
    "word_length": lambda m: let(m("word_chars"), lambda c: (c < 2 * m("n_words")) | (c > 25 * m("n_words"))),
    "repeated_lines": lambda m: 10 * m("n_dup_lines") > 4 * m("n_lines"),
    "bangs": lambda m: 10 * m("n_bangs") > 4 * m("n_words"),
    "capitals": lambda m: 10 * m("n_capitals") > 6 * m("word_chars"),
}
BASE = ("few_words", "repeated_passages")
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def of_text(text: Column, words_: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text, words_)


def order(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS, costs: dict[str, float] | None = None) -> list[dict]:
    """The rules by rejection per cost: {rule, seconds, rejected}, from a bounded sample. costs: given instead of timed."""
    rows = only(docs, ("doc_id", "long"), ("text", "string")).withColumn("text", F.coalesce("text", F.lit("")))
    every, h = max(1, rows.count() // sample_rows), F.xxhash64("doc_id", "text")
    keep = Scratch(docs.sparkSession)
    chosen = rows.filter(F.pmod(h, F.lit(every)) == 0).orderBy(h, "text").limit(4 * sample_rows)
    sample = keep.write(chosen.select("text", words(F.col("text")).alias("words")).coalesce(1), "sample")
    few = keep.write(sample.limit(TIMED_ROWS).coalesce(1), "timed")
    m = of_text(F.col("text"), F.col("words"))

    def seconds(what: Column, times: int) -> float:
        rows = few.select("text", "words", F.explode(F.sequence(F.lit(1), F.lit(times)))).agg(F.sum(what.cast("int")))
        began = time.monotonic()
        rows.collect()
        return time.monotonic() - began

    def cost(what: Column) -> float:
        """Of one evaluation over these rows: more of them less one, so that a job's own time drops out."""
        seconds(what, 1)
        return max(1e-5, (seconds(what, REPEATS + 1) - seconds(what, 1)) / REPEATS)

    cost_of = dict(costs) if costs is not None else {name: cost(rule(m)) for name, rule in rules.items()}
    seen = sample.groupBy(*[rule(m).alias(name) for name, rule in rules.items()]).count().collect()  # 2^rules rows at most
    out, standing, left = [], [r.asDict() for r in seen], dict(rules)
    while left:
        hits = {name: sum(r["count"] for r in standing if r[name]) for name in left}
        best = max(left, key=lambda n: (hits[n] / cost_of[n], -cost_of[n]))
        out.append({"rule": best, "seconds": cost_of[best], "rejected": hits[best]})
        standing = [r for r in standing if not r[best]]
        del left[best]
    keep.drop(sample, few)
    return out


def verdict(names: list[str], measure: Callable[[str], Column], rules: dict = RULES) -> Column:
    """True if no rule rejects; rules after the first that does are not evaluated."""
    out = F
    for name in names:
        out = out.when(rules[name](measure), F.lit(False))
    return out.otherwise(F.lit(True))


def kept(text: Column, names: list[str], rules: dict = RULES) -> Column:
    """The verdict of a text, which is split once."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: verdict(names, of_text(t, w), rules)))


def keep(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """The rows of docs that the cascade keeps, all columns as they were."""
    names = [x["rule"] for x in order(docs, rules)]
    return docs.filter(kept(F.col("text").cast("string"), names, rules))


def measure(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """doc_id, the measures of the contract, base_failed and kept."""
    names = [x["rule"] for x in order(docs, rules)]
    rows = only(docs, ("doc_id", "long"), ("text", "string")).withColumn("text", F.coalesce("text", F.lit("")))
    made = let(words(F.col("text")), lambda w: F.struct(*[MEASURES[k](F.col("text"), w).cast("long").alias(k) for k in CONTRACT]))
    rows = rows.withColumn("m", made)

    def known(name: str) -> Column:
        return F.col("m")[name] if name in CONTRACT else MEASURES[name](F.col("text"), F.lit(None))

    base = rules["few_words"](known) | rules["repeated_passages"](known)
    return rows.select("doc_id", *[F.col("m")[k].alias(k) for k in CONTRACT], base.alias("base_failed"), verdict(names, known, rules).alias("kept"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
c AS (SELECT doc_id, sum(least(5, i - last)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9) AS last FROM r) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_bangs,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    len(string_split(t, chr(10))) AS n_lines,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 4 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR 10 * n_dup_lines > 4 * n_lines OR 10 * n_bangs > 4 * n_words OR 10 * n_capitals > 6 * word_chars) AS kept
FROM b
"""
