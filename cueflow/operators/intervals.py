"""Interval operators: exact and fuzzy coalescing, ownership and point look-up."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cueflow.functions import text as T
from cueflow.functions.names import fresh, let
from cueflow.operators import scan, sweep

# Gaps in seconds, likeness of texts, and the length of a cue that ends before it starts.
GAP, FUZZY_GAP, ALIKE, SHORTEST = 0.15, 0.25, 0.82, 1.5


def coalesce(cues: DataFrame, source: str = "source_id", cell_rows: int = scan.CELL_ROWS) -> DataFrame:
    """source, start, end, text: neighbours of equal text that touch within GAP become one. Windows run over cells of a large
    source's time, so that a source of any size is spread; a null text joins no other, a null source is one of its own."""
    key, cell, at = fresh(cues.columns, "key", "cell", "at")
    c = cues.select(source, "start", F.when(F.col("end") <= F.col("start"), F.col("start") + SHORTEST).otherwise(F.col("end")).alias("end"), "text", "ord")

    def merged(c: DataFrame, cell: str | None) -> DataFrame:
        return scan.runs(c, key, cell, at, ["start", "ord"], GAP, {}).select(F.col(key)[source].alias(source), "start", "end", "text")

    return scan.by_size(c, source, key, lambda d: merged(d, None), lambda d: merged(scan.cells(d, source, "start", key, cell, cell_rows), cell), cell_rows)


def own(cues: DataFrame, segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cues that start in their lane's core; the last lane is closed on the right. keys: columns beside the lane that tell
    plans apart (a plan for each source). How the plan travels is Spark's choice by its size."""
    last = F.col("index") == F.col("lanes") - 1
    inside = (F.col("start") >= F.col("core_start")) & ((F.col("start") < F.col("core_end")) | (last & (F.col("start") <= F.col("core_end"))))
    return cues.join(segments.withColumn("lane", F.col("index")), ["lane", *(keys or [])]).filter(inside)


def _down(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


#: A cell of the index holds 2 ** BITS cells of the level below.
BITS = 2


def _with_cells(df: DataFrame, start: str, end: str, level: str, no: str) -> DataFrame:
    """df with a row for each of the cells (level, no) that make up the whole numbers from start to end: on each level what
    no cell of the next one covers, fewer than 2 ** BITS at either end."""
    c, wide = F.col, 1 << BITS
    a, b, y, z = fresh([*df.columns, level, no], "a", "b", "y", "z")
    levels = F.sequence(F.lit(0), F.floor(F.log2((c(end) - c(start) + 1).cast("double")) / BITS).cast("int"))
    up, none = c(level) * BITS, F.array().cast("array<long>")
    out = df.withColumn(level, F.explode(levels)).withColumns({a: -_down(-c(start), up), z: _down(c(end) + 1, up)})
    # what cells of the next level cover: from b up to y, nothing from z on if there are none
    out = out.withColumns({b: -F.shiftright(-c(a), BITS) * wide, y: F.shiftright(c(z), BITS) * wide})
    some = c(b) < c(y)
    out = out.withColumns({b: F.when(some, c(b)).otherwise(c(z)), y: F.when(some, c(y)).otherwise(c(z))})
    of = lambda x, w: F.when(x < w, F.sequence(x, w - 1)).otherwise(none)
    return out.withColumn(no, F.explode(F.concat(of(c(a), c(b)), of(c(y), c(z))))).drop(a, b, y, z)


def first_containing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, order: str, name: str = "span", cell_rows: int = scan.CELL_ROWS) -> DataFrame:
    """points with name: the first span (its row as a struct) of the same keys that holds the point, by order; null if there
    is none. Ends are closed; times are whole numbers (long, of at most 62 bits), keys and order of atomic types.

    Points and spans are rows of one table, which is shuffled once by key; a pass over each key's rows in order of time finds
    the spans (sweep.first_spans), with a row each, however many spans lie over each other and however long they are. The time of a
    key with more than cell_rows rows is cut into cells, which go to many tasks. Spans without a start, an
    end, an order or a length of 0 or more hold nothing, and a point without a time or a key is in none. Of spans that are
    equal in order the lesser start, then the lesser end counts."""
    c = F.col
    key, p, s = ([f"{x}{i}" for i in range(len(names))] for x, names in (("k", keys), ("p", points.columns), ("s", spans.columns)))
    known = [c(k).isNotNull() for k in keys]
    found, good = reduce(and_, known, c(at).isNotNull()), reduce(and_, known, (c(start) <= c(end)) & c(order).isNotNull())
    keyed = lambda df: [df[k].alias(x) for k, x in zip(keys, key)]
    held = spans.filter(good).select(*keyed(spans), c(start).cast("long").alias("t"), c(end).cast("long").alias("e"), c(order).alias("o"), *[c(n).alias(x) for n, x in zip(spans.columns, s)])
    asked = points.filter(found).select(*keyed(points), c(at).cast("long").alias("t"), *[c(n).alias(x) for n, x in zip(points.columns, p)])
    rows = held.unionByName(asked, allowMissingColumns=True)
    # a column that is a key, a time or the order travels once
    kinds = {f.name: f.dataType for f in rows.schema}
    once = lambda names, own, given: [given[n] if n in given and kinds[given[n]] == kinds[x] else x for n, x in zip(names, own)]
    out = once(points.columns, p, {at: "t"} | dict(zip(keys, key)))
    span = once(spans.columns, s, {end: "e", start: "t", order: "o"} | dict(zip(keys, key)))
    rows = rows.select(*dict.fromkeys([*key, "t", "e", "o", *out, *span]))

    large = rows.groupBy(*key).agg(F.ceil(F.count("*") / cell_rows).alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).filter("n > 1")
    place = key
    if not large.isEmpty():
        rows, place = _cut(rows, large, key), [*key, "cell"]
    schema = StructType([*points.schema, StructField(name, spans.schema)])
    lost = points.filter(~found).withColumn(name, F.lit(None).cast(spans.schema))
    return sweep.first_spans(rows, place, "t", "e", "o", out, span, schema).unionByName(lost)


def _cut(rows: DataFrame, large: DataFrame, key: list[str]) -> DataFrame:
    """rows (spans with t, e and o, points with t) with a cell of their key's time, as many cells as large says (a row for
    each cell_rows rows at most). A span goes to the cells in which it starts and ends; a cell that spans cover whole gets
    the first of those alone, found by sizes of cells that are powers of four."""
    c = F.col
    cell = lambda x: F.coalesce(F.call_function("div", x - c("low"), F.call_function("div", c("high") - c("low"), c("n")) + 1), F.lit(0))
    # a span up to the last row's time or longer covers the last cell too: it ends in the one after it
    last = F.when(c("e") >= c("high"), c("n")).when(c("e").isNotNull(), cell(c("e")))
    placed = rows.join(F.broadcast(large), key, "left").withColumns({"first": cell(c("t")), "last": last})
    ends = F.when((c("first") < c("last")) & (c("last") < c("n")), F.array("first", "last")).otherwise(F.array("first"))

    row, rank = F.struct(*[n for n in rows.columns if n not in key]), F.struct("o", "t", "e")
    over = placed.filter("last - first > 1").withColumns({"first": c("first") + 1, "last": c("last") - 1})
    over = over.groupBy(*key, "first", "last").agg(F.min_by(F.struct(rank.alias("rank"), row.alias("row")), rank).alias("best"))
    least = F.min_by("best", "best.rank").alias("best")
    index = _with_cells(over, "first", "last", "level", "no").groupBy(*key, "level", "no").agg(least)
    cells = large.select(*key, "n", F.explode(F.sequence(F.lit(0), c("n") - 1)).alias("cell"))
    cells = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(c("n").cast("double")) / BITS).cast("int"))))
    cells = cells.select(*key, "cell", "level", _down(c("cell"), c("level") * BITS).alias("no"))
    # Spark's estimates leave out what explode adds: by them it would broadcast either side
    covered = cells.join(index.hint("merge"), [*key, "level", "no"]).groupBy(*key, "cell").agg(least)
    return placed.select(*rows.columns, F.explode(ends).alias("cell")).unionByName(covered.select(*key, "best.row.*", "cell"))


def _apart(a: Column, b: Column) -> Column:
    """Whether no text that is alike to a can be alike to b: by the triangle inequality of the edit distance, as such a text
    is at most (1 - ALIKE) of its length away from a, and so at most 1 / ALIKE times as long."""
    longest = F.length(a) / ALIKE
    return F.levenshtein(a, b) > (1 - ALIKE) * (longest + F.greatest(longest, F.length(b))) + 1e-6


_ONE = "struct<start: double, `end`: double, text: string, confidence: double, n: long>"


def _merged(rows: Column) -> Column:
    """A chain's cues in order as an array of merged ones: each is alike to the first text of those that it joins."""

    def step(s: Column, x: Column) -> Column:
        o = s["open"]
        joins = F.coalesce((x["start"] <= o["end"] + FUZZY_GAP) & (T.similarity(o["text"], x["text"]) >= ALIKE), F.lit(False))
        both = F.struct(o["start"].alias("start"), F.greatest(o["end"], x["end"]).alias("end"), o["text"].alias("text"), F.greatest(o["confidence"], x["confidence"]).alias("confidence"), (o["n"] + x["n"]).alias("n"))
        return F.when(joins, _state(s["done"], both)).otherwise(_state(F.concat(s["done"], F.array(o)), x))

    return F.aggregate(F.slice(rows, 2, F.size(rows)), _state(F.array(), rows[0]), step, lambda s: F.concat(s["done"], F.array(s["open"])))


def _state(done: Column, open_: Column) -> Column:
    return F.struct(done.cast(f"array<{_ONE}>").alias("done"), open_.cast(_ONE).alias("open"))


def reconcile(cues: DataFrame, source: str = "source_id", plan: DataFrame | None = None, plan_keys: list[str] | None = None, accept: Column | None = None, cell_rows: int = scan.CELL_ROWS) -> DataFrame:
    """Cues of overlapping lanes as one track: only those that their lane owns (where a plan is given), with their accepted
    text (null drops a cue), and neighbours within FUZZY_GAP whose text is like the first text of the cue before as one;
    with the number of merges. Of equal start the lane and then ord decide.

    Neighbours of equal text are merged first, a large source's by cells: whatever the cue before began with, both are like it or neither is.
    What is left is cut into chains where time or texts rule a merge out; only a chain of unequal texts, each like the one
    before, is held in a row and folded in order. A null text is like none, a null confidence gives way to any other."""
    if plan is not None:
        cues = own(cues, plan, plan_keys).select(*cues.columns)
    if accept is not None:
        cues = cues.withColumn("text", accept).filter("text is not null")
    key, cell, at, chain, n = fresh(cues.columns, "key", "cell", "at", "chain", "n")
    c = cues.select(source, "start", "end", "text", "confidence", "lane", "ord").withColumn(n, F.lit(1).cast("long"))
    one = F.struct("start", "end", "text", "confidence", F.col(n).alias("n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(at, one.alias("x")))), lambda r: r["x"].cast(_ONE))

    def merged(c: DataFrame, cell: str | None) -> DataFrame:
        c = scan.runs(c, key, cell, at, ["start", "lane", "ord"], FUZZY_GAP, {"confidence": F.max, n: F.sum})
        c = scan.chains(c, key, cell, at, FUZZY_GAP, _apart, chain)
        done = c.groupBy(key, chain).agg(rows.alias("rows")).select(key, F.explode(let(F.col("rows"), _merged)).alias("x"))
        return done.select(F.col(key)[source].alias(source), "x.start", "x.end", "x.text", "x.confidence", (F.col("x.n") - 1).alias("merges"))

    return scan.by_size(c, source, key, lambda d: merged(d, None), lambda d: merged(scan.cells(d, source, "start", key, cell, cell_rows), cell), cell_rows)
