"""Ordered scans over sources of any size, cut into cells.

A source's rows are cut by time into cells of about CELL_ROWS rows. Windows run within cells; what a cell needs to know of
the ones before it (their last text, how far they reach, the group left open) comes from a scan over one summary row a cell
and is joined back. No task holds more of a source than a cell or its summaries, whichever source holds most rows. Rows of
one source at one instant share a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions.names import fresh

CELL_ROWS = 1 << 16


def by_size(df: DataFrame, source: str, key: str, few: Callable[[DataFrame], DataFrame], many: Callable[[DataFrame], DataFrame], rows: int = CELL_ROWS) -> DataFrame:
    """few(df with key, the source in a struct) of the sources that one cell holds and many(df) of the others, as one table.
    What a source of one cell needs is in one place, so that it takes one shuffle; sources are counted first, and where
    there are no larger ones nothing is cut into cells."""
    (other,) = fresh([*df.columns, key], "large")
    large = df.groupBy(F.struct(source).alias(other)).count().filter(F.col("count") > rows).select(other)
    keyed, same = df.withColumn(key, F.struct(source)), F.col(key) == F.col(other)
    if large.isEmpty():
        return few(keyed)
    return few(keyed.join(large, same, "left_anti")).unionByName(many(keyed.join(large, same, "left_semi").drop(key)))


def cells(df: DataFrame, source: str, start: str, key: str, cell: str, rows: int = CELL_ROWS) -> DataFrame:
    """df with key (the source in a struct, so that a null one is equal to itself) and cell, which grows with start; rows
    without a start come first and NaN last, as in Spark's order."""
    n, low, high, other = fresh(df.columns, "n", "low", "high", "key_of")
    finite = F.when(F.abs(start) < float("inf"), F.col(start))
    df = df.withColumn(key, F.struct(source))
    bounds = df.groupBy(F.col(key).alias(other)).agg(F.ceil(F.count("*") / rows).alias(n), F.min(finite).alias(low), F.max(finite).alias(high))
    share = F.when(F.col(high) > F.col(low), (F.col(start) - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.0)
    place = F.when(F.isnan(start), F.col(n) - 1).otherwise(F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor(share * F.col(n)))))
    placed = df.join(bounds, F.col(key) == F.col(other)).withColumn(cell, F.coalesce(place, F.lit(0)).cast("long"))
    return placed.drop(other, n, low, high)


def runs(df: DataFrame, key: str, cell: str | None, at: str, order: list[str], gap: float, more: dict) -> DataFrame:
    """key, cell, at (the first row's order), start, end, text and more: neighbours in order of equal text that touch within
    the gap as one row. more: column -> F.max, F.sum or the like, which may be applied to parts. A null text is equal to none.
    Without a cell every source is whole."""
    new, run, reach, part = fresh([*df.columns, at], "new", "run", "reach", "part")
    place = [key] if cell is None else [key, cell]
    c, w = F.col, Window.partitionBy(*place).orderBy(*order)
    rows = df.withColumn(new, F.coalesce((F.lag("text").over(w) != c("text")).cast("int"), F.lit(1))).withColumn(run, F.sum(new).over(w))
    in_run = Window.partitionBy(*place, run).orderBy(*order)
    rows = rows.withColumn(reach, F.max("end").over(in_run.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn(part, F.sum(F.coalesce((c("start") > c(reach) + gap).cast("int"), F.lit(1))).over(in_run))
    own = [F.min(F.struct(*order)).alias(at), F.min("start").alias("start"), F.max("end").alias("end"), F.first("text").alias("text")]
    local = rows.groupBy(*place, run, part).agg(*own, *[f(n).alias(n) for n, f in more.items()])
    if cell is None:
        return local.drop(run, part)

    first, last, text_in, same, stretch, reach_in, open_, open_in = fresh(local.columns, "first", "last", "text_in", "same", "stretch", "reach_in", "open", "open_in")
    s = local.groupBy(key, cell).agg(F.min(F.struct(run, part, "text")).alias(first), F.max(F.struct(run, part, "start", "end", "text")).alias(last))
    v = Window.partitionBy(key).orderBy(cell)
    s = s.withColumn(text_in, F.lag(c(last)["text"]).over(v))
    # a cell of one run that goes on with the text before it hands on the further of the two reaches
    s = s.withColumn(same, _sure((c(first)[run] == c(last)[run]) & (c(first)["text"] == c(text_in)))).withColumn(stretch, F.sum((~c(same)).cast("int")).over(v))
    s = s.withColumn(reach_in, F.max(c(last)["end"]).over(Window.partitionBy(key, stretch).orderBy(cell))).withColumn(reach_in, F.lag(reach_in).over(v))
    begun = F.when(~_sure(c(same) & (c(last)["start"] <= c(reach_in) + gap)), F.struct(c(cell), c(last)[run].alias(run), c(last)[part].alias(part)))
    s = s.withColumn(open_, F.last(begun, ignorenulls=True).over(v)).withColumn(open_in, F.lag(open_).over(v))

    joined = local.join(s.select(key, cell, text_in, reach_in, open_in), [key, cell])
    goes_on = _sure((c(run) == 1) & (c("text") == c(text_in)) & (c("start") <= c(reach_in) + gap))
    joined = joined.withColumn(open_, F.when(goes_on, c(open_in)).otherwise(F.struct(cell, run, part)))
    whole = [F.min(cell).alias(cell), F.min(at).alias(at), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("text", at).alias("text")]
    return joined.groupBy(key, open_).agg(*whole, *[f(n).alias(n) for n, f in more.items()]).drop(open_)


def chains(df: DataFrame, key: str, cell: str | None, at: str, gap: float, apart: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """df with name, which rows share unless something between them keeps all before from all after: a start that no row
    before reaches within the gap, or two neighbours (in the order of at) whose texts are surely apart."""
    before, reach, cut, no = fresh([*df.columns, name], "before", "reach", "cut", "no")
    c, w = F.col, Window.partitionBy(*([key] if cell is None else [key, cell])).orderBy(at)
    rows = df.withColumn(before, F.lag(F.struct("text")).over(w)).withColumn(reach, F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if cell is None:
        far = F.coalesce(c("start") > c(reach) + gap, F.lit(True))
        rows = rows.withColumn(cut, far | F.coalesce(apart(c(before)["text"], c("text")), F.lit(True)))
        return rows.withColumn(name, F.sum(c(cut).cast("int")).over(w)).drop(before, reach, cut)
    v = Window.partitionBy(key).orderBy(cell)
    before_in, reach_in, open_, open_in = fresh(rows.columns, "before_in", "reach_in", "open", "open_in")
    s = df.groupBy(key, cell).agg(F.max_by(F.struct("text"), at).alias(before_in), F.max("end").alias(reach_in))
    s = s.select(key, cell, F.lag(before_in).over(v).alias(before_in), F.max(reach_in).over(v.rowsBetween(Window.unboundedPreceding, -1)).alias(reach_in))
    rows = rows.join(s, [key, cell])
    far = F.coalesce(c("start") > F.greatest(reach, reach_in) + gap, F.lit(True))
    rows = rows.withColumn(cut, far | F.coalesce(apart(F.coalesce(before, before_in)["text"], c("text")), F.lit(True)))
    rows = rows.withColumn(no, F.sum(c(cut).cast("int")).over(w)).drop(before, reach, before_in, reach_in, cut)
    t = rows.groupBy(key, cell).agg(F.max(no).alias(open_)).withColumn(open_, F.last(F.when(c(open_) > 0, F.struct(cell, c(open_).alias(no))), ignorenulls=True).over(v))
    t = t.select(key, cell, F.lag(open_).over(v).alias(open_in))
    return rows.join(t, [key, cell]).withColumn(name, F.when(c(no) == 0, c(open_in)).otherwise(F.struct(cell, no))).drop(no, open_in)


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))
