"""Ranking, fallback and set operators: one row per key by lexicographic order, and unions by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions.names import fresh


def first_by(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key; order must end in a unique column, as Spark's sorts are not stable."""
    return last_n(df, keys, order, 1)


def last_n(df: DataFrame, keys: list, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key; order is given newest first."""
    (no,) = fresh(df.columns, "no")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(no, F.row_number().over(w)).filter(F.col(no) <= n).drop(no)


def after_cursor(df: DataFrame, keys: list, order: list[Column], after: Column) -> DataFrame:
    """The rows of each key past its cursor (clamped to its rows), with no (from 1) and next_cursor, the key's rows."""
    (cursor,) = fresh(df.columns, "cursor")
    w = Window.partitionBy(*keys)
    df = df.withColumn(cursor, after).withColumn("no", F.row_number().over(w.orderBy(*order))).withColumn("next_cursor", F.count("*").over(w))
    return df.filter(F.col("no") > F.greatest(F.lit(0), F.least(F.coalesce(cursor, F.lit(0)), "next_cursor"))).drop(cursor)


def cap_with_fallback(df: DataFrame, keys: list, ok: Column) -> DataFrame:
    """Rows that pass the cap; all rows of a key of which none does. A condition that is null does not pass."""
    own, any_ = fresh(df.columns, "ok", "any")
    df = df.withColumn(own, F.coalesce(ok, F.lit(False))).withColumn(any_, F.max(own).over(Window.partitionBy(*keys)))
    return df.filter(F.col(own) | ~F.col(any_)).drop(own, any_)


def best_class(df: DataFrame, keys: list, cls: Column) -> DataFrame:
    """Rows of the least class that a key has."""
    own, least = fresh(df.columns, "cls", "least")
    df = df.withColumn(own, cls).withColumn(least, F.min(own).over(Window.partitionBy(*keys)))
    return df.filter(F.col(own) == F.col(least)).drop(own, least)


def precedence_union(sources: list[DataFrame], key: Column, order: list[Column]) -> DataFrame:
    """Earlier sources win on equal keys (case ignored); within a source the first row by order. Rows without a key (null)
    are equal to none and all stay."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("src_rank", F.lit(i))
        every = s if every is None else every.unionByName(s)
    k, own = fresh(every.columns, "key", "own")
    every = every.withColumn(k, F.lower(key)).withColumn(own, F.when(F.col(k).isNull(), F.monotonically_increasing_id()))
    return first_by(every, [k, own], [F.col("src_rank"), *order]).drop(k, own)


def enrich(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, small: int = 8 << 20) -> DataFrame:
    """Every row of left, with the row of right of the same key in any case (right has one row a key); right is broadcast
    only where its files are known to be smaller than `small` bytes, else Spark chooses."""
    a, b = fresh([*left.columns, *right.columns], "a", "b")
    right = right.withColumn(b, F.lower(right_key.cast("string")))
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    joined = left.withColumn(a, F.lower(left_key.cast("string"))).join(F.broadcast(right) if size <= small else right, F.col(a) == F.col(b), "left")
    return joined.drop(a, b)


def require(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of left with the row of right of its keys (one a key); the job fails where there is none."""
    (found,) = fresh([*left.columns, *right.columns], "found")
    out = left.join(right.withColumn(found, F.lit(True)), keys, "left")
    return out.filter(F.when(F.col(found), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such key: "), F.concat_ws(", ", *keys))).cast("boolean"))).drop(found)


def by_number_or_place(df: DataFrame, keys: list, number: Column, place: Column, wanted: Column) -> DataFrame:
    """For each key the first row whose number is the wanted one, else the row at that place (from 1)."""
    hit, no = fresh(df.columns, "hit", "no")
    df = df.withColumn(hit, F.coalesce(number == wanted, F.lit(False))).withColumn(no, place)
    return first_by(df.filter(F.col(hit) | (F.col(no) == wanted)), keys, [F.desc(hit), F.asc(no)]).drop(hit, no)


def ordered_distinct(df: DataFrame, keys: list, value: Column, order: list[Column], name: str = "values") -> DataFrame:
    """keys and the array of their distinct values in order of first occurrence, filled in two steps: a value's first
    occurrence, then one row a key."""
    v, o = fresh(df.columns, "value", "order")
    first = df.withColumn(v, value).filter(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.min(F.struct(*order)).alias(o))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(o, v))), lambda x: x[v]).alias(name))


def last_filled(df: DataFrame, keys: list, value: Column, order: Column, name: str) -> DataFrame:
    """keys and the last value that is not blank."""
    filled = F.when(F.trim(value) != "", value)
    return df.groupBy(*keys).agg(F.max_by(filled, F.when(filled.isNotNull(), order)).alias(name))


def priority_then_name(name: Column, first: list[str]) -> list[Column]:
    """An order: the listed names in their order, then all others by name."""
    at = F.array_position(F.array(*map(F.lit, first)), name)
    return [F.when(at > 0, at).otherwise(len(first) + 1), name]


def url_key(url: Column) -> Column:
    """scheme://host[:port]/path in small letters; null unless http or https."""
    plain = F.regexp_extract(F.lower(url), r"^(https?://[^?#]*)", 1)
    return F.when(plain != "", plain)
