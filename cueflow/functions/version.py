"""Versions as a sort key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.functions.names import let


def version_key(x: Column) -> Column:
    """A struct that sorts as versions do: a core of four numbers (0.0.0.0 where it can't be read or is a single
    number), then releases after pre-releases, then their parts: numbers first and by value, words by letters in
    any case, the shorter of two equal beginnings first. A leading v and what follows + don't count."""
    plain = F.element_at(F.split(F.regexp_replace(F.trim(x), "^[vV]+", ""), r"\+"), 1)
    core, rest = F.regexp_extract(plain, "^([^-]*)", 1), F.regexp_extract(plain, "^[^-]*-(.*)$", 1)
    known = lambda p: F.size(p).between(2, 4) & F.forall(p, lambda n: n.isNotNull() & (n >= 0))
    four = lambda p: F.slice(F.concat(F.when(known(p), p).otherwise(F.array().cast("array<int>")), F.array_repeat(F.lit(0), 4)), 1, 4)
    numbers = let(F.transform(F.split(core, r"\."), lambda p: p.try_cast("int")), four)
    words = F.filter(F.split(rest, r"[.-]|(?<=\D)(?=\d)|(?<=\d)(?=\D)"), lambda w: w != "")
    token = lambda w: let(w.try_cast("long"), lambda n: F.struct(n.isNull().alias("word"), F.coalesce(n, F.lit(0)).alias("number"), F.when(n.isNull(), F.upper(w)).otherwise("").alias("text")))
    return let(words, lambda ws: F.struct(numbers.alias("core"), (F.size(ws) <= 0).alias("release"), F.transform(ws, token).alias("tokens")))
