"""Names for helper columns and for values within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written and computed once."""
    return F.transform(F.array(value), body)[0]


def fresh(columns: list[str], *stems: str) -> list[str]:
    """Names that none of these columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
