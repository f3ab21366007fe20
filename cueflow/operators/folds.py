"""Ordered folds by key, with memory that does not grow with a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def fold(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable, step: Callable, end: Callable, schema) -> DataFrame:
    """Rows of schema (key first) from each key's rows in order (nulls last). start() makes a state, step(state, values
    of columns, out) takes a row and end(state, out) the key's end; both append rows without the key to out. A key's
    rows lie together, sorted by Spark (which spills), and pass in batches; what is held is a batch and one state."""
    sorted_ = df.select(key, *dict.fromkeys([*order, *columns])).repartition(key).sortWithinPartitions(key, *[F.col(c).asc_nulls_last() for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, now, state, seen = to_arrow_schema(schema), None, None, False

        def rows(k, out):
            return [(k, *r) for r in out]

        for batch in batches:
            found = []
            for k, *values in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, *columns)]):
                out: list = []
                if not seen or k != now:
                    if seen:
                        end(state, out)
                        found += rows(now, out)
                        out = []
                    now, state, seen = k, start(), True
                step(state, values, out)
                found += rows(now, out)
            yield _batch(found, shape)
        if seen:
            out = []
            end(state, out)
            yield _batch(rows(now, out), shape)

    return sorted_.mapInArrow(run, schema)


def _batch(rows: list, shape: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)
