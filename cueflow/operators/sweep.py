"""Look-up of points among spans by passes over their rows in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def first_spans(rows: DataFrame, groups: list[str], time: str, end: str, order: str, columns: list[str], span: list[str], schema: StructType) -> DataFrame:
    """Rows of schema, one for each point among rows: its columns, and the columns span of the first span of its group that
    holds it as a struct, null if there is none. A row with an end is a span from its time on, one without is a point; the
    first span is the least in order, then in time, then in end. Groups and times are not null, times and ends are long,
    groups and order of atomic types.

    A group's rows lie together, sorted by Spark (which spills), and pass in batches. What is held is a batch and the
    spans under way that none before them in order outlasts."""
    names = list(dict.fromkeys([*groups, time, end, order, *columns, *span]))
    flat = rows.select(*names).repartition(*groups).sortWithinPartitions(*groups, time, F.col(end).asc_nulls_last())
    shape = to_arrow_schema(schema)
    kinds = [f.type for f in shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, size = None, [], 0

        def answer() -> tuple[pa.RecordBatch, pa.Table]:
            table = pa.Table.from_batches(waiting)
            points, spans, found, kept_ = _pass(pa.concat_tables([kept, table]) if kept is not None else table, groups, time, end, order)
            none = found == spans.num_rows
            hit = spans.take(pa.array(found, mask=none))
            inner = [hit.column(c).combine_chunks().cast(f.type) for c, f in zip(span, kinds[-1])]
            held = pa.StructArray.from_arrays(inner, fields=list(kinds[-1]), mask=pa.array(none))
            return pa.RecordBatch.from_arrays([*[points.column(c).combine_chunks().cast(k) for c, k in zip(columns, kinds)], held], schema=shape), kept_

        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size and (kept is None or size >= kept.num_rows):  # so that what is held is not gone over too often
                out, kept = answer()
                waiting, size = [], 0
                yield out
        if size:
            yield answer()[0]

    return flat.mapInArrow(run, schema)


def _pass(table: pa.Table, groups: list[str], time: str, end: str, order: str) -> tuple[pa.Table, pa.Table, np.ndarray, pa.Table]:
    """The points, the spans in order, the place of each point's span among them (their number if there is none), and the
    spans that may hold later points of the last group. Spans from before the rows may come first, in any order."""
    table = table.combine_chunks()
    group = np.concatenate([[0], np.cumsum(np.logical_or.reduce([_differs(table.column(g).combine_chunks()) for g in groups]))])
    is_span = table.column(end).is_valid().to_numpy()
    points, spans = table.filter(pa.array(~is_span)), table.filter(pa.array(is_span))
    by = pc.sort_indices(spans, sort_keys=[(c, "ascending") for c in (order, time, end)]).to_numpy()
    spans = spans.take(pa.array(by))
    times, ends = points.column(time).to_numpy(), spans.column(end).to_numpy()
    of, span_of = group[~is_span], group[is_span][by]
    # points are numbered in order: a span holds those from the first after its row up to the last of its group by its end
    distinct = np.unique(times)
    wide = len(distinct) + 1
    first = np.cumsum(~is_span)[is_span][by]
    past = np.searchsorted(of * wide + np.searchsorted(distinct, times), span_of * wide + np.searchsorted(distinct, ends, "right"))
    found = least_over(first, past, points.num_rows)
    # a span that one before it in order outlasts is the first of no later point
    live = np.flatnonzero((span_of == group[-1]) & (ends >= table.column(time)[-1].as_py()))
    reach = np.maximum.accumulate(ends[live])
    live = live[np.concatenate([[True], reach[1:] > reach[:-1]])[: len(live)]]
    return points, spans, found, spans.take(pa.array(live))


def _differs(x: pa.Array) -> np.ndarray:
    """Whether each value but the first is another than the one before; NaN is equal to itself."""
    a, b = x[1:], x[:-1]
    new = pc.not_equal(a, b)
    if pa.types.is_floating(x.type):
        new = pc.and_not(new, pc.and_(pc.is_nan(a), pc.is_nan(b)))
    return new.to_numpy(zero_copy_only=False).astype(bool)


def least_over(first: np.ndarray, past: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the least number i of the ranges first[i] up to past[i] (exclusive) that hold it, else their count.

    A range is two of the longest power of two that it holds, one at either end; those of a power are made into two of the
    one below, from the largest down."""
    held = np.flatnonzero(past > first)
    power = np.frexp((past - first)[held])[1] - 1
    out = np.full(n, len(first))
    for k in range(power.max(initial=0), -1, -1):
        i = held[power == k]
        np.minimum.at(out, first[i], i)
        np.minimum.at(out, past[i] - (1 << k), i)
        if k:
            half = 1 << (k - 1)
            lower = out.copy()
            np.minimum(lower[half:], out[:-half], out=lower[half:])
            out = lower
    return out
