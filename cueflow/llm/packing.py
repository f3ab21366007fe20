"""Operator 3: packing by power-of-two decomposition.

A document's ids (with the closing id 0) are cut into pieces whose lengths are the powers of two of the
binary form of its length: first as many of the longest allowed length (1024) as fit, then descending
powers. Each piece is a sequence of its own, so no sequence crosses documents and nothing is padded;
sequences of equal length share a bucket, and training batches are drawn from one bucket at a time.
Pieces depend on their own document alone: no shuffle, and one document's ids are all a task holds.

Defined cases: a null or empty text is the single id 0; a null doc_id stays null; repeated rows are packed
each for itself under sequence ids of their own; an empty table gives no rows; other columns are ignored.
sequence_id: the task's number in the high bits and a counter in the low 40, so unique in a written
result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import only, table

LONGEST = 1024
CLOSING_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n ids, longest first."""
    return [longest] * (n // longest) + [1 << k for k in range((n % longest).bit_length() - 1, -1, -1) if n % longest >> k & 1]


def pack(docs: DataFrame, longest: int = LONGEST, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids: also its ids."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = tokenizer or bpe.default_path()

    def run(batches):
        codec = bpe.codec(path)
        first = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for batch in batches:
            doc, start, length, crc, total, ids_out = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(codec.encode(text or ""), np.uint32(CLOSING_ID)).astype("<u4")
                raw, at = memoryview(ids).cast("B"), 0
                for n in cuts(len(ids), longest):
                    doc.append(d)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(ids))
                    if with_ids:
                        ids_out.append(ids[at : at + n].astype(np.int32))
                    at += n
            k = len(doc)
            long = lambda x: pa.array(x, pa.int64())
            cols = {"doc_id": long(doc), "start": long(start), "length": long(length), "ids_crc32": long(crc), "doc_tokens": long(total), "sequence_id": long(np.arange(first, first + k)), "offset": long(np.zeros(k, np.int64)), "bucket": pa.array([n.bit_length() - 1 for n in length], pa.int32())}
            if with_ids:
                cols["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
            first += k
            yield pa.RecordBatch.from_pydict(cols)

    return only(docs, ("doc_id", "long"), ("text", "string")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def write_buckets(docs: DataFrame, path: str, **how) -> None:
    """The sequences with their ids, a folder for each length."""
    pack(docs, with_ids=True, **how).write.partitionBy("bucket").parquet(path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
