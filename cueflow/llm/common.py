"""Reading tables, shared scratch tables and hashing shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.functions.names import fresh, let  # noqa: F401

#: The white space of the query contracts, as a regular-expression class body.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *types: tuple[str, str]) -> DataFrame:
    """The named columns, cast; extra columns (also clashing ones) go, missing ones become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types])


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where it is unset and the session runs in
    a single process (tests), a local one; elsewhere that is an error, as executors don't see each other's disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(scratch_root, "own", None) or "file://" + tempfile.mkdtemp(prefix="cueflow-")
        scratch_root.own = root
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _session_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/cueflow-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes what operators of this session have written; results that were not yet written elsewhere need it.
    Runs by itself when the driver's Python ends."""
    with contextlib.suppress(Exception):
        _delete(spark, _session_folder(spark))


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive a lost executor. `drop` removes those that
    no later read needs; the rest, which a returned DataFrame still reads, go with `clear_scratch`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{_session_folder(spark)}/{uuid.uuid4().hex}"
        self.n = 0
        if spark.sparkContext.applicationId not in _CLEARED:
            _CLEARED.add(spark.sparkContext.applicationId)
            atexit.register(clear_scratch, spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.n:03d}-{name}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes tables that no later read needs."""
        for df in tables:
            if path := getattr(df, "scratch_path", None):
                _delete(self.spark, path)


_CLEARED: set[str] = set()


def digest_of(df: DataFrame) -> Column:
    """crc32 of doc_id as text, the fold function of the contracts (null: of the empty string)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def running(df: DataFrame, order: list[Column], value: Column, name: str, keep: Scratch) -> DataFrame:
    """df with `name`: the sum of value (long) over all rows before this one in the order, which must tell rows apart.

    Rows are dealt to tasks by ranges of the order and written; each task sums its own, the driver adds up one sum a task,
    and what comes before a task's rows goes back by a broadcast of as many rows as there are tasks. No task holds more
    than its range, whatever key holds most rows. df is read twice (a sample finds the ranges), so it should be a table."""
    spark = df.sparkSession
    part, before, own = fresh(df.columns, "part", "before", "value")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep.write(df.withColumn(own, value.cast("long")).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), name)
    sums = sorted((r[0], r[1]) for r in dealt.groupBy(part).agg(F.sum(own)).collect())
    starts = itertools.accumulate([s for _, s in sums], initial=0)
    small = spark.createDataFrame([(p, at) for (p, _), at in zip(sums, starts)], f"`{part}` int, `{before}` long")
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(name, F.coalesce(F.sum(own).over(w), F.lit(0)))
    return out.join(F.broadcast(small), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before, own)
