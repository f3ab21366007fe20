"""Operator 1: consistent placement of rows on shards through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (a start and a step from its
name's hash) and the shards take turns: in its turn a shard claims the first slot of its permutation
that is still free, until none is. The table depends on the shards alone, never on the data, so its
size is fixed (65,537 rows); it is broadcast, and a row finds its shard by one hash and one look-up,
without a shuffle and whatever the skew of any other column.

Defined cases: a null key is placed by the row's text, so that rows without a key spread as well (null
key and null text: as an empty text); equal keys always share a shard; an empty table gives no rows;
extra columns are kept as they are, but columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{what}:{name}".encode(), digest_size=8).digest(), "big")


def lookup(shards=SHARDS, slots: int = SLOTS, weights=None) -> np.ndarray:
    """slot -> index into shards. weights: turns that a shard takes in each round (1 if not given)."""
    if not shards or slots < len(shards) or len(set(shards)) != len(shards):
        raise ValueError("needs distinct shards, and at least a slot for each")
    if slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    turns = [i for i, s in enumerate(shards) for _ in range((weights or {}).get(s, 1))]
    if not turns:
        raise ValueError("no shard has a turn")
    at = [_number(s, "start") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    out = np.full(slots, -1, np.int32)
    left = slots
    while True:
        for i in turns:
            while out[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            out[at[i]] = i
            left -= 1
            if not left:
                return out


def place(df: DataFrame, key: str = "doc_id", text: str = "text", shards=SHARDS, slots: int = SLOTS, weights=None) -> DataFrame:
    """df with slot (long) and shard (string)."""
    found = lookup(shards, slots, weights)
    names = np.asarray(shards, dtype=object)[found]
    (own,) = fresh(df.columns, "slot")
    small = df.sparkSession.createDataFrame(pa.table({own: pa.array(np.arange(slots, dtype=np.int64)), "shard": pa.array(names.tolist(), pa.string())}))
    fallback = F.coalesce(F.col(text), F.lit("")) if text in df.columns else F.lit("")
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string"))).otherwise(F.xxhash64(F.lit("text"), fallback))
    df = df.drop(*({"slot", "shard"} & set(df.columns)))
    return df.withColumn("slot", F.pmod(hashed, F.lit(slots))).join(F.broadcast(small), F.col("slot") == F.col(own), "left").drop(own)


def write_shards(df: DataFrame, path: str, **how) -> None:
    """Each shard's rows in a folder of its own, straight from the tasks that read them."""
    place(df, **how).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")
