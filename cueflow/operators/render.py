"""Cues to text: SRT, plain text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions import text as T


def srt_blocks(cues: DataFrame, keys: list, order: list[Column], accept: Column | None = None) -> DataFrame:
    """keys, no (from 1, without gaps), block: a cue's number, times and text. accept: the text to take, null drops a cue."""
    if accept is not None:
        cues = cues.withColumn("text", accept).filter("text is not null")
    cues = cues.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    time = F.concat(T.srt_time(F.col("start")), F.lit(" --> "), T.srt_time(F.col("end")))
    return cues.select(*keys, F.col("no").cast("long").alias("no"), F.concat_ws("\n", F.col("no").cast("string"), time, "text", F.lit("")).alias("block"))


def srt_files(blocks: DataFrame, keys: list) -> DataFrame:
    """keys, content: a file's blocks as one string (a file has to fit in a row)."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "block"))), lambda x: F.concat(x["block"], F.lit("\n"))), "")
    return blocks.groupBy(*keys).agg(joined.alias("content"))


def plain_text(cues: DataFrame, keys: list, order: Column) -> DataFrame:
    """keys, content: each text once, in order of its first cue, and an end of line after the last."""
    first = cues.filter("text <> ''").groupBy(*keys, "text").agg(F.min(order).alias("at"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return first.groupBy(*keys).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))


def cue_json(cues: DataFrame, keys: list, order: Column) -> DataFrame:
    """keys, content: an array of {Start, End, Text} in order, indented."""
    one = F.struct(order.alias("o"), F.struct(F.col("start").alias("Start"), F.col("end").alias("End"), F.col("text").alias("Text")).alias("c"))
    ordered = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["c"])
    return cues.groupBy(*keys).agg(F.to_json(ordered, {"pretty": "true"}).alias("content"))
