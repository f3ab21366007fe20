"""Operator 5: chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one stream of characters, turn after turn:

    <|turn|>role\\n text <|end|>\\n

and every assistant turn is exploded into an example of its own: its context is the stream from 0 up to the
end of that turn's header (all preceding turns), its target is the turn's text, and only the target is
trainable. `expand` makes these examples from the formatted turns in the same pass that hands on the turns themselves (one
explode). An example is held as spans of the stream (context from 0 to context_end, loss from loss_start to
loss_end) with its reply and the number of turns before it, so that a conversation of n turns takes n rows;
`examples` writes contexts out for the conversations it is given, in characters that grow with n squared. The query
reads its loss digests and context lengths back from the example rows.

Control strings inside roles and texts are escaped reversibly: % as %25, and the first character of <|turn|>,
<|end|>, <s>, </s>, [INST], [/INST], <<SYS>> and <</SYS>> as %3C or %5B. Role escapes newlines as %0A too.

Offsets are running sums of lengths, taken in two steps (within blocks of 256 turns by number, then over a
conversation's blocks), so that a conversation that holds a third of all rows is sorted in many tasks.

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; turns are
ordered by (turn, role, text), null turn first, so ties and repeated rows have an order and stay; an empty
table gives no rows; other columns are ignored; a conversation without an assistant turn has no example,
and its loss is the hash of nothing. A digest of a whole conversation needs its text in one row, which Spark
limits to 2 GB; formatting and expanding have no such limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, table

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings of this and of common other templates.
CONTROLS = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BLOCK = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(("%3C" if c[0] == "<" else "%5B") + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for code, char in (("%3C", "<"), ("%5B", "["), ("%0A", "\n"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 0, across the conversation), segment, seg_start, seg_end, is_target, context_end, loss_start, loss_end."""
    rows = only(conversations, ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")).fillna("", ["role", "text"])
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, escape(F.col("text")), F.lit(END))).withColumn("chars", F.length("segment").cast("long"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text", "segment")
    rows = rows.withColumn("no", F.row_number().over(within) - 1).withColumn("upto", F.sum("chars").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("chars").alias("c"), F.count("*").alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    start, target = F.col("c0") + F.col("upto") - F.col("chars"), F.col("role") == "assistant"
    loss = start + F.col("head")
    return rows.select("conv_id", (F.col("n0") + F.col("no")).alias("turn_no"), "segment", start.alias("seg_start"), (start + F.col("chars")).alias("seg_end"), target.alias("is_target"),
                       F.when(target, loss).alias("context_end"), F.when(target, loss).alias("loss_start"), F.when(target, start + F.col("chars") - len(END)).alias("loss_end"))


def streams(turns: DataFrame) -> DataFrame:
    """conv_id, stream: the segments in order, joined within blocks first."""
    part = turns.groupBy("conv_id", F.floor(F.col("turn_no") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_no", "segment"))), lambda x: x["segment"]), "").alias("s"))
    return part.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "s"))), lambda x: x["s"]), "").alias("stream"))


def expand(turns: DataFrame) -> DataFrame:
    """A row for each turn (example false: its segment) and one more for each assistant turn (example true: context_end,
    loss_start and loss_end in the stream, its reply as it stands under the loss mask, and the turns of its context)."""
    masked = F.expr("substring(segment, cast(loss_start - seg_start as int) + 1, cast(loss_end - loss_start as int))")
    none = F.lit(None)
    kind = "array<struct<example:boolean,text:string,seg_end:long,context_end:long,loss_start:long,loss_end:long,context_turns:long>>"
    turn = F.struct(F.lit(False), "segment", "seg_end", none, none, none, none)
    example = F.struct(F.lit(True), masked, none, "context_end", "loss_start", "loss_end", F.col("turn_no"))
    parts = F.when(F.col("is_target"), F.array(turn.cast(kind[6:-1]), example.cast(kind[6:-1]))).otherwise(F.array(turn.cast(kind[6:-1])))
    return turns.select("conv_id", "turn_no", F.explode(parts).alias("p")).select("conv_id", "turn_no", "p.*")


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, turn_no, context, target: written out, for the conversations of these turns."""
    s = streams(turns).withColumnRenamed("conv_id", "_conv")
    t = expand(turns).filter("example").join(s, F.col("conv_id").eqNullSafe(F.col("_conv")))
    part = lambda a, b: F.substring(F.col("stream"), (a + 1).cast("int"), (b - a).cast("int"))
    return t.select("conv_id", "turn_no", part(F.lit(0), F.col("context_end")).alias("context"), unescape(part(F.col("loss_start"), F.col("loss_end"))).alias("target"))


def read_back(rows: DataFrame) -> DataFrame:
    """The digests of the query, from `expand`'s rows alone: turns from the segments, losses and contexts from the examples."""
    # a turn's role and text, from its segment
    body = F.expr(f"substring(text, {len(TURN) + 1}, length(text) - {len(TURN) + len(END)})")
    role, own = F.substring_index(body, "\n", 1), ~F.col("example")
    rows = rows.withColumn("body", F.when(own, body)).withColumn("role", F.when(own, role))
    rows = rows.withColumn("plain", F.when(own, F.concat(unescape(F.col("role")), F.lit("\n"), unescape(F.expr("substring(body, length(role) + 2)")), F.lit("\n"))))
    rows = rows.withColumn("loss", F.when(F.col("example"), unescape(F.col("text"))))
    ordered = lambda key, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(key, c)))), lambda x: x[c]), "").alias(c)
    count = lambda c: F.sum(c.cast("long"))
    part = rows.groupBy("conv_id", F.floor(F.col("turn_no") / BLOCK).alias("block")).agg(ordered("turn_no", "plain"), ordered("turn_no", "loss"), count(own).alias("n"), F.max("seg_end").alias("chars"), count(F.col("example")).alias("k"), F.sum(F.coalesce("context_end", F.lit(0))).alias("c"))
    whole = part.groupBy("conv_id").agg(ordered("block", "plain"), ordered("block", "loss"), F.sum("n").alias("n_turns"), F.max("chars").alias("formatted_chars"), F.sum("k").alias("n_examples"), F.sum("c").alias("context_chars"))
    return whole.select("conv_id", "n_turns", F.sha2("plain", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "context_chars")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = only(table(spark, sf_dir, "conversations"), ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))
    hard = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_back(expand(format_turns(rows.unionByName(own))))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'), '<|turn|>', '%3C|turn|>'), '<|end|>', '%3C|end|>'), '<s>', '%3Cs>'), '</s>', '%3C/s>'),
    '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]'), '<<SYS>>', '%3C<SYS>>'), '<</SYS>>', '%3C</SYS>>')) + length(role) + 17 AS chars FROM c),
p AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  CAST(coalesce(sum(before + 9 + length(role)) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars
FROM p GROUP BY conv_id
"""
