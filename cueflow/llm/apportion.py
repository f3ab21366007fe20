"""Operator 12: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources, in code-point order and null last, have the weights 5, 2, 1, repeating. They share all words by weight; a target
stops at MOST times its source's words, and the excess is shared anew until none is above (rounds of one small sum each).

A source's documents lie in a line, in the order of a seeded hash, and the line is cut into blocks of equal length. Blocks
are handed out one by one to the source with the highest quotient target / (2k + 1), k being the blocks that it has (ties:
the earlier source), until all words are handed out; a block can be taken MOST times. As any beginning of this sequence
is an apportionment of its own, it is cut into SHARDS parts of equal length, and each source has an integer quota in each
of them. The quotients are not listed: a divisor gives all seats but about as many as there are sources, and only those
next to the border are ranked. A source's k-th block is then the k-th of its line from a seeded start on, around and
around; the line being in seeded order, that is a seeded choice.

Blocks have one word for every 2^18 of all words, 1 to 1,024. A document's pieces are found from its place in the line:
one row a document, no row for a block. Its place is a running sum over ranges of (source, hash), so a source that holds
most rows is spread over as many tasks as its rows need; sources are a table, joined as its size allows.

Defined cases: a null text has no words; the null source is one of its own, the empty one another; documents without
words take part with no pieces; sources without words have the target 0; a null doc_id is hashed as empty; repeated rows
are documents of their own, whose pieces may be told apart by nothing; very long texts are cut like any other; an
empty table gives no rows; other columns, also ones with names used here, are ignored. Same input, same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, Scratch, only, running, table

WEIGHTS, MOST, SHARDS, SEED = (5, 2, 1), 3, 8, "mix"
BLOCKS, LONGEST_BLOCK = 1 << 18, 1024
PIECE = "array<struct<shard: int, block: long, pass: int, word_start: long, word_end: long>>"


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words, h (the seeded order within a source), uid."""
    rows = only(docs, ("doc_id", "long"), ("text", "string"), ("source", "string"))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")
    return rows.select("doc_id", "source", size.alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("uid"))


def _big(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(19,0)")


def targets(sources: DataFrame, total: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size, place from 0) with target (double)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    s = sources.withColumn("weight", weight)
    share, parts = total, s.agg(F.sum("weight")).first()[0]
    while True:  # the level share / parts only rises, and what it stops stays so
        full = _big(F.col("source_size")) * _big(most * parts) <= _big(F.col("weight")) * _big(share)
        held, rest = s.agg(F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total - (held or 0), rest or 0)
        if now == (share, parts) or not now[1]:
            break
        share, parts = now
    free = F.col("weight").cast("double") * F.lit(float(share)) / F.lit(float(parts))
    return s.withColumn("target", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(free)).drop("weight")


def quotas(sources: DataFrame, houses: list[int], keep: Scratch) -> DataFrame:
    """sources (source, place, target, most_seats) with seats: for each house (growing numbers of seats) how many of its
    first seats the source has. Seats go to the highest quotients, ties to the smaller place."""
    n, total = sources.agg(F.count("*"), F.sum("target")).first()
    seats = lambda d: F.least(F.col("most_seats"), F.floor(F.col("target") / F.lit(d) + 0.5).cast("long"))
    none, every = F.lit(0).cast("long"), F.col("most_seats")
    below = [seats(total / (m - n - 2)) if m > n + 2 and total else none for m in houses]
    above, wider, want = [every] * len(houses), n + 2, range(len(houses))
    while want and total:  # seats that are full leave the rest to others: a smaller divisor until there are enough
        tried = {j: seats(total / (houses[j] + wider)) for j in want}
        found = sources.agg(*[F.sum(c) for c in tried.values()]).first()
        above = [tried.get(j, c) for j, c in enumerate(above)]
        want = [j for j, x in zip(tried, found) if x < houses[j] and wider < 1 << 60]
        wider *= 8
    held = sources.agg(*[F.sum(c) for c in below]).first()
    by_house = F.explode(F.array(*[F.struct(F.lit(j).alias("house"), a.alias("low"), b.alias("high")) for j, (a, b) in enumerate(zip(below, above))]))
    s = keep.write(sources.select("source", "place", "target", by_house.alias("x")).select("source", "place", "target", "x.*"), "brackets")
    border = s.filter("high > low").select("house", "place", "target", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
    border = border.select("house", "place", (F.col("target") / (2 * F.col("k") + 1)).alias("quotient"))
    ranked = running(keep.write(border, "border"), [F.col("house"), F.desc("quotient"), F.col("place")], F.lit(1), "rank", keep)
    open_ = {r[0]: r[1] for r in border.groupBy("house").count().collect()}  # a row a house
    last, at = [], 0
    for j, m in enumerate(houses):
        last.append(at + m - (held[j] or 0))
        at += open_.get(j, 0)
    taken = ranked.filter(F.col("rank") < F.element_at(F.array(*[F.lit(x).cast("long") for x in last]), F.col("house") + 1))
    won = taken.groupBy("house", "place").agg(F.count("*").alias("won"))
    each = s.join(won, ["house", "place"], "left").select("place", F.struct("house", (F.col("low") + F.coalesce("won", none)).alias("seats")).alias("x"))
    lists = each.groupBy("place").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["seats"]).alias("seats"))  # a house each
    return sources.join(lists, "place")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, block: int | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and pieces: what the mix takes of a document, as word spans with their
    output shard, their block in the source's line and the pass (from 0) over that line."""
    spark, keep = docs.sparkSession, Scratch(docs.sparkSession)
    rows = keep.write(sizes(docs, seed), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    long = block or max(1, min(LONGEST_BLOCK, total // BLOCKS))
    by_source = [F.col("source").asc_nulls_last()]
    s = keep.write(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    s = keep.write(running(running(s, by_source, F.lit(1), "place", keep), by_source, F.col("source_size"), "first", keep), "places")
    s = keep.write(targets(s, total, weights, most), "targets") if total else s.withColumn("target", F.lit(0.0))
    n_blocks = F.ceil(F.col("source_size") / F.lit(long)).cast("long")
    s = s.withColumn("blocks", n_blocks).withColumn("most_seats", most * n_blocks)
    places = (2 * total + long) // (2 * long)
    s = quotas(s, [places * (j + 1) // shards for j in range(shards)], keep)
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("long")
    s = keep.write(s.select(F.col("source").alias("_source"), "source_size", "target", "first", "blocks", "seats", F.when(F.col("blocks") > 0, number % F.col("blocks")).alias("start")), "quotas")
    line = running(rows, [*by_source, F.col("h"), F.col("doc_id"), F.col("uid")], F.col("size"), "at", keep)
    line = line.join(s, F.col("source").eqNullSafe(F.col("_source"))).withColumn("at", F.col("at") - F.col("first"))
    c, end = F.col, F.col("at") + F.col("size")

    def of_block(b: Column) -> Column:
        a, z, turn = F.greatest(b * long, c("at")), F.least((b + 1) * long, end), F.pmod(b - c("start"), c("blocks"))
        return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.struct(F.size(F.filter("seats", lambda q: q <= p * c("blocks") + turn)).alias("shard"), b.alias("block"), p.alias("pass"), (a - c("at")).alias("word_start"), (z - c("at")).alias("word_end")))

    inside = F.filter(F.flatten(F.transform(F.sequence(F.floor(c("at") / long), F.floor((end - 1) / long)), of_block)), lambda x: x["shard"] < shards)
    pieces = F.when(c("size") > 0, inside.cast(PIECE)).otherwise(F.array().cast(PIECE))
    return line.select("doc_id", "source", "size", "source_size", "target", pieces.alias("pieces"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["word_end"] - x["word_start"])
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT *, [5, 2, 1][place % 3 + 1] AS w FROM (SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source)),
g AS (SELECT sum(s)::HUGEINT AS t, greatest(1, least(1024, sum(s) // 262144))::BIGINT AS b FROM p),
v AS (SELECT 0 AS i, t AS num, (SELECT sum(w)::HUGEINT FROM p) AS den FROM g
  UNION ALL SELECT i + 1, n.num, n.den FROM (SELECT any_value(v.i) AS i, any_value(v.num) AS o, any_value(v.den) AS od, any_value(g.t) - coalesce(sum(CASE WHEN 3 * s * v.den <= w * v.num THEN 3 * s END), 0) AS num, coalesce(sum(CASE WHEN 3 * s * v.den > w * v.num THEN w END), 0)::HUGEINT AS den FROM v, p, g) n
    WHERE n.i < 1000 AND n.den > 0 AND (n.num <> n.o OR n.den <> n.od)),
l AS (SELECT num, den FROM v ORDER BY i DESC LIMIT 1),
q AS (SELECT p.*, CASE WHEN 3 * s * den <= w * num THEN (3 * s)::DOUBLE ELSE w::DOUBLE * num::DOUBLE / den::DOUBLE END AS target, ceil(s / b::DOUBLE)::BIGINT AS blocks FROM p, l, g),
seat AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS r FROM (SELECT place, target, unnest(range(0, 3 * blocks)) AS k FROM q)),
won AS (SELECT place, count(*) AS seats FROM seat, g WHERE r <= (2 * t + b) // (2 * b) GROUP BY 1),
n AS (SELECT q.*, coalesce(seats, 0) AS seats, CASE WHEN blocks > 0 THEN ('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 8))::BIGINT % blocks END AS start FROM q LEFT JOIN won USING (place)),
line AS (SELECT uid, doc_id, size, s, target, blocks, seats, start, b, coalesce(sum(size) OVER (PARTITION BY place ORDER BY h, doc_id, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source, g),
piece AS (SELECT uid, b, pos, size, blocks, seats, start, unnest(range(pos // b, (pos + size - 1) // b + 1)) AS k FROM line WHERE size > 0),
took AS (SELECT uid, sum((least((k + 1) * b, pos + size) - greatest(k * b, pos)) * greatest(0, least(3, (seats - ((k - start) % blocks + blocks) % blocks + blocks - 1) // blocks))) AS taken FROM piece GROUP BY 1)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM line LEFT JOIN took USING (uid)
"""
