"""Operator 9: near-duplicate documents by DartMinHash signatures and a banded join.

A text's weighted set: its runs of five words (white-space words, capitals as small letters; all words if
there are fewer), each weighing its number of occurrences. Similarity: weighted Jaccard, at least 0.8.

Darts: the area of an element of weight w is cut into cells of height 1; each cell is hit by a hashed
Poisson process of darts, earliest first, and every dart names one of COORDINATES coordinates. All of a
text's cells are thrown at together until every coordinate has a dart; the earliest dart of each is the
signature. Work grows with cells plus darts, not with their product, and two texts agree in a coordinate
with a probability equal to their weighted Jaccard similarity. 25 bands of 6 coordinates: a pair at 0.8
shares a band in all but 0.05 % of cases, one at 0.9 in all but 10^-8.

Joining, without all pairs of a group: (1) equal texts become one node by their hash; (2) the nodes of a
bucket are each compared with its head, the node with the fullest buckets over all bands (the likely common
origin), so a group of n takes n comparisons; (3) links of those at 0.8 or more give components; (4) only
where a bucket still holds several components are nodes of different components compared with each other,
and only if 0.8 is possible at all: their sizes, less the cells that no other such node has, bound what
they can share, and their known distances to the head bound theirs (weighted Jaccard distance is a metric);
(5) components again. Every pair of a bucket is so either linked, in one component, or proven or found to
be below 0.8.

Comparisons use exact sets of the nodes that have candidates; a filter of their hashes picks their texts in the scan,
so other texts are never shuffled. Buckets are joined between written tables, so that Spark splits the rows of a hot one.

Defined cases: null text counts as empty; all texts without words are one class; null and repeated doc_id
stay, one row each; a very long text takes memory in proportion to its words; class_id is the least doc_id of the class (null if all are null); an empty table gives
no rows; other columns are ignored by `classes` and kept by `keep_one`, which leaves one row of every class,
whether ids are repeated or null: the one of the least doc_id (null after all others), then of the least hash of its text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graph, sketch
from .common import Scratch, fresh, only, table
from .textnum import as_items, mix, shingles, word_hashes

BANDS, ROWS = 25, 6
COORDINATES = BANDS * ROWS
SIMILARITY = 0.8
_STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xE7037ED1A0B428DB)


def signature(items: np.ndarray, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """The dart that comes first in each coordinate, as 64-bit numbers. items: distinct cells' hashes; weights,
    if given, are the items' real weights: cells are then made here, the last one as high as its fraction."""
    height = None
    if weights is not None:
        n = np.ceil(weights).astype(np.int64)
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        height = np.minimum(1.0, np.repeat(weights, n) - turn)
        items = mix(np.repeat(items, n) + turn.astype(np.uint64) * _PLACE)
    total = float(len(items) if height is None else height.sum())
    out = np.zeros(k, np.uint64)
    if not total:
        return out
    until, since = (k * math.log(k) + 2 * k) / total, 0.0
    have = np.zeros(k, bool)
    while True:
        coordinate, rank, name = [], [], []
        cell, when, turn, high = items, np.zeros(len(items)), 0, height
        while len(cell):
            # the next darts of the cells that are not yet past `until`, a few at once
            ahead = max(1, math.ceil((until - (when.min() if turn else 0)) * 1.0 + 1.5 * math.sqrt(until)))
            ahead = min(ahead, max(1, (1 << 20) // len(cell)))
            h = mix(cell[:, None] + (np.arange(turn + 1, turn + ahead + 1, dtype=np.uint64) * _STEP)[None, :])
            t = when[:, None] + np.cumsum(-np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53), axis=1)
            ok = (t <= until) & (t > since)
            if high is not None:
                ok &= (mix(h ^ _PLACE) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < high[:, None]
            rank.append(t[ok])
            name.append(mix(h[ok] + _PLACE))
            go = t[:, -1] <= until
            cell, when, turn = cell[go], t[go, -1], turn + ahead
            high = high[go] if high is not None else None
        rank, name = np.concatenate(rank), np.concatenate(name)
        coordinate = (name % np.uint64(k)).astype(np.int64)
        last = np.argsort(-rank, kind="stable")
        new = np.zeros(k, np.uint64)
        new[coordinate[last]] = name[last]
        hit = np.zeros(k, bool)
        hit[coordinate] = True
        out[hit & ~have] = new[hit & ~have]
        have |= hit
        if have.all():
            return out
        since, until = until, 2 * until


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS)
    h = np.arange(len(rows), dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * _STEP + rows[:, j])
    return h.view(np.int64)


def node_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), node, size (cells), bands (none for a text without words: such texts share one node)."""

    def run(batches):
        for batch in batches:
            size, bands = [], []
            for words in word_hashes(batch.column(2).to_pylist()):
                items = as_items(shingles(words))
                size.append(len(items))
                bands.append(band_keys(signature(items)) if len(items) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "hash": batch.column(1), "size": pa.array(size, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    rows = only(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", node_of(F.col("text")).alias("hash"), "text")
    return rows.mapInArrow(run, "doc_id long, hash binary, size long, bands array<long>").withColumn("node", F.when(F.col("size") == 0, F.lit(b"none")).otherwise(F.col("hash")))


def _entries(nodes: DataFrame, crowd: DataFrame) -> DataFrame:
    """id, size, band, key of the nodes' buckets that may be in `crowd`: a filter of its keys spares the others a shuffle."""
    table_ = sketch.build(crowd, "key")

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            n, keys = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            band = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(sketch.hits(table_.value, keys))
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(at), "size": batch.column(1).take(at), "band": pa.array(band[hit].astype(np.int32)), "key": pa.array(keys[hit].view(np.int64))})

    return nodes.select("id", "size", "bands").mapInArrow(run, "id long, size long, band int, key long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, items): the sorted cells of the wanted nodes (id long, node binary)."""
    table_ = sketch.build(wanted.select(_short(F.col("node")).alias("h")))

    def run(batches):
        for batch in batches:
            h = np.frombuffer(b"".join(n[:8] for n in batch.column(0).to_pylist()), ">u8").astype(np.uint64)
            batch = batch.filter(pa.array(sketch.hits(table_.value, h)))
            items = [as_items(shingles(w)).astype("<u8").tobytes() for w in word_hashes(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "items": pa.array(items, pa.binary())})

    rows = only(docs, ("text", "string")).select(node_of(F.col("text")).alias("node"), "text").mapInArrow(run, "node binary, items binary")
    return rows.dropDuplicates(["node"]).join(wanted, "node").select("id", "items")


def _short(node: Column) -> Column:
    """The first eight bytes of a node as a number."""
    h = F.hex(F.substring(node, 1, 8))
    half = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with sim, their exact weighted Jaccard similarity."""

    def run(batches):
        for batch in batches:
            sim = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                sim.append(common / max(1, len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), "sim": pa.array(sim, pa.float64())})

    one, two = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, sim double")


def _own_items(sets: DataFrame) -> DataFrame:
    """(id, own): how many cells of a node are in none of the others; they can't be shared with any."""

    def run(batches):
        for batch in batches:
            for node, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = np.frombuffer(items, "<i8")
                yield pa.RecordBatch.from_pydict({"item": pa.array(items), "id": pa.array(np.full(len(items), node, np.int64))})

    one = sets.select("id", "items").mapInArrow(run, "item long, id long").groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return one.groupBy("id").agg(F.count("*").alias("own"))


def _roots(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (node, root, n_links) of their nodes."""
    keep = Scratch(docs.sparkSession)
    signed = keep.write(_signed(docs), "signed")
    # ids are frozen by writing them out
    nodes = keep.write(signed.select("node", "size", "bands").dropDuplicates(["node"]).withColumn("id", F.monotonically_increasing_id()), "nodes")
    # what is joined by bucket is written first: both sides are then plain tables, so that a hot bucket's rows are split
    crowd = keep.write(nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "crowd")
    member = keep.write(_entries(nodes, crowd).join(crowd, "key"), "members")  # of buckets with two nodes or more
    # a bucket's head is its most central node, the one with the fullest buckets over all bands
    central = member.groupBy("id").agg(F.sum("n").alias("c"))
    heads = member.join(central, "id").groupBy("band", "key").agg(F.max(F.struct("c", (-F.col("id")).alias("no"))).alias("top")).select("band", "key", (-F.col("top.no")).alias("head"))
    heads = keep.write(heads, "heads")
    headed = keep.write(member.drop("n").join(heads, ["band", "key"]), "headed")
    keep.drop(crowd, heads, member)
    member = headed
    pairs = member.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    wanted = keep.write(member.select("id").distinct().join(nodes.select("id", "node"), "id"), "wanted")
    sets = keep.write(_sets(docs, wanted), "sets")
    near = keep.write(compare(pairs, sets), "near")
    linked = near.filter(F.col("sim") >= similarity).select("a", "b")
    root = keep.write(graph.components(linked, keep), "roots")

    # buckets that still hold several components: other pairs that could be similar
    known = near.select(F.col("a").alias("head"), F.col("b").alias("id"), "sim")
    rest = keep.write(member.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    open_ = rest.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("band", "key")
    open_ = keep.write(open_, "openings")
    rest = keep.write(rest.join(open_, ["band", "key"]).join(known, ["head", "id"], "left").withColumn("sim", F.coalesce("sim", F.lit(1.0))), "open")
    own = _own_items(sets.join(rest.select("id").distinct(), "id"))
    rest = rest.join(nodes.select("id", "bands"), "id").join(own, "id", "left").withColumn("most", F.col("size") - F.coalesce("own", F.lit(0))).withColumn("step", F.floor(F.log(F.col("size")) / -math.log(similarity)))
    x = rest.select("band", "key", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("size").alias("na"), F.col("bands").alias("ba"), F.col("most").alias("ma"), F.col("sim").alias("sa"), F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    y = rest.select("band", "key", F.col("id").alias("b"), F.col("root").alias("rb"), F.col("size").alias("nb"), F.col("bands").alias("bb"), F.col("most").alias("mb"), F.col("sim").alias("sb"), "step")
    bound = (1 + similarity) * F.least("ma", "mb") >= similarity * (F.col("na") + F.col("nb")) - 1e-6
    could = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & bound & (F.abs(F.col("sa") - F.col("sb")) <= 1 - similarity + 1e-9)
    # a pair is made in the first band that it shares, not in each
    first = F.array_position(F.zip_with("ba", "bb", lambda p, q: p == q), F.lit(True)) == F.col("band") + 1
    more = x.join(y, ["band", "key", "step"]).filter(could & first).select("a", "b").distinct().join(near.select("a", "b"), ["a", "b"], "left_anti")
    links = keep.write(linked.unionByName(compare(more, sets).filter(F.col("sim") >= similarity).select("a", "b")), "links")
    root = graph.components(links, keep)

    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    of_node = nodes.select("id", "node").join(root, "id", "left").join(degree, "id", "left").select("node", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed, of_node


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links (compared pairs at or above the threshold of the document's text)."""
    signed, of_node = _roots(docs, similarity)
    least = signed.groupBy("node").agg(F.min("doc_id").alias("least")).join(of_node.select("node", "root"), "node").groupBy("root").agg(F.min("least").alias("class_id"))
    return signed.select("doc_id", "node").join(of_node.join(least, "root"), "node").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the other rows of each class: the first by (doc_id, nulls last, hash of the text) stays."""
    signed, of_node = _roots(docs, similarity)
    first = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first"))
    first = first.join(of_node.select("node", "root"), "node").groupBy("root").agg(F.min("first").alias("first"))
    hash_, all_, no, id_, kept = fresh(docs.columns, "hash", "all", "no", "id", "kept")
    first = first.select(F.col("first.doc_id").alias(id_), F.col("first.hash").alias(kept))
    rows = docs.withColumn(hash_, node_of(F.col("text").cast("string")))
    some = rows.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(kept)), "left_semi")
    # rows that are equal in both stand for one document
    w = Window.partitionBy("doc_id", hash_).orderBy(all_)
    return some.withColumn(all_, F.xxhash64(*docs.columns)).withColumn(no, F.row_number().over(w)).filter(F.col(no) == 1).drop(hash_, all_, no)


def op9_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
