"""Operator 4: language-model scoring by deleted interpolation.

p(w | v) = a2 c(v w)/c(v) + a1 c(w)/N + a0/(V+1), the weights a chosen by the bucket of the context's
frequency c(v) (powers of two). The weights are learned by expectation-maximisation on held-out counts: one
part of the training documents (crc32 mod 7 equal to EM_FOLD) is deleted from the counts, and its bigrams
are explained by those of the rest. Then all training documents are counted.

Steps: documents become blocks of about BLOCK_CHARS characters, held as word hashes; every block sends its
distinct words and bigrams with their training counts, summed within the block, to partitions by key; a
partition adds them up and returns to every block the totals of its own keys; blocks and totals are written
together, for EM statistics and for scores. What travels grows with the distinct n-grams of a block, and a frequent
word is one row a block. There are as many partitions as blocks, so that a partition holds about a block's number of
keys, and a block gets back one total for each of its own keys, whatever the size of the corpus: all that a task holds
is bounded by BLOCK_CHARS (or one text, if longer). Exchanges have a row for each block and partition that share a key,
at most one for each distinct n-gram of a block. EM itself sees at most BUCKETS x LEVELS x LEVELS cells.

Defined cases: null text is empty (one token, the end); null doc_id hashes as an empty string and stays
null; repeated rows are each counted and scored; without training documents every probability is
1/(V+1) = 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, digest_of, only, table
from .textnum import mix, word_hashes

FOLDS, HELD_OUT, EM_FOLD = 7, 2, 3
BLOCK_CHARS, LEAST_PARTS = 8_000_000, 16
BUCKETS, LEVELS = 24, 40
#: A bigram is known by so many bits more than its number could have: it meets another with a chance of at most 2^-20.
SPARE_BITS = 20
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x7C3D2B1A59F06E85)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _blocks(docs: DataFrame) -> DataFrame:
    """block, doc_ids, folds, lengths (tokens), words (distinct, frequent first), tokens (their places)."""

    def make(rows):
        doc_ids, folds, parts = zip(*rows)
        words, tokens, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return pa.RecordBatch.from_pydict({"block": pa.array([uuid.uuid4().hex]), "doc_ids": pa.array([list(doc_ids)], pa.list_(pa.int64())), "folds": pa.array([list(folds)], pa.list_(pa.int32())), "lengths": pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), "words": pa.array([_pack_keys(words[order])], pa.binary()), "tokens": pa.array([_pack_counts(place[tokens])], pa.binary())})

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for d, f, t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, word_hashes(texts)):
                rows.append((d, f, np.append(w, END)))
                size += len(t or "")
                if size > BLOCK_CHARS:
                    yield make(rows)
                    rows, size = [], 0
        if rows:
            yield make(rows)

    rows = only(docs, ("doc_id", "long"), ("text", "string"))
    return rows.select("doc_id", (digest_of(rows) % FOLDS).cast("int").alias("fold"), "text").mapInArrow(run, "block string, doc_ids array<long>, folds array<int>, lengths array<int>, words binary, tokens binary")


def _pack_keys(x: np.ndarray) -> bytes:
    """64-bit keys in sorted runs: their differences, by byte place."""
    return _pack(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, "u1").reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts by byte place: the upper places are nearly all zero."""
    return _pack(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unpack_counts(b: bytes) -> np.ndarray:
    return _unpack(b, "u1").reshape(4, -1).T.copy().view("<u4").ravel()


class Block:
    """The n-grams of a block: keys[o] sorted and distinct, at[o] the place of each token's n-gram.

    A word is a context as often as it is a word, and the start as often as the end, so contexts need no
    keys of their own."""

    def __init__(self, folds, lengths, words: bytes, tokens: bytes, pair_bits: int):
        n = np.array(lengths, np.int64)
        w = _unpack_keys(words)[_unpack_counts(tokens)]
        self.first = np.cumsum(n) - n
        self.fold = np.repeat(np.array(folds, np.int64), n)
        before = np.concatenate([[START], w[:-1]])
        before[self.first] = START
        self.keys, self.at = {}, {}
        for o, k in ((1, mix(w + np.uint64(1))), (2, mix(mix(before) + w) >> np.uint64(64 - pair_bits))):
            self.keys[o], self.at[o] = np.unique(k, return_inverse=True)

    def counts(self, o: int, rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.at[o][rows], minlength=len(self.keys[o])).astype("<u4")

    def contexts(self, word: np.ndarray) -> np.ndarray:
        """What belongs to each token's context, from what belongs to the tokens."""
        out = np.concatenate([word[:1], word[:-1]])
        out[self.first] = word[-1]  # a block ends with an end
        return out


def _requests(blocks: DataFrame, bits: int, pair_bits: int) -> DataFrame:
    """order (1 word, 2 bigram), part, block, keys, c (training counts), d (those of the EM fold)."""

    def run(batches):
        for batch in batches:
            for block, folds, lengths, words, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                b = Block(folds, lengths, words, tokens, pair_bits)
                out: list[list] = [[] for _ in range(6)]
                for o, keys in b.keys.items():
                    c, d = b.counts(o, b.fold != HELD_OUT), b.counts(o, b.fold == EM_FOLD)
                    edge = np.searchsorted(keys >> np.uint64((64 if o == 1 else pair_bits) - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                    for p in np.flatnonzero(np.diff(edge)).tolist():
                        s = slice(edge[p], edge[p + 1])
                        for x, y in zip(out, (o, p, block, _pack_keys(keys[s]), _pack_counts(c[s]), _pack_counts(d[s]))):
                            x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], names=["o", "p", "block", "keys", "c", "d"])

    return blocks.mapInArrow(run, "o int, p int, block string, keys binary, c binary, d binary")


def _totals(requests: DataFrame) -> DataFrame:
    """For every request the totals of its keys (c; d where the block has the key in the EM fold), and the part's types and tokens: of all training counts
    (types, n) and without the EM fold (types_e, n_e)."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack_keys(b) for b in f["keys"]]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        rows, sums, ends = f[["o", "p", "block"]].copy(), {}, np.cumsum([len(k) for k in keys])[:-1]
        for name in ("c", "d"):
            sums[name] = np.bincount(where, np.concatenate([_unpack_counts(b) for b in f[name]]), len(distinct)).astype("<u4")
        rows["c"] = [_pack_counts(x) for x in np.split(sums["c"][where], ends)]
        rows["d"] = [_pack_counts(np.where(_unpack_counts(own) > 0, x, 0)) for own, x in zip(f["d"], np.split(sums["d"][where], ends))]
        for end, x in (("", sums["c"]), ("_e", sums["c"] - sums["d"])):
            rows[f"types{end}"], rows[f"n{end}"] = int((x > 0).sum()), int(x.sum(dtype=np.int64))
        return rows

    return requests.groupBy("o", "p").applyInPandas(add, "o int, p int, block string, c binary, d binary, types long, n long, types_e long, n_e long")


def _parts(b: Block, given: list, without_em: bool = False) -> tuple[np.ndarray, ...]:
    """Counts of each token's context, word and bigram."""
    out = []
    for o in (1, 2):
        got = [_unpack_counts(g["c"]) - (_unpack_counts(g["d"]) if without_em else np.uint32(0)) for g in sorted((g for g in given if g["o"] == o), key=lambda g: g["p"])]
        out.append(np.concatenate(got)[b.at[o]].astype(np.float64))
    return b.contexts(out[0]), *out


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0))


def em(cells: np.ndarray, v: float, rounds: int = 200) -> np.ndarray:
    """Weights (bucket, 3) from rows (bucket, count, mean p2, mean p1): bigram, unigram, uniform."""
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    out[0] = [0, 0.9, 0.1]
    for b in range(BUCKETS):
        mine = cells[cells[:, 0] == b]
        if not len(mine):
            continue
        p = np.column_stack([mine[:, 2], mine[:, 3], np.full(len(mine), 1 / (v + 1))])
        if b == 0:
            p[:, 0] = 0
        a = out[b].copy()
        for _ in range(rounds):
            share = p * a
            share /= share.sum(1, keepdims=True)
            # one count of each kind keeps every weight above zero
            a = (share * mine[:, 1:2]).sum(0) + [0 if b == 0 else 0.1, 0.1, 0.1]
            a /= a.sum()
        out[b] = a
    return out


def score(docs: DataFrame) -> DataFrame:
    keep = Scratch(docs.sparkSession)
    blocks = keep.write(_blocks(docs), "blocks")
    n_blocks, n_tokens = blocks.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    pair_bits = min(64, SPARE_BITS + int(np.ceil(np.log2(n_tokens + 1))))
    bits = int(np.ceil(np.log2(max(LEAST_PARTS, n_blocks))))
    sizes = ("types", "n", "types_e", "n_e")
    totals = _totals(_requests(blocks, bits, pair_bits).repartition(2 << bits, "o", "p"))
    given = totals.groupBy("block").agg(F.collect_list(F.struct("o", "p", "c", "d")).alias("given"), F.collect_list(F.when(F.col("o") == 1, F.struct("p", *sizes))).alias("sizes"))
    met = keep.write(blocks.join(given, "block"), "met")
    keep.drop(blocks)
    # every block that asked a part has the part's sizes: once each
    size = met.select(F.explode("sizes").alias("s")).select("s.*").distinct().agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sizes]).first()
    cols = ("doc_ids", "folds", "lengths", "words", "tokens", "given")

    def statistics(batches):
        n = max(1, size["n_e"])
        for batch in batches:
            for _, folds, lengths, words, tokens, g in zip(*(batch.column(c).to_pylist() for c in cols)):
                b = Block(folds, lengths, words, tokens, pair_bits)
                rows = b.fold == EM_FOLD
                context, word, pair = (x[rows] for x in _parts(b, g, True))
                p2, p1 = pair / np.maximum(1, context), word / n
                level = lambda p: np.where(p > 0, np.minimum(LEVELS - 1, 1 - np.log2(np.maximum(p, 2.0**-60))).astype(np.int64), LEVELS - 1)
                cell = (_bucket(context) * LEVELS + level(p2)) * LEVELS + level(p1)
                u, i, c = np.unique(cell, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(u, pa.int64()), "n": pa.array(c, pa.int64()), "p2": pa.array(np.bincount(i, p2, len(u)), pa.float64()), "p1": pa.array(np.bincount(i, p1, len(u)), pa.float64())})

    found = met.select(*cols).mapInArrow(statistics, "cell long, n long, p2 double, p1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).collect()
    weights = em(np.array(sorted((r["cell"] // LEVELS**2, r["n"], r["p2"] / r["n"], r["p1"] / r["n"]) for r in found), np.float64).reshape(-1, 4), float(size["types_e"]))
    n_all, v = int(size["n"]), int(size["types"])

    def scores(batches):
        for batch in batches:
            for doc_ids, folds, lengths, words, tokens, g in zip(*(batch.column(c).to_pylist() for c in cols)):
                b = Block(folds, lengths, words, tokens, pair_bits)
                context, word, pair = _parts(b, g)
                a = weights[_bucket(context)]
                p = a[:, 0] * pair / np.maximum(1, context) + a[:, 1] * word / max(1, n_all) + a[:, 2] / (v + 1)
                p = p if n_all else np.ones(len(p))
                add = lambda x: np.add.reduceat(x, b.first)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array([f == HELD_OUT for f in folds]), "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(add((word > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([n_all] * len(folds), pa.int64()), "base_score": pa.array(add(np.log10((word + 1) / (n_all + v + 1))), pa.float64()), "score": pa.array(add(np.log10(p)), pa.float64())})

    return met.select(*cols).mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
