"""Operator 2: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts every text where the hash has ten zero bits (chunks of about 1 KB,
256 bytes at least, 8 KB at most), so equal passages are cut alike wherever they stand. Chunks that occur
more than once in the corpus are encoded once, and every text takes their ids from that dictionary; what
lies between is encoded where it stands. Ids near a cut may differ from those of the whole text, so every
join is repaired: a window around it, from a place before to a place after where the pre-tokenizer splits
whatever surrounds it (a space between two Latin letters), is encoded again, and the window grows until
its two ends agree with token boundaries of the neighbouring pieces.

Steps: (1) chunk hashes are counted (summed in the task, then shuffled: 16 bytes a chunk), and those seen
twice set two bits in a filter (`sketch.py`, 128 MB at most), all that is broadcast; (2) one scan writes
finished results of texts without shared chunks, and, for the others, the compressed text and its shared
chunks; (3) each distinct shared chunk is encoded, joined back by its 128-bit hash, and the texts are put
together. A false hit of the filter only sends a chunk through the dictionary; results never depend on it.

Defined cases: null text is encoded as an empty one (no ids, the hash of nothing); null and repeated
doc_id stay as they are, one row each; an empty table gives no rows; other columns are ignored; a text
without any safe place is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, sketch
from .common import Scratch, only, table

WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 256, 8192
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks int, n_reused int"
SYNC = re.compile(rb"[A-Za-z](?= [A-Za-z])")


@cache
def _byte_table() -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(b"chunk").digest(4 * 256), np.uint32)


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Offsets (of a cut's right side) at which the rolling hash of the 16 bytes before says so."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    h, span, mult = _byte_table()[data], 1, np.uint32(0x9E3779B1)
    while span < WINDOW:
        nxt = h.copy()
        nxt[span:] += h[:-span] * mult
        h, mult, span = nxt, np.uint32(int(mult) * int(mult) & 0xFFFFFFFF), 2 * span
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    at = at[(at >= WINDOW) & (at < len(data))]
    return at[(data[at] & 0xC0) != 0x80]


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8; all on character boundaries."""
    out, last, n = [], 0, len(raw)
    for c in [*cut_candidates(np.frombuffer(raw, np.uint8)).tolist(), n]:
        while c - last > MOST:
            e = last + MOST
            while raw[e] & 0xC0 == 0x80:
                e -= 1
            out.append(e)
            last = e
        if c - last >= LEAST or c == n and c > last:
            out.append(c)
            last = c
    return out


def put_together(codec: bpe.Codec, raw: bytes, pieces: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """The ids of the whole text from the ids of pieces that follow each other: (start, end, ids)."""
    width = codec.width
    done: list[tuple[np.ndarray, np.ndarray]] = []  # ids, and where each of them ends

    def add(start: int, ids: np.ndarray) -> None:
        if len(ids):
            done.append((ids, start + np.cumsum(width[ids])))

    def boundary(x: int) -> bool:
        for _, e in reversed(done):
            k = int(np.searchsorted(e, x))
            if k == len(e) or k:
                return k < len(e) and e[k] == x
            if e[0] == x:
                return True
        return x == 0

    at = 0
    for start, end, ids in pieces:
        if start == 0 or end <= at:
            if end > at:
                add(start, ids)
                at = end
            continue
        ends = start + np.cumsum(width[ids])
        reach = 32
        while True:
            lo = max(0, at - reach)
            left = max((m.end() for m in SYNC.finditer(raw, lo, min(len(raw), at + 2)) if m.end() <= at), default=0 if lo == 0 else -1)
            hi = min(len(raw), start + reach)
            m = SYNC.search(raw, max(at, start) - 1, hi)
            right = m.end() if m else len(raw) if hi == len(raw) else -1
            if left >= 0 and right >= 0:
                k = int(np.searchsorted(ends, right))
                ok_right = right >= end or right == start or k < len(ends) and ends[k] == right
                if boundary(left) and ok_right:
                    break
            if lo == 0 and hi == len(raw):
                left, right = 0, len(raw)
                break
            reach *= 2
        while done and done[-1][1][-1] > left:
            i, e = done.pop()
            if k := int(np.searchsorted(e, left, "right")):
                done.append((i[:k], e[:k]))
        add(left, codec.encode(raw[left:right].decode()))
        if right < end:
            k = int(np.searchsorted(ends, right, "right"))
            add(right, ids[k:])
        at = max(end, right)
    return np.concatenate([i for i, _ in done]) if done else np.zeros(0, np.uint32)


def _digests(codec: bpe.Codec, ids: np.ndarray) -> tuple[int, str, str]:
    text = ",".join(map(codec.decimal.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def shared_hashes(docs: DataFrame) -> DataFrame:
    """h: the 64-bit hashes of the chunks that occur more than once."""

    def hashes(batches):
        for batch in batches:
            h = []
            for text in batch.column(0).to_pylist():
                raw, last = (text or "").encode(), 0
                for e in chunk_ends(raw):
                    h.append(xxhash.xxh3_64_intdigest(raw[last:e]))
                    last = e
            h, n = np.unique(np.array(h, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return only(docs, ("text", "string")).mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def encode(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each document: counts and digests; with_ids: also the ids."""
    spark, path = docs.sparkSession, tokenizer or bpe.default_path()
    keep, docs = Scratch(spark), only(docs, ("doc_id", "long"), ("text", "string"))
    twice = keep.write(shared_hashes(docs), "shared")
    shared = sketch.build(twice)
    keep.drop(twice)

    def result(rows: list[tuple], ids: list) -> dict:
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
        names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_reused")
        return {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)} | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {})

    def split(batches):
        """kind 0: a result; 1: a text that awaits its shared chunks; 2: an occurrence of a shared chunk."""
        codec, z = bpe.codec(path), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows, ids_out, other = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                ends = chunk_ends(raw)
                starts = [0, *ends[:-1]]
                found = np.flatnonzero(sketch.hits(shared.value, np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts, ends)], np.uint64))).tolist()
                if not found:
                    ids = codec.encode(text or "")
                    rows.append((d, *_digests(codec, ids), len(ends), 0))
                    ids_out.append(ids.astype(np.int32))
                    continue
                uid = uuid.uuid4().bytes
                other.append((1, uid, d, None, None, z.compress(raw), ends))
                other += [(2, uid, d, i, xxhash.xxh3_128_digest(raw[starts[i] : ends[i]]), raw[starts[i] : ends[i]], None) for i in found]
            n, m = len(rows), len(other)
            out = {k: pa.concat_arrays([v, pa.nulls(m, v.type)]) for k, v in result(rows, ids_out).items()}
            cols = list(zip(*other)) or [()] * 7
            out["doc_id"] = pa.concat_arrays([out["doc_id"][:n], pa.array(cols[2], pa.int64())])
            for k, c, kind, none in (("kind", 0, pa.int32(), 0), ("uid", 1, pa.binary(), None), ("pos", 3, pa.int32(), None), ("h", 4, pa.binary(), None), ("payload", 5, pa.binary(), None), ("ends", 6, pa.list_(pa.int32()), None)):
                out[k] = pa.concat_arrays([pa.array([none] * n, kind), pa.array(cols[c], kind)])
            yield pa.RecordBatch.from_pydict(out)

    done = RESULT + ", ids array<int>" * with_ids
    parts = keep.write(docs.mapInArrow(split, f"{done}, kind int, uid binary, pos int, h binary, payload binary, ends array<int>"), "parts")

    def encode_chunks(batches):
        codec = bpe.codec(path)
        for batch in batches:
            ids = [codec.encode(c.decode()).astype("<u2" if len(codec.width) <= 65536 else "<u4").tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": batch.column(0), "ids": pa.array(ids, pa.binary())})

    chunks = parts.filter("kind = 2")
    # written, so that both sides of the join are plain tables: Spark then splits the rows of a passage that many texts share
    encoded = keep.write(chunks.select("h", "payload").dropDuplicates(["h"]).mapInArrow(encode_chunks, "h binary, chunk_ids binary"), "encoded")
    given = chunks.select("uid", "pos", "h").join(encoded, "h").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk_ids"))).alias("given"))

    def finish(batches):
        codec, z = bpe.codec(path), zstandard.ZstdDecompressor()
        kind = "<u2" if len(codec.width) <= 65536 else "<u4"
        for batch in batches:
            rows, ids_out = [], []
            for d, payload, ends, given_ in zip(*(c.to_pylist() for c in batch.columns)):
                raw, pieces, open_ = z.decompress(payload), [], None
                known = {g["pos"]: np.frombuffer(g["chunk_ids"], kind).astype(np.uint32) for g in given_ or ()}
                for i, (s, e) in enumerate(zip([0, *ends[:-1]], ends)):
                    if i in known:
                        if open_ is not None:
                            pieces.append((open_, s, codec.encode(raw[open_:s].decode())))
                            open_ = None
                        pieces.append((s, e, known[i]))
                    elif open_ is None:
                        open_ = s
                if open_ is not None:
                    pieces.append((open_, len(raw), codec.encode(raw[open_:].decode())))
                ids = put_together(codec, raw, pieces)
                rows.append((d, *_digests(codec, ids), len(ends), len(known)))
                ids_out.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_pydict(result(rows, ids_out))

    rest = parts.filter("kind = 1").select("uid", "doc_id", "payload", "ends").join(given, "uid", "left").select("doc_id", "payload", "ends", "given").mapInArrow(finish, done)
    return parts.filter("kind = 0").select(rest.columns).unionByName(rest)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; special tokens keep their strings."""
    path = tokenizer or bpe.default_path()

    def run(batches):
        codec = bpe.codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([codec.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()], pa.string())})

    return only(encoded, ("doc_id", "long"), ("ids", "array<int>")).mapInArrow(run, "doc_id long, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
