"""Operator 7: approximate nearest neighbours by a hash-prefix forest.

Every vector has a string of HASH_BITS random-hyperplane bits in each of TREES trees; a tree is the array of
its strings in sorted order, kept in pages by leading bits (large pages, as copies of one vector make, are
split into blocks). A query descends in every tree to its longest match: the sorted array of its own page tells,
for each prefix length from that match up, how many rows share so much with it, and the pages' sizes tell it
for prefixes shorter than a page's. From the longest prefix it ascends bit by bit, synchronously in
all trees, until the rows found number at least `target`. The rows of those prefixes, a contiguous range of
each sorted array, are compared exactly and the best k are returned. The descent moves strings only; vectors
travel to the pages that some query has reached.

Inner product: vectors get one more component, sqrt(M^2 - |x|^2) with M the longest norm (0 for queries),
so that the nearest by angle are those with the largest product.

`target` is calibrated: the exact neighbours of SAMPLE queries (a bounded sample, compared with every row
in blocks) show which target finds at least AIM of them. Random directions, as in the test tables, need a
large share of the rows; vectors with structure need few. Every row is indexed, nothing is capped. As a row
counts once for each tree, a target is never below TREES * (k + 1): some tree then has k rows besides the
query's own, and a query that does not reach that ascends to the root.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without vec_id or of another length than most rows; rows that repeat a vec_id count once (the
smallest vector); ties go to the smaller vec_id; fewer than k candidates give all of them;
products too large for a double are infinite, and tie; an empty table
or one without queries gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, only, table

TREES, HASH_BITS, SEED = 8, 64, 20
PAGE_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 8192, 16384, 4096
SAMPLE, AIM = 64, 0.97
OUT = "query_id long, vec_id long, score double"


def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims + 1, TREES * HASH_BITS))


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): the rows that take part, one for each vec_id."""
    rows = only(df, ("vec_id", "long"), ("embedding", "array<double>")).filter("vec_id is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (most["n"] if most else 0)).groupBy("vec_id").agg(F.min("embedding").alias("v"))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def hashed(rows: DataFrame, peak: float, longest: float, as_query: bool) -> DataFrame:
    """vec_id, v, hashes (array of a long for each tree, its bits those of the string). peak: the largest component there is, by which vectors are divided
    (queries by their own), so that no square overflows; longest: the longest norm then."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["v"])
            x = x / (np.abs(x).max(1, keepdims=True) if as_query else peak)
            norm2 = (x * x).sum(1)
            last = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0, longest * longest - norm2))
            bits = (np.column_stack([x, last]) @ _planes(x.shape[1]) > 0).reshape(len(x), TREES, HASH_BITS)
            h = np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64).view(np.int64)
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "hashes": list(h)})

    return rows.mapInPandas(run, "vec_id long, v array<double>, hashes array<long>")


def _products(q, x, a, b) -> np.ndarray:
    """The inner products of pairs of rows, each summed in the same order wherever it stands."""
    step = max(1, (1 << 22) // max(1, x.shape[1]))
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[a[i : i + step]], x[b[i : i + step]]) for i in range(0, len(a), step)]])


def _best(q_ids, q, ids, x, k: int):
    """The k best rows for each query, without its own: (query, row, score). A matrix product, whose last bits depend on a
    row's place, only chooses what can be among them; scores and ties are decided by `_products`. A query of which a product
    is too large for a double chooses nothing beforehand; a score that is no number counts as the least."""
    own = q_ids[:, None] == ids[None, :]
    with np.errstate(all="ignore"):
        score = q @ x.T
        wild = ~np.isfinite(score).all(1)
        score[own] = -np.inf
        if len(ids) > k:
            edge = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            edge = np.full(len(q_ids), -np.inf)
        doubt = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max(initial=0)) * x.shape[1]
        some = (score >= (edge - doubt)[:, None]) | (wild | ~np.isfinite(doubt))[:, None]
        a, b = np.nonzero(some & ~own)
        s = _products(q, x, a, b)
    s = np.where(np.isnan(s), -np.inf, s)
    order = np.lexsort((ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    ok = np.arange(len(a)) - np.searchsorted(a, a) < k
    return q_ids[a[ok]], ids[b[ok]], s[ok]


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The exact answer for a bounded list of queries, each task comparing them with its own rows."""
    q_ids, q = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)

    def run(frames):
        for f in frames:
            if len(f) and len(q_ids):
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), _best(q_ids, q, f["vec_id"].to_numpy(np.int64), _matrix(f["v"]), k))))

    return _top(rows.mapInPandas(run, OUT), k)


def _by_tree(h: DataFrame, *cols: str) -> DataFrame:
    return h.select(*cols, F.posexplode("hashes").alias("tree", "hash"))


def _range(h: np.ndarray, q: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share `level` bits with each of q begin and end in the sorted h."""
    if level == 0:
        return np.zeros(len(q), np.int64), np.full(len(q), len(h), np.int64)
    cut = np.uint64(HASH_BITS - level)
    low = q >> cut << cut
    return np.searchsorted(h, low), np.searchsorted(h, low | ((np.uint64(1) << cut) - np.uint64(1)), "right")


def shared_counts(h: np.ndarray, q: np.ndarray, above: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, level, n > 0): how many strings of the sorted h share `level` bits with each of q, from its longest match
    up to, but without, the prefixes of `above` bits. The longest match is next to the query's own place."""
    at, level, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = np.arange(len(q))
    for x in range(above + 1, HASH_BITS + 1):
        s, e = _range(h, q[live], x)
        live, found = live[e > s], (e - s)[e > s]
        if not len(live):
            break
        at.append(live)
        level.append(np.full(len(live), x))
        n.append(found)
    return np.concatenate(at), np.concatenate(level), np.concatenate(n)


def _page(hash_: str, page_bits: int) -> str:
    return f"shiftrightunsigned({hash_}, {HASH_BITS - page_bits})" if page_bits else "0L"


def descend(index: DataFrame, queries: DataFrame, pages: DataFrame, page_bits: int) -> DataFrame:
    """vec_id (of a query), level, total: rows in all trees that share so many bits with it, for the levels where there are any.
    pages: tree, page, n."""
    page = F.expr(_page("hash", page_bits))
    node = lambda df: df.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(page_bits)))).withColumn("node", F.expr(f"shiftright(page, {page_bits} - level)"))
    q = _by_tree(queries, "vec_id").withColumn("page", page)
    load = q.groupBy("tree", "page").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("shares"))
    plan = pages.join(load, ["tree", "page"]).select("tree", "page", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), "shares")
    data, asked = _dealt(_by_tree(index, "vec_id").withColumn("page", page), q, plan)

    def run(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(d["hash"].to_numpy(np.int64).view(np.uint64))
        at, level, n = shared_counts(h, a["hash"].to_numpy(np.int64).view(np.uint64), page_bits)
        return pd.DataFrame({"vec_id": a["vec_id"].to_numpy(np.int64)[at], "level": level.astype(np.int32), "n": n})

    found = data.groupBy(*GROUP).cogroup(asked.groupBy(*GROUP)).applyInPandas(run, "vec_id long, level int, n long")
    if page_bits:
        nodes = node(pages).groupBy("tree", "level", "node").agg(F.sum("n").alias("n"))
        found = found.unionByName(node(q).join(nodes, ["tree", "level", "node"]).select("vec_id", "level", "n"))
    return found.groupBy("vec_id", "level").agg(F.sum("n").alias("total"))


GROUP = ("tree", "page", "block", "share")


def _dealt(data: DataFrame, q: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with block and share, so that every row of a page meets each of its queries in one group. plan: tree, page, blocks
    (among which a page's rows are dealt) and shares (its queries)."""
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = data.join(plan, ["tree", "page"]).withColumn("block", spread("blocks")).withColumn("share", every("shares"))
    q = q.join(plan, ["tree", "page"]).withColumn("share", spread("shares")).withColumn("block", every("blocks"))
    return data.drop("blocks", "shares"), q.drop("blocks", "shares")


def least_target(k: int) -> int:
    """Rows over all trees among which are k distinct ones besides the query's own."""
    return TREES * (k + 1)


def calibrate(rows: DataFrame, index: DataFrame, queries: DataFrame, totals_of: DataFrame, k: int) -> int:
    """The least target that finds AIM of the sample's exact neighbours (0 rows: 0; not to be had: all). totals_of: what
    `descend` has found of all queries."""
    sample = [(r["vec_id"], r["v"], r["hashes"]) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not sample:
        return 0
    exact = brute_force(rows, [(i, v) for i, v, _ in sample], k).join(index.select("vec_id", "hashes"), "vec_id").collect()  # SAMPLE x k rows
    own = {i: np.array(h) for i, _, h in sample}
    totals: dict[int, dict[int, int]] = {i: {} for i in own}
    for r in totals_of.filter(F.col("vec_id").isin(list(own))).collect():  # at most SAMPLE x HASH_BITS rows
        totals[r["vec_id"]][r["level"]] = r["total"]
    shared = [(r["query_id"], max(HASH_BITS - (int(x) & ((1 << HASH_BITS) - 1)).bit_length() for x in own[r["query_id"]] ^ np.array(r["hashes"]))) for r in exact]
    everything = 1 << 62
    for target in [int(least_target(k) * 1.15**i) for i in range(200)]:
        level = {i: max((x for x, n in t.items() if n >= target), default=0) for i, t in totals.items()}
        if shared and np.mean([n >= level[i] for i, n in shared]) >= AIM:
            found = target
        else:
            if shared and target < max((max(t.values()) for t in totals.values() if t), default=0) * 2:
                continue
            return everything
        return found
    return everything


def search(df: DataFrame, queries_of, k: int = 20, target: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, level, n_candidates (how far the query ascended, and how many rows it then had found in
    all trees). queries_of: the condition that makes a row a query as well."""
    keep = Scratch(df.sparkSession)
    rows = keep.write(vectors(df), "vectors")
    stats = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("peak")).first()
    peak = float(stats["peak"] or 1)
    longest = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / peak) * (x / peak)))).first()[0] or 0) ** 0.5
    index = keep.write(hashed(rows, peak, longest, False), "index")
    queries = keep.write(hashed(rows.filter(queries_of), peak, longest, True), "queries")
    page_bits = min(HASH_BITS, max(0, int(np.ceil(np.log2(max(1, stats["n"] / PAGE_ROWS))))))
    page = F.expr(_page("hash", page_bits))
    pages = keep.write(_by_tree(index).groupBy("tree", page.alias("page")).agg(F.count("*").alias("n")), "pages")
    totals = keep.write(descend(index, queries, pages, page_bits), "totals")
    if target is None:
        target = calibrate(rows, index, queries, totals, k)
    keep.drop(rows)
    target = max(target, least_target(k))
    # totals never grow with the level: the last level that has enough has the least of them
    reached = totals.filter(F.col("total") >= target).groupBy("vec_id").agg(F.max("level").alias("level"), F.min("total").alias("n_candidates"))
    asked = keep.write(queries.join(reached, "vec_id", "left").fillna({"level": 0, "n_candidates": stats["n"]}), "asked")
    keep.drop(queries, totals)

    # a query's pages: its own, or those below its prefix where that is shorter than a page's
    # a query that ascends to the root sees all rows in any tree: it looks in the first one only
    q = _by_tree(asked, "vec_id", "v", "level").filter("level > 0 or tree = 0").withColumn("page", page).withColumn("short", F.greatest(F.lit(0), F.lit(page_bits) - F.col("level")))
    first = F.expr("shiftleft(shiftright(page, short), short)")
    q = q.withColumn("page", F.explode(F.sequence(first, first + F.expr("shiftleft(1L, short)") - 1))).drop("short")
    load = q.groupBy("tree", "page").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("shares"))
    plan = keep.write(pages.join(load, ["tree", "page"]).select("tree", "page", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), "shares"), "plan")
    data, q = _dealt(_by_tree(index, "vec_id", "v").withColumn("page", page), q, plan)

    def compare(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(d) and len(a):
            h = d["hash"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(h, kind="stable")
            h, ids, x = h[order], d["vec_id"].to_numpy(np.int64)[order], _matrix(d["v"])[order]
            # queries of one prefix meet the same range of the sorted array
            for level, same in a.groupby("level"):
                s, e = _range(h, same["hash"].to_numpy(np.int64).view(np.uint64), int(level))
                for (low, high), part in same.assign(low=s, high=e).groupby(["low", "high"]):
                    for at in range(0, len(part) if high > low else 0, 64):
                        some = part.iloc[at : at + 64]
                        out.append(_best(some["vec_id"].to_numpy(np.int64), _matrix(some["v"]), ids[low:high], x[low:high], k))
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    best = _top(data.groupBy(*GROUP).cogroup(q.groupBy(*GROUP)).applyInPandas(compare, OUT), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return best.join(asked.select(F.col("vec_id").alias("query_id"), "level", "n_candidates"), "query_id")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
