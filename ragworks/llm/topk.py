"""Exact top-k search by inner product: columnar branch-and-bound.

Queries and candidates are dealt to a grid of tiles. In a tile the candidates
lie in vertical layout, one array a dimension, and are taken in chunks. For a
query the scores are accumulated over one block of dimensions after the other;
what the rest can still add is at most the product of the remaining masses
(lengths over the dimensions to come) of query and candidate. Candidates whose
upper bound is below the k-th best score so far, or below the k-th best lower
bound, are dropped, and the survivors are compacted. Scores are sums of whole
numbers and exact; the bounds are rounded outwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 10
SCALE = 1024
#: Dimensions that are accumulated before the candidates are compacted.
BLOCK_DIMENSIONS = 8
#: Candidates that are searched together.
CHUNK = 4_096
#: Components of the queries, and of the candidates, of one tile: 16 MB each as numbers.
TILE_VALUES = 2_000_000
#: Scores within which floating-point sums of whole numbers are exact, and within which they fit a long.
EXACT, LONG = 2.0**53, 2.0**63
#: Scores beyond this count as this.
MOST = 2**63 - 1


def whole_numbers(vectors: pd.Series, scale: int = SCALE) -> np.ndarray:
    """A row a vector, floor(scale * x) of each component; shorter vectors end in zeros. Objects where numbers beyond 2**31 occur."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    out = np.floor(out * scale)
    if not out.size or np.abs(out).max() < 2.0**31:
        return out
    return np.array([[int(x) for x in row] for row in out.tolist()], dtype=object)


def _masses(v: np.ndarray, block: int) -> np.ndarray:
    """(blocks + 1) x vectors: length of each vector over the dimensions from each block on, a little rounded up."""
    squares = v.astype(np.float64) ** 2
    starts = list(range(0, v.shape[1], block))
    rest = [np.sqrt(squares[:, s:].sum(1)) * (1 + 1e-9) for s in starts]
    return np.stack([*rest, np.zeros(len(v))])


class Best:
    """The k best candidates of each query so far: scores, and places in a tile ordered by id."""

    def __init__(self, queries: int, k: int, kind: np.dtype):
        self.k = k
        self.score = [np.zeros(0, kind) for _ in range(queries)]
        self.place = [np.zeros(0, np.int64) for _ in range(queries)]

    def floor(self, q: int) -> float:
        return float(self.score[q][-1]) if len(self.score[q]) == self.k else -np.inf

    def add(self, q: int, score: np.ndarray, place: np.ndarray) -> None:
        score, place = np.concatenate([self.score[q], score]), np.concatenate([self.place[q], place])
        order = np.array(sorted(range(len(score)), key=lambda i: (-score[i], place[i])), np.int64) if score.dtype == object else np.lexsort((place, -score))
        order = order[: self.k]
        self.score[q], self.place[q] = score[order], place[order]


def search(queries: np.ndarray, candidates: np.ndarray, skip: list[np.ndarray], k: int = TOP_K, block: int = BLOCK_DIMENSIONS, chunk: int = CHUNK) -> Best:
    """The k best candidates of each query, ties to the smaller place; skip: the places that a query leaves out."""
    width = max(queries.shape[1], candidates.shape[1])
    queries, candidates = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (queries, candidates))
    if queries.dtype == object or candidates.dtype == object:
        queries, candidates = queries.astype(object), candidates.astype(object)
    most = [float(np.abs(v).max()) if v.size else 0.0 for v in (queries, candidates)]
    if queries.dtype != object and most[0] * most[1] * width >= EXACT:
        kind = object if most[0] * most[1] * width >= LONG else np.int64
        queries, candidates = ([[int(x) for x in r] for r in v.tolist()] for v in (queries, candidates))
        queries, candidates = np.array(queries, dtype=kind), np.array(candidates, dtype=kind)
    best = Best(len(queries), k, queries.dtype)
    if queries.dtype == object:  # beyond a long there are no bounds: every score is made, with whole numbers of any size
        places = np.arange(len(candidates))
        for q in range(len(queries)):
            stay = ~np.isin(places, skip[q])
            scores = [sum(a * b for a, b in zip(queries[q], c)) for c in candidates[stay]]
            best.add(q, np.array([max(-MOST, min(MOST, s)) for s in scores], dtype=object), places[stay])
        return best
    rest = _masses(queries, block)
    starts = list(range(0, width, block))
    for at in range(0, len(candidates), chunk):
        part = candidates[at : at + chunk]
        columns, mass = np.ascontiguousarray(part.T), _masses(part, block)
        # the first block of all queries at once, later ones on what survives
        first = queries[:, :block] @ columns[:block]
        for q in range(len(queries)):
            alive, score = np.arange(part.shape[0]), first[q]
            if len(skip[q]):
                stay = ~np.isin(alive, skip[q] - at)
                alive, score = alive[stay], score[stay]
            for b in range(1, len(starts) + 1):
                if len(alive) > 0:
                    slack = rest[b][q] * mass[b][alive] + (0.5 if b < len(starts) else 0.0)
                    floor = best.floor(q)
                    if len(alive) > k:
                        lower = score.astype(np.float64) - slack
                        floor = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k] * (1 - 1e-12) - 0.5)
                    stay = score.astype(np.float64) + slack + 0.5 >= floor
                    alive, score = alive[stay], score[stay]
                if b < len(starts) and len(alive):
                    s = starts[b]
                    score = score + queries[q, s : s + block] @ columns[s : s + block][:, alive]
            if len(alive):
                best.add(q, score, at + alive)
    return best


def _tile(k: int, scale: int):
    def tile(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        # null ids last, so that places are in the order of ties
        candidates = candidates.iloc[np.lexsort((candidates["id"].to_numpy(), ~candidates["known"].to_numpy()))]
        ids, known, own = candidates["id"].to_numpy(), candidates["known"].to_numpy(), queries["id"].to_numpy()
        named = ids[: known.sum()]
        low, high = np.searchsorted(named, own, "left"), np.searchsorted(named, own, "right")
        best = search(whole_numbers(queries["v"], scale), whole_numbers(candidates["v"], scale), [np.arange(a, b) for a, b in zip(low, high)], k)
        rows = [(i, ids[p] if known[p] else None, int(s)) for i, ss, ps in zip(own.tolist(), best.score, best.place) for s, p in zip(ss.tolist(), ps.tolist())]
        return pd.DataFrame({c: pd.Series([r[n] for r in rows], dtype="Int64") for n, c in enumerate(("query_id", "vec_id", "score"))})

    return tile


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that are not null and hold neither nulls nor NaN nor infinite numbers."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = TOP_K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, tile_values: int = TILE_VALUES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of each query with the largest inner products of floor(scale * x).

    queries(key, vector), candidates(key, vector); ties go to the smaller key,
    null keys last. A query leaves out the candidates of its own key; rows
    without a key are no queries. Vectors that are null or hold null or
    non-finite components take no part; where lengths differ, the shorter
    vector ends in zeros. Candidates that repeat are rows of their own, of
    queries that repeat a key one (the smallest vector) counts. Scores beyond
    a long count as the nearest long. With empty tables the result is empty.

    Rows are dealt by a hash of their place in the input, so a vector or key
    that a third of the rows share is spread over all tiles. A tile holds
    tile_values components of each side at most; each query sends k rows a
    tile on.
    """
    spark = candidates.sparkSession
    asked = usable(queries, key, vector).where("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    rows = usable(candidates, key, vector)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    m, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = max(1, tile_values // max(1, width or 1, wide or 1))
    across = max(1, -(-m // size))
    # at least a tile a core, where there are candidates for so many
    down = max(1, -(-n // size), min(-(-spark.sparkContext.defaultParallelism // across), -(-n // CHUNK)))
    place = lambda blocks: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    asked = asked.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int"))
    left = asked.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda x: F.col("at") * down + x)).alias("tile"), "id", "v")
    row = F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "v"
    right = rows.withColumn("at", place(down)).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda x: x * down + F.col("at"))).alias("tile"), *row)
    found = left.groupBy("tile").cogroup(right.groupBy("tile")).applyInPandas(_tile(k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
