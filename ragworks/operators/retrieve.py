"""Retrieval for a whole table of queries at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragworks.functions.text import clean_control, first_filled, snippet
from ragworks.operators.bm25 import bm25_candidates
from ragworks.sources.io import written

TOP_K = 10
POLICY_TOP_K = 15
RRF_K = 60
MAX_CHUNKS = 8
SEPARATOR = "\n\n---\n\n"
#: Components of the queries, and of the vectors, of one tile: 16 MB each as numbers.
TILE_VALUES = 2_000_000
#: Scores that a task holds at once, about 32 MB, and vectors that it takes in one step.
SCORE_VALUES = 4_000_000
STEP = 512
#: Vectors for which it is worth starting one more task.
SPREAD_ROWS = 2_000
#: Manuals that a filter may name.
LISTED_MANUALS = 10_000

NOTHING_INDEXED = "No contract content has been indexed yet. Run `ingest('contract.pdf')` first."
NOTHING_FOUND = "I could not find relevant policy content yet. Please confirm your manuals are indexed and in active status, then try again."


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, key: str = "chunk_key", tile_values: int = TILE_VALUES, score_values: int = SCORE_VALUES) -> DataFrame:
    """Exact cosine top k: queries(query_id, embedding) x vectors(key, embedding) -> (query_id, key, score, rank).

    Where queries have manual_ids, each searches among vectors(manual_id) of
    these alone; an empty or null list searches all. Likewise chunk_types and
    vectors(chunk_type): a null type searches all. Queries go by a route for
    each manual they list, and only vectors of a route that a query takes are
    moved; where vectors lie partitioned by manual, files of others are not
    read. On a route both sides are dealt to a grid of tiles of tile_values
    components each, so a large route has many tiles, and each query sends k
    rows a tile on. Null vectors take no part. Scores are rounded to 9 digits;
    ties go to the smaller key.
    """
    asked, routed = _routes(queries.where("embedding IS NOT NULL"), vectors.where("embedding IS NOT NULL"), key)
    width = routed.agg(F.max(F.size("embedding"))).first()[0] or 1
    size, cores = max(1, tile_values // width), vectors.sparkSession.sparkContext.defaultParallelism
    plan = asked.groupBy("route").agg(F.count(F.lit(1)).alias("m")).join(routed.groupBy("route").agg(F.count(F.lit(1)).alias("n")), "route")
    plan = plan.withColumn("across", F.ceil(F.col("m") / size)).withColumn("spread", F.least(F.ceil(cores / F.col("across")), F.ceil(F.col("n") / SPREAD_ROWS)))
    plan = written(plan.select("route", F.col("across").cast("int").alias("across"), F.greatest(F.ceil(F.col("n") / size), "spread").cast("int").alias("down")), "plan")
    deal = lambda rows, own, by, other, count: rows.join(plan, "route").withColumn(own, F.pmod(F.xxhash64(by), F.col(count)).cast("int"))
    left = deal(asked, "a", "query_id", "d", "across").select("route", "a", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("d"), F.col("query_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("kind").alias("kind"))
    right = deal(routed, "d", key, "a", "down").select("route", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("a"), "d", F.col(key).alias(key), F.col("embedding").alias("vector"), F.col("kind").alias("kind"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    found = left.groupBy("route", "a", "d").cogroup(right.groupBy("route", "a", "d")).applyInPandas(_tile(k, key, score_values), schema)
    return _ranked(found, k, F.desc("score"), F.asc(key))


def _routes(queries: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, embedding, kind, route) and vectors(key, embedding, kind, route): a row for each manual that a query lists, or the route of all."""
    kind = lambda rows, name: (F.col(name) if name in rows.columns else F.lit(None)).cast("string").alias("kind")
    every = F.lit("*").alias("route")
    whole = vectors.select(key, "embedding", kind(vectors, "chunk_type"), every)
    if "manual_ids" not in queries.columns:
        return queries.select("query_id", "embedding", kind(queries, "chunk_types"), every), whole
    open_ = F.coalesce(F.size("manual_ids") <= 0, F.lit(True))
    asked = queries.select("query_id", "embedding", kind(queries, "chunk_types"), F.explode(F.when(open_, F.array(F.lit("*"))).otherwise(F.transform(F.array_distinct("manual_ids"), lambda m: F.concat(F.lit("="), m.cast("string"))))).alias("route"))
    asked = written(asked.where("route IS NOT NULL"), "asked")
    routes = asked.select("route").distinct()
    own = vectors.where("manual_id IS NOT NULL").select(key, "embedding", kind(vectors, "chunk_type"), F.concat(F.lit("="), F.col("manual_id").cast("string")).alias("route"), "manual_id")
    few = [r[0] for r in routes.limit(LISTED_MANUALS + 1).collect()]
    if len(few) <= LISTED_MANUALS:  # named in the filter, so that only their files are read
        own = own.where(F.col("manual_id").isin(sorted(x[1:] for x in few if x != "*"))) if few != ["*"] else own.where("false")
    own = own.join(routes, "route", "left_semi").drop("manual_id")
    return asked, own.select(*whole.columns).unionByName(whole.join(routes, "route", "left_semi")) if "*" in few or len(few) > LISTED_MANUALS else own.select(*whole.columns)


def _tile(k: int, key: str, score_values: int):
    def tile(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values(key, kind="stable")  # so that of equal scores the first one wins
        keys, ids = vectors[key].to_numpy(), queries["query_id"].to_numpy()
        kinds = None
        if queries["kind"].notna().any():
            kinds = np.unique(np.concatenate([queries["kind"].fillna("").to_numpy(str), vectors["kind"].fillna("").to_numpy(str)]), return_inverse=True)[1]
        place, score = best_places(_unit(queries["vector"]), _unit(vectors["vector"]), k, score_values, None if kinds is None else (np.where(queries["kind"].isna(), -1, kinds[: len(ids)]), kinds[len(ids) :]))
        q, at = np.nonzero(place >= 0)
        return pd.DataFrame({"query_id": ids[q], key: keys[place[q, at]], "score": score[q, at]})

    return tile


def best_places(queries: np.ndarray, vectors: np.ndarray, k: int, score_values: int = SCORE_VALUES, kinds: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores), k a query: its best vectors, first ones first among equals; -1 where there are fewer.

    The k best so far are two arrays; of a step of vectors only queries with a
    score above their last one are touched.
    """
    place, score = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf)
    rows = max(1, min(len(queries), score_values // STEP))
    step = max(k, STEP)
    for i in range(0, len(queries), rows):
        mine_place, mine_score = place[i : i + rows], score[i : i + rows]
        for at in range(0, len(vectors), step):
            made = np.round(queries[i : i + rows] @ vectors[at : at + step].T, 9)
            if kinds is not None:
                asked, held = kinds[0][i : i + rows, None], kinds[1][None, at : at + step]
                made[(asked >= 0) & (asked != held)] = -np.inf
            touched = np.nonzero(made.max(1) > mine_score[:, -1])[0]
            if not len(touched):
                continue
            own = made[touched]
            both = np.concatenate([mine_score[touched], own], axis=1)
            places = np.concatenate([mine_place[touched], np.broadcast_to(np.arange(at, at + own.shape[1]), own.shape)], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            mine_score[touched], mine_place[touched] = np.take_along_axis(both, order, 1), np.take_along_axis(places, order, 1)
    place[score == -np.inf] = -1
    return place, score


def write_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """vectors(key, embedding, manual_id) under a folder for each manual, read again; a search by manuals opens only theirs."""
    vectors.hint("rebalance", "manual_id").write.partitionBy("manual_id").parquet(path)
    return vectors.sparkSession.read.schema(vectors.schema).parquet(path)


def _unit(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def filter_chunk_type(vectors: DataFrame, chunk_type: str | None) -> DataFrame:
    return vectors if chunk_type is None else vectors.where(F.col("chunk_type") == chunk_type)


def filter_manuals(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits(query_id, manual_id, ...) of manuals that queries(query_id, manual_ids) lists; an empty or null list allows all."""
    allowed = queries.select("query_id", "manual_ids")
    open_ = F.coalesce(F.size("manual_ids") <= 0, F.lit(True))
    return hits.join(allowed, "query_id").where(open_ | F.array_contains("manual_ids", F.col("manual_id"))).drop("manual_ids")


def bm25_topk(queries: DataFrame, index: dict[str, DataFrame], k: int = TOP_K, key: str = "chunk_key", pad: bool = True, owners: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): best first, ties by key. With pad, chunks of score 0 fill the list up to k.

    index is a written one (term_index.read_index); postings that cannot reach
    a query's k best are not read. owners(key, manual_id) with
    queries(manual_ids): only chunks of the manuals that a query lists are
    ranked, and nothing is padded. Padding looks at the first k + n keys alone,
    where n is the number of a query's chunks with another score than 0 (below
    k, as idf is positive but in corpora where most terms stand in most chunks).
    """
    pad = pad and owners is None
    found = bm25_candidates(queries, index, k, key, owners=owners, pad=pad)
    if not pad:
        return _ranked(found, k, F.desc("score"), F.asc(key))
    found = written(found, "scores").where("score <> 0")
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("high"))
    none = F.lit(0)
    short = queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", none).alias("n"), F.coalesce("high", none).alias("high"))
    short = short.where(F.col("high") < k)
    best = _ranked(found, k, F.desc("score"), F.asc(key)).drop("rank")
    most = short.agg(F.max("n")).first()[0]
    if most is None:
        return _ranked(best, k, F.desc("score"), F.asc(key))
    first = index["doc_stats"].select(key).orderBy(key).limit(k + most)
    first = first.withColumn("place", F.row_number().over(Window.orderBy(key)))  # so many rows in one task
    fill = short.select("query_id", F.explode(F.sequence(F.lit(1), (F.lit(k) + F.col("n")).cast("int"))).alias("place")).join(F.broadcast(first), "place")
    fill = fill.select("query_id", key).join(found, ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
    return _ranked(best.unionByName(fill), k, F.desc("score"), F.asc(key))


def rrf_merge(dense: DataFrame, sparse: DataFrame, key: str = "chunk_key", k: int = RRF_K) -> DataFrame:
    """(query_id, key, rrf_score, dense_rank, sparse_rank, rank) of two ranked lists; ties: dense order, then sparse order."""
    a = dense.select("query_id", key, F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", key, F.col("rank").alias("sparse_rank"))
    both = a.join(b, ["query_id", key], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(part("dense_rank") + part("sparse_rank"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return both.withColumn("rank", F.row_number().over(order))


def hybrid_retrieve(queries: DataFrame, vectors: DataFrame, index: dict[str, DataFrame], chunks: DataFrame, k: int = TOP_K, key: str = "chunk_key", chunk_type: str | None = None, pad: bool = True) -> DataFrame:
    """Dense and sparse top k fused, with text and metadata of chunks joined back: up to 2k rows a query.

    queries(query_id, query, embedding[, chunk_types]). A type limits the dense
    side alone: chunk_type for all queries, the column chunk_types for each
    (null: all), by vectors(chunk_type). A chunk without a vector has no dense
    rank. index should be a written one (term_index), as it is read several times.
    """
    dense = dense_topk(queries.drop("manual_ids"), filter_chunk_type(vectors, chunk_type), k, key)
    return rrf_merge(dense, bm25_topk(queries.drop("manual_ids"), index, k, key, pad), key).join(chunks, key)


def policy_retrieve(queries: DataFrame, vectors: DataFrame, index: dict[str, DataFrame], chunks: DataFrame, k: int = POLICY_TOP_K, key: str = "chunk_key") -> DataFrame:
    """The k best of dense and sparse search fused, each among the manuals that its query lists.

    queries(query_id, query, embedding, manual_ids: empty or null for all),
    vectors(key, embedding, manual_id), chunks(key, manual_id, ...): both sides
    are filtered before they are ranked, so a query gets k rows where its
    manuals have so many.
    """
    sparse = bm25_topk(queries, index, k, key, owners=chunks)
    return rrf_merge(dense_topk(queries, vectors, k, key), sparse, key).where(F.col("rank") <= k).join(chunks, key)


def build_context(hits: DataFrame, max_chunks: int = MAX_CHUNKS, key: str = "chunk_id") -> DataFrame:
    """(query_id, context): the first hits by rank, each under a source line. hits(query_id, rank, chunk_type, section_number, section, page_content, key)."""
    section = F.coalesce(first_filled(F.col("section_number"), F.col("section")), F.lit("?"))
    head = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(" | type="), F.coalesce("chunk_type", F.lit("?")), F.lit(" | section="), section,
        F.lit(" | id="), F.col(key).cast("string"), F.lit("]\n"), F.coalesce("page_content", F.lit("")),
    )
    return _joined(hits.where(F.col("rank") <= max_chunks).select("query_id", "rank", head.alias("part")))


def _joined(parts: DataFrame) -> DataFrame:
    rows = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    return rows.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), SEPARATOR).alias("context"))


def build_policy_context(hits: DataFrame) -> DataFrame:
    """(query_id, context) of all hits by rank. hits(query_id, rank, policy_name, insurer, page_number, page_content)."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    head = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(" | "), known("policy_name"), F.lit(" | "), known("insurer"), F.lit(" | Page "), known("page_number"),
        F.lit("]\n"), clean_control(F.coalesce("page_content", F.lit(""))),
    )
    return _joined(hits.select("query_id", "rank", head.alias("part")))


def source_list(hits: DataFrame, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Citation rows of the first hits: chunk, type, section, 300 characters and the leading features."""
    section = F.coalesce(first_filled(F.col("section_number"), F.col("section")), F.lit("?"))
    feats = [F.col(c) if c in hits.columns else F.lit(None).cast("string").alias(c) for c in ("feat_obligation", "feat_risk_level", "feat_content_type", "feat_summary")]
    return hits.where(F.col("rank") <= max_chunks).select(
        "query_id", "rank", "chunk_id", F.coalesce("chunk_type", F.lit("?")).alias("chunk_type"), section.alias("section"), snippet(F.col("page_content"), 300).alias("snippet"), *feats
    )


def policy_source_list(hits: DataFrame) -> DataFrame:
    """Citation rows of all hits, with 400 characters of the cleaned text."""
    text = clean_control(F.coalesce("page_content", F.lit("")))
    return hits.select("query_id", "rank", "manual_id", "page_number", "policy_name", "insurer", "category", "filename", snippet(text, 400).alias("snippet"))


def answer_requests(queries: DataFrame, contexts: DataFrame, system_prompt: str, nothing: str = NOTHING_INDEXED) -> DataFrame:
    """(query_id, system, user, answer): a request with its context, or the fixed answer where there is none.

    system_prompt holds {context} once.
    """
    before, _, after = system_prompt.partition("{context}")
    rows = queries.join(contexts, "query_id", "left")
    found = F.col("context").isNotNull()
    return rows.select(
        "query_id",
        F.when(found, F.concat(F.lit(before), F.col("context"), F.lit(after))).alias("system"),
        F.when(found, F.col("query")).alias("user"),
        F.when(~found, F.lit(nothing)).alias("answer"),
    )


def rerank(candidates: DataFrame, limit: int, scorer: Callable[[list[str], list[str]], list[float]] | None = None, key: str = "chunk_key") -> DataFrame:
    """Rescore the first `limit` candidates of each query: (query_id, key, score, rank).

    scorer(queries, texts) gives a score a pair (columns query, page_content);
    without it the column rerank_score counts. A missing score is 1 - 0.001 for
    each place (from 0) in the first stage. Ties keep the first stage's order.
    """
    rows = candidates.where(F.col("rank") <= limit)
    if scorer is not None:

        @F.pandas_udf("double")
        def scores(query: pd.Series, text: pd.Series) -> pd.Series:
            return pd.Series(scorer(query.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

        rows = rows.withColumn("rerank_score", scores("query", "page_content"))
    score = F.coalesce(F.nanvl(F.col("rerank_score").cast("double"), F.lit(None)), F.lit(1.0) - F.lit(0.001) * (F.col("rank") - 1))
    rows = rows.select("query_id", key, F.round(score, 9).alias("score"), F.col("rank").alias("first_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank")
    return rows.withColumn("rank", F.row_number().over(order)).drop("first_rank")
