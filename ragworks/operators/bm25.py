"""BM25 for a whole table of queries with upper bounds: what cannot reach a query's k best is not read.

Chunks are scored block by block: the postings of a block that a team of
queries looks for meet in one task, which adds them up as an array of queries
and chunks and hands on the k best of each query. So what is shuffled are
postings of sought terms, once a team, and k rows a query and block; no row is
made for a pair of query and posting.

Where there are very many such pairs, blocks are left out first. A posting
scores more the more often its term occurs and the shorter its chunk, so the
greatest tf and the smallest length of a block bound all of its scores. A
query's threshold is the k-th best score of a few chunks that its rarest terms
find. Its frequent terms whose bounds together stay below the threshold are
not essential: no chunk without an essential term can be among the k best.
Blocks are left out where the bounds of essential terms and of the rest do not
reach the threshold. Results are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragworks.operators.index import K1, B, tokens
from ragworks.operators.term_index import BLOCK, BLOCK_BITS, explode_blocks
from ragworks.sources.io import written

#: Postings a wanted chunk that give a query's threshold.
SEED_POSTINGS = 50
#: Pairs of query and posting up to which all are scored in one pass. To find out which to leave out reads the sought blocks
#: four times: 2.5 to 3.5 times the search at 38 and 197 million pairs, so it pays only where it leaves out nearly all.
DIRECT_PAIRS = 5_000_000_000
#: Scores that a task holds at once, about 32 MB.
SCORE_VALUES = 4_000_000
#: Pairs of query and term up to which they go to every task that reads blocks, some ten MB.
SENT_TERMS = 200_000
#: Scores are compared as rounded to six digits: bounds have so much room.
ROOM = 2e-6


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of queries(query_id, query)."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _impact(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))


def _allowed(rows: DataFrame, docs: DataFrame, key: str, queries: DataFrame, owners: DataFrame | None) -> DataFrame:
    """rows(query_id, seq, at, ...) of chunks that the index still has, and of the manuals that the query lists, with their keys."""
    out = rows.join(docs.select("seq", "at", key), ["seq", "at"])
    if owners is None:
        return out
    lists = queries.select("query_id", "manual_ids")
    open_ = F.coalesce(F.size("manual_ids") <= 0, F.lit(True))
    return out.join(owners.select(key, "manual_id"), key).join(lists, "query_id").where(open_ | F.array_contains("manual_ids", F.col("manual_id"))).drop("manual_id", "manual_ids")


def _weighted(queries: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """(query_id, term, df, weight) of the terms that the index knows, a table."""
    known = query_terms(queries).join(index["term_stats"], "term")
    return written(known.select("query_id", "term", "df", (F.col("times") * F.col("idf")).alias("weight")), "known")


def search_plan(queries: DataFrame, known: DataFrame, avgdl: float, index: dict[str, DataFrame], k: int, key: str, k1: float = K1, b: float = B, owners: DataFrame | None = None, seed_postings: int = SEED_POSTINGS) -> dict[str, DataFrame]:
    """Tables that say what has to be read: terms(query_id, term, weight, essential, rest, theta) and ranges(query_id, seq, block), of blocks.

    known(query_id, term, df, weight) is a table. theta is null where fewer than k chunks of a score above 0 were seen: then all is essential.
    rest is what the terms that are not essential add to a chunk at most.
    """
    sought = written(index["blocks"].join(_sent(known.select("term").distinct(), known), "term", "left_semi"), "sought")
    index = index | {"blocks": sought}
    bound = _impact(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b)
    met = sought.select("seq", "block", "term", "n", bound.alias("bound"))
    # of each term the postings in blocks of higher bound: a few of its best blocks can be taken
    before = Window.partitionBy("term").orderBy(F.desc("bound"), "seq", "block").rowsBetween(Window.unboundedPreceding, -1)
    met = written(met.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "met")

    few = seed_postings * k
    rarer = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = known.withColumn("seen", F.coalesce(F.sum("df").over(rarer), F.lit(0))).where(F.col("seen") < few)
    seeds = rare.join(met.where(F.col("before") < few).select("seq", "block", "term"), "term").select("query_id", "term", "weight", "seq", "block")
    parts = explode_blocks(index["blocks"].join(seeds, ["term", "seq", "block"]), "query_id", "weight")
    scored = _allowed(_summed(parts, avgdl, k1, b), index["docs"], key, queries, owners)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq", "at")
    scored = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * k).select("query_id", "seq", "at", "score")
    scored = written(scored, "seeds")
    # whatever the seeds scored by parts of a term's blocks, the other terms add to it: a bound from below
    common = known.join(rare.select("query_id", "term"), ["query_id", "term"], "left_anti")
    whole = _looked_up(scored, common, index, avgdl, k1, b)
    least = whole.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query_id", F.col("score").alias("theta"))

    most = met.groupBy("term").agg(F.max("bound").alias("bound"))
    terms = known.join(most, "term").join(least, "query_id", "left")
    # terms of negative weight take from a score, at most k1 + 1 times their weight, and add nothing
    loss = F.sum(F.least("weight", F.lit(0.0)) * (k1 + 1)).over(Window.partitionBy("query_id"))
    terms = terms.withColumn("theta", F.col("theta") + loss - ROOM).withColumn("theta", F.when(F.col("theta") > 0, F.col("theta"))).withColumn("most", F.greatest("weight", F.lit(0.0)) * F.col("bound"))
    upward = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = terms.withColumn("essential", F.coalesce(F.sum("most").over(upward) >= F.col("theta"), F.lit(True)))
    rest = F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(Window.partitionBy("query_id"))
    terms = written(terms.select("query_id", "term", "df", "weight", "essential", "theta", rest.alias("rest")), "terms")

    upper = F.sum(F.greatest("weight", F.lit(0.0)) * F.col("bound"))
    ranges = terms.where("essential").join(met, "term").groupBy("query_id", "seq", "block").agg(upper.alias("upper"), F.first("rest").alias("rest"), F.first("theta").alias("theta"))
    ranges = ranges.where(F.col("theta").isNull() | (F.col("upper") + F.col("rest") >= F.col("theta"))).select("query_id", "seq", "block")
    return {"terms": terms, "ranges": written(ranges, "ranges"), "met": met, "blocks": sought}


def _summed(parts: DataFrame, avgdl: float, k1: float, b: float, *more: Column) -> DataFrame:
    """parts(query_id, seq, at, weight, tf, dl) -> score of each query and chunk, combined on the map side."""
    part = F.col("weight") * _impact(F.col("tf"), F.col("dl"), avgdl, k1, b)
    return parts.groupBy("query_id", "seq", "at").agg(F.sum(part).alias("score"), *more)


def _looked_up(rows: DataFrame, terms: DataFrame, index: dict[str, DataFrame], avgdl: float, k1: float, b: float) -> DataFrame:
    """rows(query_id, seq, at, score), a table, with what terms(query_id, term, weight) add to these chunks; a query has BLOCK of them in one block at most."""
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    wanted = rows.groupBy("query_id", "seq", block).agg(F.collect_list(F.col("at").bitwiseAND(BLOCK - 1).cast("int")).alias("wanted"))
    others = terms.join(wanted, "query_id").select("query_id", "term", "weight", "seq", "block", "wanted")
    added = explode_blocks(index["blocks"].join(others, ["term", "seq", "block"]), "query_id", "weight", wanted=F.col("wanted"))
    part = (F.col("weight") * _impact(F.col("tf"), F.col("dl"), avgdl, k1, b)).alias("score")
    return rows.unionByName(added.select("query_id", "seq", "at", part)).groupBy("query_id", "seq", "at").agg(F.sum("score").alias("score"))


def _sent(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows, made of the table known, that go to every task if there are few."""
    return F.broadcast(rows) if known.count() <= SENT_TERMS else rows


def _block() -> Column:
    return F.shiftright("at", BLOCK_BITS).alias("block")


def _heads(docs: DataFrame, key: str, asked: DataFrame, teams: int, queries: DataFrame, owners: DataFrame | None) -> DataFrame:
    """(team, seq, block, offsets, owners, lists): the chunks of each block that count, in order of their keys, for every team.

    owners has their manuals, lists the manuals of each query as struct(place, open, ids); null where all may be seen.
    """
    rows, parts, groups = docs, [F.col(key).alias("key"), F.col("at").bitwiseAND(BLOCK - 1).cast("int").alias("offset")], asked.sparkSession.range(teams).select(F.col("id").cast("int").alias("team"))
    if owners is not None:
        rows = docs.join(owners.select(key, "manual_id"), key)
        parts.append(F.col("manual_id").cast("string").alias("owner"))
        open_ = F.coalesce(F.size("manual_ids") <= 0, F.lit(True))
        listed = asked.select("team", "place", "query_id").distinct().join(queries.select("query_id", open_.alias("open"), F.transform("manual_ids", lambda m: m.cast("string")).alias("ids")), "query_id")
        groups = listed.groupBy(F.col("team").alias("of")).agg(F.collect_list(F.struct("place", "open", "ids")).alias("lists")).select(F.col("of").alias("team"), "lists")
    rows = rows.groupBy("seq", _block()).agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("rows"))
    rows = rows.select("seq", "block", F.col("rows.offset").alias("offsets"), *([] if owners is None else [F.col("rows.owner").alias("owners")]))
    return rows.crossJoin(groups)  # a row a team and block, as the postings have


def _tile(k: int, pad: bool, avgdl: float, k1: float, b: float, bits: int):
    """The best chunks of a team's queries in one block; of queries with fewer than k above 0, with pad all that have a term of theirs."""

    def tile(postings: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        columns = ["team", "place", "seq", "at", "score"]
        if not len(postings) or not len(heads):
            return pd.DataFrame({c: [] for c in columns})
        chunks = np.asarray(heads["offsets"].iloc[0]).astype(np.int64)
        n = max(int(p.max()) for p in postings["places"]) + 1
        score, met = np.zeros((n, 1 << bits)), np.zeros((n, 1 << bits), bool)
        for offsets, tf, dl, places, weights in zip(*(postings[c] for c in ("offsets", "tfs", "dls", "places", "weights"))):
            at = np.ix_(places, offsets)
            score[at] += np.asarray(weights)[:, None] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))
            met[at] = True
        score, met = np.round(score[:, chunks], 6), met[:, chunks]
        if "lists" in heads:
            owners, may = heads["owners"].iloc[0], np.zeros(met.shape, bool)
            names, code = np.unique(["" if x is None else f"={x}" for x in owners], return_inverse=True)
            of = {name: i for i, name in enumerate(names)}
            for x in heads["lists"].iloc[0]:
                if x["place"] < n:
                    may[x["place"]] = True if x["open"] else np.isin(code, [of[f"={i}"] for i in x["ids"] if f"={i}" in of])
            met &= may
        score[~met] = -np.inf
        keep = np.zeros(met.shape, bool)
        np.put_along_axis(keep, np.argsort(-score, axis=1, kind="stable")[:, :k], True, 1)  # chunks are in order of their keys
        if pad:
            keep |= ((score > 0).sum(1) < k)[:, None]
        place, j = np.nonzero(keep & met)
        first = postings.iloc[0]
        return pd.DataFrame({"team": first["team"], "place": place, "seq": first["seq"], "at": (int(first["block"]) << bits) + chunks[j], "score": score[place, j]}, columns=columns)

    return tile


def bm25_candidates(queries: DataFrame, index: dict[str, DataFrame], k: int, key: str = "chunk_key", k1: float = K1, b: float = B, owners: DataFrame | None = None, seed_postings: int = SEED_POSTINGS, direct_pairs: int = DIRECT_PAIRS, pad: bool = True) -> DataFrame:
    """(query_id, key, score) with the k best chunks of each query, ties by key, among others; of queries with fewer, every chunk with a term of theirs.

    queries(query_id, query[, manual_ids]); owners(key, manual_id) limits each
    query to the manuals that it lists. Scores are rounded to six digits.
    Without pad, chunks of scores up to 0 come only as far as they are among
    the k best.
    """
    known, avgdl = _weighted(queries, index), index["corpus_stats"].first()["avgdl"] or 1.0
    blocks, on, ranges, theta = index["blocks"], ["term"], None, F.lit(None).cast("double").alias("theta")
    if (known.agg(F.sum("df")).first()[0] or 0) > direct_pairs:
        plan = search_plan(queries, known, avgdl, index, k, key, k1, b, owners, seed_postings)
        known, blocks, on, ranges, theta = plan["terms"], plan["blocks"], ["term", "seq", "block"], plan["ranges"], "theta"
    # a team's scores of one block fit a task; places number its queries
    teams = max(1, -(-known.select("query_id").distinct().count() * BLOCK // SCORE_VALUES))
    asked = known.withColumn("team", F.pmod(F.xxhash64("query_id"), F.lit(teams)).cast("int"))
    asked = asked.select("query_id", "term", "weight", theta, "team", (F.dense_rank().over(Window.partitionBy("team").orderBy("query_id")) - 1).alias("place"))
    terms = (asked if ranges is None else asked.join(ranges, "query_id")).groupBy("team", *on).agg(F.collect_list(F.struct("place", "weight")).alias("asks"))
    terms = terms.select("team", *on, F.col("asks.place").alias("places"), F.col("asks.weight").alias("weights"))
    postings = blocks.join(_sent(terms, known) if ranges is None else terms, on).select("team", "seq", "block", "offsets", "tfs", "dls", "places", "weights")
    heads = _heads(index["docs"], key, asked, teams, queries, owners)
    by = ["team", "seq", "block"]
    best = postings.groupBy(*by).cogroup(heads.groupBy(*by)).applyInPandas(_tile(k, pad, avgdl, k1, b, BLOCK_BITS), "team int, place int, seq long, at long, score double")
    best = best.join(asked.select("team", "place", "query_id", "theta").distinct(), ["team", "place"]).where("theta IS NULL OR score >= theta")
    return best.join(index["docs"].select("seq", "at", key), ["seq", "at"]).select("query_id", key, "score")


def postings_read(queries: DataFrame, index: dict[str, DataFrame], k: int, key: str = "chunk_key", **options) -> DataFrame:
    """(query_id, held, read): postings of a query's terms, and those in the blocks that the search for its essential terms opens."""
    plan = search_plan(queries, _weighted(queries, index), index["corpus_stats"].first()["avgdl"] or 1.0, index, k, key, **options)
    terms, met = plan["terms"], plan["met"].select("term", "seq", "block", "n")
    opened = terms.where("essential").join(plan["ranges"], "query_id").join(met, ["term", "seq", "block"]).groupBy("query_id").agg(F.sum("n").alias("read"))
    return terms.groupBy("query_id").agg(F.sum("df").alias("held")).join(opened, "query_id", "left").fillna(0, ["read"])
