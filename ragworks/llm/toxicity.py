"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words and the heads of its longer words, hashed to
32 bits. Inputs of the model are the terms whose rate differs between the
classes of the training sample, and those that matter in a pair: the odds of
the four cases (both, one, the other, none) are not the product of two single
effects. The machine learns a weight for each input and, by inner products of
factors, one for each pair of inputs in one text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.llm.common import bound_batches, discard, hash_fraction, materialize

#: Labelled rows of each class that the model is fitted on, at most (about: a hash picks them).
MAX_TOXIC = 4_000
MAX_CLEAN = 8_000
#: Inputs by their own rates, at most, and the standard errors by which rates differ.
MAX_TERMS = 4_096
MIN_Z = 5.0
#: The most frequent terms of the sample, whose pairs are looked at; standard errors of a joint effect; rows that each of the four cases needs; inputs that pairs add, at most.
PAIR_TERMS = 2_048
PAIR_Z = 5.0
PAIR_ROWS = 20
MAX_PAIR_TERMS = 1_024
FACTORS = 8
BATCH = 512
STEPS = 1_500
#: Lengths of the heads of longer words that are terms too (word forms share them).
HEADS = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def term_hashes(word: str) -> tuple[int, ...]:
    return (zlib.crc32(word.encode()), *(zlib.crc32(b"^" + word[:n].encode()) for n in HEADS if len(word) > n))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        terms = [sorted({h for w in set(_WORD.findall(t.lower())) for h in term_hashes(w)}) for t in batch["text"]]
        yield pd.DataFrame({"toxic": batch["toxic"], "terms": terms})


def _training_terms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, terms) of the training sample, as a table."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, MAX_TOXIC / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, MAX_CLEAN / sizes.get(0, 1))))
    picked = known.where(hash_fraction(F.col("doc_id"), share))
    # the hash keeps about MAX_TOXIC + MAX_CLEAN ids of 12 bytes, whatever the input: a bounded broadcast
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    return materialize(rows.mapInPandas(_hashed, "toxic int, terms array<long>"), "toxicity_terms")


def _candidates(rows: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms whose own rates differ by MIN_Z standard errors or more, the most frequent terms), each a bounded number."""
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("c1"), F.count(F.lit(1)).alias("c"))
    counts = materialize(counts, "term_counts")
    p = F.col("c") / (n1 + n0)
    gap = F.abs(F.col("c1") / n1 - (F.col("c") - F.col("c1")) / n0)
    z = gap / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    single = counts.select("term", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect()
    frequent = counts.orderBy(F.desc("c"), "term").limit(PAIR_TERMS).collect()
    discard(counts)
    return tuple(np.sort(np.array([r["term"] for r in x], np.int64)) for x in (single, frequent))


def joint_effects(y: np.ndarray, held: list[np.ndarray], n_terms: int, block: int = 256) -> np.ndarray:
    """For each term the largest joint effect it has with another one, in standard errors of the log odds.

    The effect of a pair is ln(odds both) - ln(odds one) - ln(odds other) +
    ln(odds none): zero where single effects say it all. Pairs of which a case
    has fewer than PAIR_ROWS rows have none. held: the terms of each row.
    """
    both, toxic = np.zeros((n_terms, n_terms), np.float32), np.zeros((n_terms, n_terms), np.float32)
    for i in range(0, len(held), 1024):
        x = np.zeros((len(held[i : i + 1024]), n_terms), np.float32)
        for row, terms in zip(x, held[i : i + 1024]):
            row[terms] = 1
        both += x.T @ x
        x = x[y[i : i + 1024] == 1]
        toxic += x.T @ x
    n, n1 = len(held), y.sum()
    own, own1 = both.diagonal(), toxic.diagonal()
    out = np.zeros(n_terms)
    for a in range(0, n_terms, block):
        part = slice(a, a + block)
        cases = [(1, both[part], toxic[part])]
        cases.append((-1, own[part, None] - both[part], own1[part, None] - toxic[part]))
        cases.append((-1, own - both[part], own1 - toxic[part]))
        cases.append((1, n - own[part, None] - cases[2][1], n1 - own1[part, None] - cases[2][2]))
        effect, variance, least = (np.full(both[part].shape, x, np.float32) for x in (0, 0, np.inf))
        for sign, count, hits in cases:
            effect += sign * np.log((hits + 0.5) / (count - hits + 0.5))
            variance += 1 / (hits + 0.5) + 1 / (count - hits + 0.5)
            least = np.minimum(least, count)
        out[part] = np.where(least >= PAIR_ROWS, np.abs(effect) / np.sqrt(variance), 0).max(1)
    return out


def _held_terms(rows: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels of the sample's rows, and the places in `terms` of the terms that each has."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [np.searchsorted(terms, np.intersect1d(t, terms)).astype(np.int32) for t in batch["terms"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "at": at})

    got = rows.mapInPandas(places, "toxic int, at array<int>").toPandas()
    return (got["toxic"].to_numpy() == 1).astype(float), [np.asarray(x, np.int64) for x in got["at"]]


def forward(bias: float, w: np.ndarray, v: np.ndarray, at: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the sums of factors, of n rows given as (row, term) entries."""
    sums = np.stack([np.bincount(row, v[at, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(row, (v[at] ** 2).sum(1), n)
    return bias + np.bincount(row, w[at], n) + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> dict:
    """Model from docs(doc_id, text) joined with labels(doc_id, toxic), on a bounded sample; adaptive gradient steps.

    Every bound above is one on the sample or on the size of the model, so
    the driver holds the same amount at any size of the input.
    """
    bound_batches(docs.sparkSession)
    rows = _training_terms(docs, labels)
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    prior = (n1 + 0.5) / (n + 1.0)
    model = {"bias": float(np.log(prior / (1 - prior))), "terms": {}, "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    if not 0 < n1 < n:
        return model
    single, frequent = _candidates(rows, n1, n - n1)
    seen = np.union1d(single, frequent)
    y, held = _held_terms(rows, seen)
    common = np.isin(seen, frequent)
    place = np.cumsum(common) - 1
    effects = joint_effects(y, [place[x[common[x]]] for x in held], len(frequent))
    paired = np.argsort(-effects, kind="stable")[:MAX_PAIR_TERMS]
    terms = np.union1d(single, frequent[paired[effects[paired] >= PAIR_Z]])
    if not len(terms):
        return model
    used = np.isin(seen, terms)
    place = np.cumsum(used) - 1
    bias, w, v = learn(y, [place[x[used[x]]] for x in held], len(terms), prior, seed)
    return {"bias": bias, "terms": {int(t): i for i, t in enumerate(terms)}, "w": w, "v": v}


def learn(y: np.ndarray, held: list[np.ndarray], n_terms: int, prior: float, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) by adaptive gradient steps; held: the terms of each row, y: its class. Classes weigh alike."""
    rng = np.random.default_rng(seed)
    bias, w, v = np.array([np.log(prior / (1 - prior))]), np.zeros(n_terms), rng.normal(0, 0.1, (n_terms, FACTORS))
    gb, gw, gv = np.full(1, 1e-8), np.full(n_terms, 1e-8), np.full(v.shape, 1e-8)
    weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior))
    batches = max(1, len(y) // BATCH)
    for _ in range(-(-STEPS // batches)):
        for batch in np.array_split(rng.permutation(len(y)), batches):
            at = np.concatenate([held[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(held[i]) for i in batch])
            z, sums = forward(bias[0], w, v, at, row, len(batch))
            slope = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch])
            db = slope.mean(keepdims=True)
            dw = np.bincount(at, slope[row], n_terms) / len(batch) + 1e-5 * w
            each = slope[row, None] * (sums[row] - v[at])
            dv = np.stack([np.bincount(at, each[:, f], n_terms) for f in range(FACTORS)], axis=1) / len(batch) + 1e-4 * v
            for x, d, g in ((bias, db, gb), (w, dw, gw), (v, dv, gv)):
                g += d * d
                x -= 0.1 * d / np.sqrt(g)
    return float(bias[0]), w, v


class Scorer(dict):
    """word -> places of its terms in the model, filled as words come; bounded."""

    def __init__(self, model: dict):
        self.model = model

    def __missing__(self, word: str) -> tuple[int, ...]:
        terms = self.model["terms"]
        self[word] = found = tuple(terms[h] for h in term_hashes(word) if h in terms)
        return found

    def score(self, text: str | None) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        m = self.model
        at = sorted({i for w in set(_WORD.findall((text or "").lower())) for i in self[w]})
        v = m["v"][at]
        z = m["bias"] + m["w"][at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity_score(text: Column, model) -> Column:
    """Score (0 to 1) of a text column; model: a broadcast of fit()'s result. Null and empty texts get the score of no terms."""

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    return toxicity(text)


def score_toxicity(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted (1 from THRESHOLD on) of every row of docs.

    Nulls: a null text counts as empty, rows with a null label or id teach
    nothing; of several labels for one id the largest counts. Without both
    classes in the sample every score is the smoothed share of toxic rows.
    Repeated rows give repeated rows; an empty table an empty result; columns
    besides doc_id, text and toxic are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training_docs, labels))
    scored = docs.select("doc_id", toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
