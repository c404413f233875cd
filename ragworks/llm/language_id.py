"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that no
language knows falls back to its longest known character n-grams, from
MAX_GRAM characters down to one. Text scores are sums over words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.llm.common import bound_batches, discard, hash_fraction, materialize

#: Characters of labelled text of each language that the model is fitted on, at most (about: a hash picks the documents).
MAX_TRAIN_CHARS = 2_000_000
MAX_GRAM = 4
SMOOTHING = 0.5
UNKNOWN = "und"
#: Unknown words that a worker keeps, and values that it adds up at once.
CACHE_WORDS = 200_000
RUN_VALUES = 4_000_000

_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            seen: Counter = Counter()
            for text in group["text"]:
                seen.update(_WORD.findall(text.lower()))
            if seen:
                yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())})


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: Counter = Counter()
        for lang, word, n in zip(batch["lang"], batch["word"], batch["n"].tolist()):
            for size in range(1, MAX_GRAM + 1):
                for g in grams(word, size):
                    seen[lang, size, g] += n
        if seen:
            yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["lang", "size", "gram", "n"])


def fit(labelled: DataFrame, max_train_chars: int = MAX_TRAIN_CHARS) -> dict:
    """labelled(doc_id, text, lang) -> model. Rows with a null id, text or lang teach nothing.

    The sample is bounded by max_train_chars a language, and with it the words
    and n-grams; all of the sample's count.
    """
    rows = labelled.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "tables": []}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_train_chars / max(n, 1)))])[F.col("lang")]
    sample = rows.where(hash_fraction(F.col("doc_id"), share)).select("lang", "text")
    counted = sample.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "word_counts")
    words = counted.toPandas()
    counted_grams = counted.mapInPandas(_count_grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    kept = counted_grams.select("lang", "size", F.col("gram").alias("term"), "n").toPandas()
    discard(counted)
    parts = [words.rename(columns={"word": "term"}), *(kept[kept["size"] == n] for n in range(1, MAX_GRAM + 1))]
    return {"langs": langs, "tables": [_likelihoods(part, langs) for part in parts]}


def _likelihoods(counts: pd.DataFrame, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Terms with their rows in a matrix of smoothed log frequencies, a column for each language."""
    terms = sorted(set(counts["term"]))
    row = {t: i for i, t in enumerate(terms)}
    n = np.full((len(terms), len(langs)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(langs)}
    n[counts["term"].map(row).to_numpy(int), counts["lang"].map(column).to_numpy(int)] += counts["n"].to_numpy()
    return row, np.log(n / (n.sum(0) + 1.0))


class Scorer(dict):
    """word -> row of the log-likelihood matrix: known words from the start, others as they come; bounded."""

    def __init__(self, model: dict):
        self.model = model
        self._start()

    def _start(self) -> None:
        self.clear()
        known, likely = self.model["tables"][0] if self.model["langs"] else ({}, np.zeros((0, 0)))
        self.update(known)
        self.rows, self.n = likely, len(likely)

    def __missing__(self, word: str) -> int:
        row = np.zeros(len(self.model["langs"]))
        for size in range(MAX_GRAM, 0, -1):
            known, likely = self.model["tables"][size]
            found = [known[g] for g in grams(word, size) if g in known]
            if found:
                row = likely[found].mean(0)
                break
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(1024, self.n // 4), len(row)))])
        self.rows[self.n] = row
        self[word] = at = self.n
        self.n = at + 1
        return at

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        langs = self.model["langs"]
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        open_ = [i for i, t in enumerate(texts) if langs and t is not None and any(map(str.isalpha, t))]
        run, size = [], 0
        for i in open_:
            run.append(i)
            size += len(texts[i]) * len(langs)
            if size >= RUN_VALUES or i == open_[-1]:
                for j, got in zip(run, self._run([texts[k] for k in run])):
                    out[j] = got
                run, size = [], 0
        return out

    def _run(self, texts: list[str]) -> list[tuple[str, float]]:
        langs = self.model["langs"]
        if len(self) > len(self.model["tables"][0][0]) + CACHE_WORDS:
            self._start()
        numbers = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in (_WORD.findall(t.lower()) for t in texts)]
        total = np.array([self.rows[at].sum(0) for at in numbers])
        likely = np.exp(total - total.max(1, keepdims=True))
        best = total.argmax(1)
        score = likely[np.arange(len(best)), best] / likely.sum(1)
        return [(langs[k], s) for k, s in zip(best.tolist(), score.tolist())]


def predict(text: Column, model) -> Column:
    """struct(lang_pred, score) of a text column; model: a broadcast of fit()'s result."""

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value)
        for batch in texts:
            yield pd.DataFrame(scorer.predict(list(batch)), columns=["lang_pred", "score"])

    return language(text)


def identify_language(docs: DataFrame, labelled: DataFrame, max_train_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row of docs, learnt from `labelled`.

    `und` with score 0 where the text is null or has no letter, or where
    `labelled` teaches no language. Letters of which no n-gram is known give
    the first language by name. Ties go to the first language by name.
    Repeated rows give repeated rows; an empty table an empty result; columns
    besides doc_id, text and lang are not read, and lang only from `labelled`.
    """
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled, max_train_chars))
    got = docs.select("doc_id", predict(F.col("text"), model).alias("__got"))
    return got.select("doc_id", "__got.lang_pred", "__got.score")
