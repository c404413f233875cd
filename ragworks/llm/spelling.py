"""Spelling variants of words by a rare-first prefix filter on positional bigrams.

Two words one edit apart differ in at most two bigrams each, the others stand
in both in the same order and shifted by one place at most. So if the bigrams
of all words are put into one global order, the rarest first, each word need
only show its three rarest: at least one that both words keep is among the
three of either. The edit lies before or after that bigram, so the words agree
from their start to its end, or from its start to their end: this is the
position limit, and the key under which words meet. What the words of a very
frequent key have besides it is told apart by its deletions (the string and
all strings with one code point less: two strings at most one edit apart share
one), so that no key holds more than a bounded number of words that Spark
compares with each other. Every meeting is verified by edit distance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.llm.common import ASCII_LOWER, ASCII_UPPER, discard, materialize, small_batches

MIN_LENGTH = 6
MIN_COUNT = 5
#: How many times more frequent a form must be than its variant.
RATIO = 5
#: Bigrams that a word shows: one edit destroys two, the third remains.
PREFIX = 3
#: Words under one key from which they are told apart by deletions.
HOT_KEY = 500
#: Code points of the ends by which long strings are told apart instead.
LONG_END = 32
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: One in so many pairs of document and run has a code point deleted.
NOISE = 199

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def document_words(doc_id: str, text: str | None, noise: int = NOISE) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text: runs of letters, A-Z in lower case; a run whose hash noise divides loses a code point."""
    for run, n in Counter(RUN.findall((text or "").translate(_LOWER))).items():
        h = crc32(f"{doc_id}:{run}".encode())
        if noise and h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of all words of docs(doc_id, text) of so many code points and occurrences.

    Each task counts what it reads, up to HELD_WORDS different words at a time,
    so that a frequent word costs a row a task. Null texts have no words; a null id is
    hashed as nothing before the colon.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            found = pd.DataFrame({"word": list(held), "n": list(held.values())})
            held.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                for word, n in document_words(doc_id, text, noise):
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rarest_bigrams(words: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(word, pos) of the rarest bigrams of each word, by the number of places that all words have of a bigram, ties by bigram and place."""
    # split first, so that the bigrams of a very long word are not each sought from its start
    letters = words.select("word", F.split("word", "").alias("letters"))
    bigrams = F.transform(F.slice("letters", 1, F.size("letters") - 1), lambda c, i: F.struct(i.alias("pos"), F.concat(c, F.get("letters", i + 1)).alias("gram")))
    grams = letters.select("word", F.explode(bigrams).alias("g")).select("word", "g.pos", "g.gram")
    frequency = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("places")), "bigrams")
    first = grams.join(frequency, "gram").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("places", "gram", "pos"))), 1, prefix).alias("rarest"))
    return first.select("word", F.explode("rarest").alias("g")).select("word", "g.pos")


def meeting_keys(rare: DataFrame) -> DataFrame:
    """rare(word, pos) -> (key, word, rest): the word up to the end of the bigram, and from its start; rest is what the key leaves out."""
    start, length = F.col("pos") + 1, F.length("word")
    head, tail = F.substring("word", F.lit(1), F.col("pos") + 2), F.substring("word", start, length)
    after, before = F.substring("word", F.col("pos") + 3, length), F.substring("word", F.lit(1), F.col("pos"))
    sides = F.array(F.struct(F.concat(F.lit("<"), head).alias("key"), after.alias("rest")), F.struct(F.concat(F.lit(">"), tail).alias("key"), before.alias("rest")))
    return rare.select("word", F.explode(sides).alias("s")).select("s.key", "word", "s.rest")


def _likenesses(text: Column) -> Column:
    """What two strings at most one edit apart have in common: the string or one that lacks a code point; where they are long, an end of LONG_END code points."""
    size = F.length(text)
    shorter = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, size)))
    none = F.array().cast("array<string>")
    # lengths 2 * LONG_END + 1 and one more have both kinds, so that a pair has one kind in common
    few = F.when((size > 0) & (size <= 2 * LONG_END + 2), F.concat(F.array(text), shorter)).when(size == 0, F.array(text)).otherwise(none)
    ends = F.array(F.concat(F.lit("<"), F.substring(text, F.lit(1), F.lit(LONG_END))), F.concat(F.lit(">"), F.substring(text, size - LONG_END + 1, F.lit(LONG_END))))
    return F.array_distinct(F.concat(few, F.when(size > 2 * LONG_END, ends).otherwise(none)))


def near_words(words: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Pairs (a, b), a < b, of words (distinct, of at least four code points) that differ by exactly one insertion, deletion or replacement."""
    keys = materialize(meeting_keys(rarest_bigrams(words)), "keys")
    sizes = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    met = keys.join(sizes, "key")
    hot = met.where(F.col("n") > hot_key).select("key", "word", F.explode(_likenesses(F.col("rest"))).alias("part"))
    fine = met.where(F.col("n") <= hot_key).select("key", "word", F.lit("").alias("part")).unionByName(hot)
    fine = materialize(fine, "dealt")
    a, b = fine.select("key", "part", F.col("word").alias("a")), fine.select("key", "part", F.col("word").alias("b"))
    pairs = a.join(b, ["key", "part"]).where("a < b AND abs(length(a) - length(b)) <= 1").where(F.levenshtein("a", "b", 1) == 1)
    out = materialize(pairs.select("a", "b").distinct(), "pairs")
    discard(keys, sizes, fine)
    return out


def spelling_forms(words: DataFrame, ratio: int = RATIO, hot_key: int = HOT_KEY) -> DataFrame:
    """words(word, n), a table -> (word, form, root, n, n_near, form_n).

    form is the near word of the largest n (ties: the smallest) if that is at
    least ratio * n; root is where forms lead to, the word itself without one.
    """
    pairs = near_words(words.select("word"), hot_key)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(counts, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    frequent = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "forms")
    # each form has ratio times the occurrences of its word: chains are short, and each round doubles what is known of them
    cur = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while not cur.isEmpty():
        cur = materialize(cur, "roots")
        further = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if cur.join(further, "root", "left_semi").isEmpty():
            break
        cur = cur.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    out = rows.join(cur, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE, hot_key: int = HOT_KEY) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs(doc_id, text).

    noise puts misspellings into one of so many pairs of document and run (0:
    none). Null and empty texts have no words, rows that repeat count again;
    an empty table gives an empty result. Other columns are not read.
    """
    if min_length < PREFIX + 1:
        raise ValueError(f"words need {PREFIX + 1} code points for {PREFIX} bigrams")
    with small_batches(docs.sparkSession):
        words = materialize(count_words(docs, min_length, min_count, noise), "words")
    return spelling_forms(words, ratio, hot_key)
