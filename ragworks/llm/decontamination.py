"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by size (distinct shingles, doubling from class to
class). An item's sketch is the k least hashes of its shingles (bottom-k
MinHash). A class takes the k that its largest items need: whoever holds a
share t of an item of q shingles lacks at most q - ceil(t q) of them, so it
meets every sketch of q - ceil(t q) + 1 hashes. A document looks its shingle
hashes up in the sketches and skips classes too large for it; what meets is
verified by exact containment on the shingles themselves. The search thus
misses nothing, and long documents cost one pass, however short the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.llm.common import materialize
from ragworks.llm.words import words

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Characters of item text that are searched for in one pass; more items take more passes.
BLOCK_CHARS = 16_000_000
CACHE_WORDS = 500_000
_BITS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = h = xxh64_intdigest(word, 42)
        return h


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, from the words' own."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _STEP + hashes[i : len(hashes) - n + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def shingles(ws: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def needed(q: int, containment: float) -> int:
    """Shingles of q that a document must hold."""
    return max(1, math.ceil(containment * q - 1e-9))


class Index:
    """Sketches of a block of items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple], n: int, containment: float):
        self.n, self.containment = n, containment
        self.items: dict[int, tuple] = {}
        classes: dict[tuple[int, int], list[int]] = {}
        for at, (item_id, text) in enumerate(items):
            ws = words(text)
            if not ws:
                continue
            width = min(n, len(ws))
            own = shingles(ws, width)
            self.items[at] = (item_id, width, own)
            classes.setdefault((width, (len(own) - 1).bit_length()), []).append(at)
        hash_of = _WordHash()
        self.classes: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for (width, _), members in sorted(classes.items()):
            sizes = [len(self.items[at][2]) for at in members]
            depth = max(q - needed(q, containment) + 1 for q in sizes)
            sketch = []
            for at in members:
                own = [np.array([hash_of[w] for w in s.split(b" ")], np.uint64) for s in self.items[at][2]]
                sketch += [(int(h), at) for h in sorted(int(shingle_hashes(x, width)[0]) for x in own)[:depth]]
            sketch.sort()
            values = np.array([h for h, _ in sketch], np.uint64)
            filled = np.zeros(1 << _BITS, bool)
            filled[values >> np.uint64(64 - _BITS)] = True
            self.classes.append((width, needed(min(sizes), containment), values, np.array([at for _, at in sketch]), filled))

    def find(self, ws: list[bytes], hashes: np.ndarray) -> list[tuple]:
        """(item_id, shingles, shared) of the items that a document with these words contains."""
        met: set[int] = set()
        by_width: dict[int, np.ndarray] = {}
        for width, least, values, owners, filled in self.classes:
            if len(ws) - width + 1 < least:
                continue
            if width not in by_width:
                by_width[width] = shingle_hashes(hashes, width)
            own = by_width[width]
            own = own[filled[own >> np.uint64(64 - _BITS)]]
            if len(own):
                own = np.unique(own)
                lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, "right")
                for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                    met.update(owners[a:b].tolist())
        out, held = [], {}
        for at in sorted(met):
            item_id, width, wanted = self.items[at]
            if width not in held:
                held[width] = shingles(ws, width)
            shared = len(wanted & held[width])
            if shared >= needed(len(wanted), self.containment):
                out.append((item_id, len(wanted), shared))
        return out


def _matches(text: Column, index, id_type: str) -> Column:
    @F.pandas_udf(f"array<struct<item_id:{id_type},n_shingles:long,n_shared:long>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sought, hash_of = index.value, _WordHash()
        for batch in texts:
            out = []
            for text in batch:
                ws = words(text)
                out.append([{"item_id": i, "n_shingles": q, "n_shared": s} for i, q, s in sought.find(ws, np.array([hash_of[w] for w in ws], np.uint64))])
                if len(hash_of) > CACHE_WORDS:
                    hash_of.clear()
            yield pd.Series(out, dtype=object)

    return find(text)


def item_indexes(items: DataFrame, shingle_words: int = SHINGLE_WORDS, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> Iterator:
    """Broadcast indexes over items(item_id, text), each of about block_chars characters.

    The size of the items is measured first; a larger benchmark takes more
    blocks, and each block is searched for in a pass of its own.
    """
    sc = items.sparkSession.sparkContext
    rows = items.select("item_id", "text").where("text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sc.broadcast(Index([tuple(r) for r in block.collect()], shingle_words, containment))


def contaminated(docs: DataFrame, items: DataFrame, shingle_words: int = SHINGLE_WORDS, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: every row of docs with every item it contains.

    Containment is the share of an item's distinct shingles that the document
    holds. An item of fewer words than a shingle is one shingle of all its
    words. Items and documents that are null or without words match nothing.
    Repeated rows on either side give repeated rows; empty tables an empty
    result. Other columns are not read.
    """
    id_type = items.schema["item_id"].dataType.simpleString()
    parts, last = [], None
    for index in item_indexes(items, shingle_words, containment, block_chars):
        if last is not None:  # a block's matches are written before the next index goes out, so that tasks hold one at a time
            parts[-1] = materialize(parts[-1], "matches")
            last.unpersist()
        last = index
        parts.append(docs.select("doc_id", F.explode(_matches(F.col("text"), index, id_type)).alias("m")).select("doc_id", "m.*"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, shingle_words: int = SHINGLE_WORDS, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that contain an item; all columns pass through, null texts stay."""
    id_type = items.schema["item_id"].dataType.simpleString()
    last = None
    for index in item_indexes(items, shingle_words, containment, block_chars):
        if last is not None:
            docs = materialize(docs, "survivors")
            last.unpersist()
        last = index
        docs = docs.where(F.size(_matches(F.col("text"), index, id_type)) == 0)
    return docs
