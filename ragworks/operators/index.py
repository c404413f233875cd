"""Dense vectors and BM25 tables of a chunk corpus."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list]

#: Texts of one request to an encoder (fixed value), and waits after a rate limit: WAIT_S * 2 ** attempt.
BATCH = 90
ATTEMPTS = 5
WAIT_S = 20.0

#: Okapi BM25; idf = ln((N - df + 0.5) / (df + 0.5)), negative ones become EPSILON times the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25


class RateLimited(Exception):
    """What an encoder raises to be asked again later."""


def hashing_encoder(dimensions: int = 64) -> Encoder:
    """A deterministic offline encoder: signed feature hashing of lower-case words, unit length."""

    def encode(texts: list[str]) -> list[list[float]]:
        split = [text.lower().split() for text in texts]
        known = {word: i for i, word in enumerate({w for ws in split for w in ws})}  # each word is hashed once a request
        digests = b"".join(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest() for w in known)
        hashes = np.frombuffer(digests, "<u8")
        place, sign = (hashes % np.uint64(dimensions)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)
        at = np.fromiter((known[w] for ws in split for w in ws), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        out = np.bincount(row * dimensions + place[at], sign[at], len(texts) * dimensions).reshape(len(texts), dimensions)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length == 0, 1, length)).astype(np.float32).tolist()

    return encode


def patiently(encoder: Encoder, texts: list[str], attempts: int, wait_s: float) -> list:
    """What the encoder answers; a rate limit is waited out, longer each time."""
    for attempt in range(attempts):
        try:
            return encoder(texts)
        except RateLimited:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait_s * 2**attempt)
    return []


def embed(texts: DataFrame, make_encoder: Callable[[], Encoder] = hashing_encoder, text: str = "page_content", batch: int = BATCH, attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> DataFrame:
    """texts with `embedding`: array<float>, in requests of `batch` texts.

    make_encoder is called once a task. A rate limit is waited out, up to
    `attempts` times; then, and on any other error, the task fails.
    Null texts count as empty.
    """

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, kind = make_encoder(), pa.list_(pa.float32())
        for texts in batches:
            # the texts of one request are Python strings at a time, and answers are packed at once
            asked = (["" if v is None else v for v in texts.slice(i, batch).to_pylist()] for i in range(0, len(texts), batch))
            yield pa.concat_arrays([pa.array([], kind), *(pa.array(patiently(encoder, values, attempts, wait_s), kind) for values in asked)])

    return texts.withColumn("embedding", vectors(F.col(text)))


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda t: t != "")


def index_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n"))


def upsert_chunks(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """new, and what existing has beside it; running it again changes nothing. Of repeated keys in new one row stays."""
    new = new.dropDuplicates(list(keys))
    same = reduce(lambda a, b: a & b, [existing[k].eqNullSafe(new[k]) for k in keys])
    return new.unionByName(existing.join(new, same, "left_anti"), allowMissingColumns=True)


def delete_document(table: DataFrame, manual_ids: DataFrame, key: str = "manual_id") -> DataFrame:
    """table without the rows of the listed manuals."""
    return table.join(manual_ids.select(F.col(key).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")
