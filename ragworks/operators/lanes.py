"""Vectors from an encoder that allows so many requests a minute: a fixed number of lanes share them, and no text is asked for twice.

Under one folder, which belongs to one encoder, lie

* vectors(hash, embedding): of every text that was ever asked for,
* requests: a file for each answered request of the round that runs.

Each distinct text without a vector goes to one of the lanes, which are the
tasks of one stage, however large the cluster. A lane asks for its texts in
the order of their hashes and writes each answer as it comes. A task that is
run again makes the same requests and leaves out those that have a file; a job
that is run again first takes the files of the one that failed. So what is
asked for twice is at most the one request of a lane that was under way. (Two
attempts that run at the same time may ask alike: switch speculation off.)
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragworks.operators.index import ATTEMPTS, BATCH, WAIT_S, Encoder, hashing_encoder, patiently
from ragworks.sources.io import exists, remove, written

LANES = 8
#: Requests of a round: as many files as lie in the folder before they become rows of the table.
ROUND_REQUESTS = 20_000
VECTORS = "hash string, embedding array<float>"
_ARROW = pa.schema([("hash", pa.string()), ("embedding", pa.list_(pa.float32()))])


def _requests(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of batches in tables of `size` rows, whatever the bounds of the batches."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        while len(batch):
            piece, batch = batch.iloc[: size - n], batch.iloc[size - n :]
            held.append(piece)
            n += len(piece)
            if n == size:
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


def answer_requests_of_lane(batches: Iterator[pd.DataFrame], folder: str, make_encoder: Callable[[], Encoder], batch: int, every_s: float, attempts: int, wait_s: float) -> Iterator[pd.DataFrame]:
    """Ask for the texts of (hash, text) rows, one request in every_s seconds, and write each answer; (asked, found) as one row."""
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base)
    encoder, due, asked, found = None, 0.0, 0, 0
    for request in _requests(batches, batch):
        hashes = request["hash"].tolist()
        path = f"{base}/{hashlib.sha256(','.join(hashes).encode()).hexdigest()}.parquet"
        if files.get_file_info(path).type != fs.FileType.NotFound:
            found += 1
            continue
        encoder = encoder or make_encoder()
        time.sleep(max(0.0, due - time.monotonic()))
        due = time.monotonic() + every_s
        vectors = patiently(encoder, request["text"].tolist(), attempts, wait_s)
        # a name that readers pass over until the answer is whole
        part = f"{base}/_{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            pq.write_table(pa.table([hashes, vectors], schema=_ARROW), out)
        files.move(part, path)
        asked += 1
    yield pd.DataFrame({"asked": [asked], "found": [found]})


def _take_in(spark: SparkSession, store: str) -> None:
    """Make the answers under requests rows of the table; those that it has already, from a run that failed just here, are left out."""
    folder = f"{store}/requests"
    if not exists(spark, folder):
        return
    new = spark.read.schema(VECTORS).parquet(folder).dropDuplicates(["hash"])
    new = new.join(read_vectors(spark, store).select("hash"), "hash", "left_anti")
    # written apart first: what is appended must not be read from the table it goes to
    new = written(new, "answers")
    new.write.mode("append").parquet(f"{store}/vectors")
    remove(spark, new.table_path)
    remove(spark, folder)


def read_vectors(spark: SparkSession, store: str) -> DataFrame:
    if not exists(spark, f"{store}/vectors"):  # nothing was ever asked for
        return spark.createDataFrame([], VECTORS)
    return spark.read.schema(VECTORS).parquet(f"{store}/vectors")


def embed_in_lanes(
    texts: DataFrame, make_encoder: Callable[[], Encoder] = hashing_encoder, store: str = "", text: str = "page_content", lanes: int = LANES, per_minute: float | None = None,
    batch: int = BATCH, attempts: int = ATTEMPTS, wait_s: float = WAIT_S, round_requests: int = ROUND_REQUESTS,
) -> DataFrame:
    """texts with `embedding`: array<float>, from the vectors under store and, for texts that have none there, from the encoder.

    per_minute: requests that all lanes together may make in a minute; each has
    its own share. A rate limit is waited out by the lane that meets it, up to
    `attempts` times; then, and on any other error, the task fails. Null texts
    count as empty, and equal texts are one. store must be a folder that the
    executors share and that pyarrow can write to. One writer at a time.
    """
    if not store:
        raise ValueError("store: a folder for the vectors of this encoder")
    spark = texts.sparkSession
    _take_in(spark, store)
    every_s = 60.0 * lanes / per_minute if per_minute else 0.0
    hashed = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    open_ = texts.select(hashed(text).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["hash"])
    open_ = written(open_.join(read_vectors(spark, store).select("hash"), "hash", "left_anti"), "open")
    rounds = max(1, -(-open_.count() // (batch * round_requests)))
    for i in range(rounds):
        turn = open_.where(F.pmod(F.xxhash64("hash"), F.lit(rounds)) == i)
        # a number of partitions that is asked for stays: as many tasks as lanes
        lane = turn.repartition(lanes, "hash").sortWithinPartitions("hash")
        folder = f"{store}/requests"
        lane.mapInPandas(lambda it: answer_requests_of_lane(it, folder, make_encoder, batch, every_s, attempts, wait_s), "asked long, found long").agg(F.sum("asked")).collect()
        _take_in(spark, store)
    remove(spark, open_.table_path)
    made = read_vectors(spark, store).withColumnRenamed("hash", "__hash")
    out = texts.drop("embedding").withColumn("__text", hashed(text))
    return out.join(made, F.col("__text") == F.col("__hash"), "left").drop("__text", "__hash")
