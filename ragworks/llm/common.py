"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

_local_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session within one process may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="spark-ragworks-"))
    return "file://" + _local_scratch[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage, so a lost executor costs no recomputation of what
    stands above, and it tells the optimizer the true size of the table, so
    that Spark's own size check decides on broadcasts.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/ragworks-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() made, once what follows from them is itself written."""
    for t in tables:
        session = t.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(t.table_path).getParent()
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: 64-bit words of a filter: at most so many rows of 12 bytes are broadcast, about 3 MB.
FILTER_WORDS = 1 << 18


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with a column `name`: false where key is surely not in keys, a table of one column.

    A Bloom filter with one bit a key, of bounded size at any number of keys,
    put before a join so that only rows that may have a partner cross the
    network. Where keys are many it lets more rows pass; the join decides.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(F.xxhash64(c), 32), F.lit(64)).cast("int"))
    own = F.col(keys.columns[0])
    (at, bits) = free_names(rows, "filter_word", "filter_bits")
    words = materialize(keys.groupBy(word(own).alias(at)).agg(F.bit_or(bit(own)).alias(bits)), "filter")
    tested = rows.withColumn(at, word(key)).join(F.broadcast(words), at, "left")
    return tested.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))).drop(at, bits)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where df has a column so called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod modulus, equals remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_fraction(key: Column, fraction: Column | float) -> Column:
    """A repeatable Bernoulli sample: the same rows at any partitioning; a null key is in no sample."""
    return key.isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(float(1 << 30)) * fraction)


#: Texts in one Arrow batch of the operators that work on texts in Python, at most.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS rows, as a worker holds a whole batch of texts and its results."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches for what is computed inside; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(key, before)
