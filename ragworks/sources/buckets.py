"""Chunk tables in buckets that split: what an ingest rewrites is bounded by the buckets of its own documents.

A bucket has all documents whose hash begins with its bits; the whole table
is the bucket of no bits. A bucket that outgrows its bound is parted by as many
further bits as it needs. Every ingest writes the buckets it touches into a new
folder, and a manifest lists which folder has which bucket, so readers see the
table before or after an ingest and nothing between. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragworks.sources.io import exists, remove, written

#: Rows of a bucket, beyond which it is parted.
BUCKET_ROWS = 200_000
#: Rows that one task deals to buckets, and tasks beyond which it is TASK_ROWS.
FEW_ROWS, MANY_TASKS, TASK_ROWS = 4_000, 128, 20_000
#: Documents that every task may hold, some hundred MB.
SENT_IDS = 1_000_000
#: Bits of a document's hash: as many as a bucket's name can have.
BITS = 40
MANIFEST = "version long, bucket string, folder string, n long"


def hash_bits(doc: Column) -> Column:
    return F.lpad(F.bin(F.xxhash64(F.coalesce(doc.cast("string"), F.lit(""))).bitwiseAND((1 << BITS) - 1)), BITS, "0")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, DataFrame | None]:
    """(last version, rows bucket, folder, n of `version`) of the table at path; without a version the last one counts, version 0 is no table."""
    if not exists(spark, f"{path}/manifest"):
        return 0, None
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    last = rows.agg(F.max("version")).first()[0]
    return last, None if version == 0 else rows.where(F.col("version") == (version or last))


def _named(buckets: DataFrame) -> dict[str, list[str]]:
    """Folder -> its buckets; as many as the table's rows over BUCKET_ROWS, like the files that Spark lists."""
    out: dict[str, list[str]] = {}
    for r in buckets.where("folder IS NOT NULL").select("folder", "bucket").collect():
        out.setdefault(r["folder"], []).append(r["bucket"])
    return out


def _rows(spark: SparkSession, path: str, named: dict[str, list[str]]) -> DataFrame:
    parts = [spark.read.option("basePath", f"{path}/{folder}").parquet(*[f"{path}/{folder}/__bucket=b{b}" for b in buckets]).drop("__bucket") for folder, buckets in named.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, spark.read.parquet(f"{path}/empty"))


def read_documents(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of the table at path."""
    return _rows(spark, path, _named(manifest(spark, path, version)[1]))


def _touched(ids: DataFrame, buckets: DataFrame, doc: str) -> DataFrame:
    """Buckets that have one of the ids: names of each length that occurs are looked up among those that exist."""
    lengths = [r[0] for r in buckets.select(F.length("bucket")).distinct().collect()]  # BITS at most
    names = ids.select(F.explode(F.array(*[F.substring(hash_bits(F.col(doc)), 1, n) for n in lengths])).alias("bucket")).distinct()
    return buckets.join(names, "bucket")


def documents_of(spark: SparkSession, path: str, ids: DataFrame, doc: str = "doc_id", version: int | None = None) -> DataFrame | None:
    """The rows of the listed documents, from their buckets alone; None where there is no table or no such bucket."""
    _, buckets = manifest(spark, path, version)
    named = {} if buckets is None else _named(_touched(ids, buckets, doc))
    if not named:
        return None
    wanted = _sent(ids.select(F.col(doc).alias("__id")))
    return _rows(spark, path, named).join(wanted, F.col(doc).eqNullSafe(F.col("__id")), "left_semi")


def _sent(ids: DataFrame) -> DataFrame:
    """ids, a table: where they are few every task has them, so that no row moves to meet them."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def dealt(rows: DataFrame, tasks: int, doc: str = "doc_id") -> DataFrame:
    """rows by the hash of their document, so that a task has those of few buckets."""
    return rows.repartitionByRange(tasks, hash_bits(F.col(doc)))


def _missing(spark: SparkSession, made: DataFrame, touched: DataFrame) -> DataFrame:
    """Empty buckets (bucket, folder, n) beside those that were made by parting one: all names of the same length that have no rows."""
    parts = made.join(touched.select(F.col("bucket").alias("__from")), F.col("bucket").startswith(F.col("__from")) & (F.length("bucket") > F.length("__from")))
    whole = parts.select("__from", (F.length("bucket") - F.length("__from")).alias("more")).distinct()
    each = whole.select(F.explode(F.transform(F.sequence(F.lit(0), F.expr("shiftleft(1, more) - 1")), lambda i: F.concat("__from", F.lpad(F.bin(i.cast("long")), F.col("more"), "0")))).alias("bucket"))
    none = each.join(made.select("bucket"), "bucket", "left_anti")
    return none.select("bucket", F.lit(None).cast("string").alias("folder"), F.lit(0).cast("long").alias("n"))


def replace_documents(
    chunks: DataFrame, path: str, ids: DataFrame | None = None, doc: str = "doc_id", bucket_rows: int = BUCKET_ROWS, base: int | None = None, finish: Callable[[DataFrame], DataFrame] | None = None, deal: bool = True
) -> tuple[DataFrame, int]:
    """(table, version) after the documents of chunks, and of ids(doc), were replaced by chunks; repeating it changes nothing.

    chunks should be a table. A document that is in ids alone is deleted. The
    rows of one document stay together, however many they are. base: the
    version that is changed, where it is not the last one. finish(chunks) adds
    columns where rows are written, so that these are not shuffled. Without
    deal the chunks lie as `dealt` has left them, and are not shuffled either.
    """
    spark = chunks.sparkSession
    ids = chunks.select(doc).distinct() if ids is None else chunks.select(doc).unionByName(ids.select(doc)).distinct()
    version, buckets = manifest(spark, path, base)
    finish = finish or (lambda rows: rows)
    made_here, kept = [], None
    if buckets is None:
        finish(chunks.where("false")).write.mode("ignore").parquet(f"{path}/empty")  # the columns of a table without rows
        touched = spark.createDataFrame([("",)], "bucket string")
    else:
        ids = written(ids, "ids")
        touched = written(_touched(ids, buckets, doc).select("bucket", "folder"), "touched")
        made_here += [ids, touched]
        if named := _named(touched):
            gone = _sent(ids.select(F.col(doc).alias("__gone")))
            kept = _rows(spark, path, named).join(gone, F.col(doc).eqNullSafe(F.col("__gone")), "left_anti")
    lengths = [r[0] for r in touched.select(F.length("bucket")).distinct().collect()]  # BITS at most
    names = F.array(*[F.substring("__bits", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")

    def placed(rows: DataFrame, places: DataFrame) -> DataFrame:
        named = rows.withColumn("__bits", hash_bits(F.col(doc))).withColumn("__name", F.explode(names))
        return named.join(places.withColumnRenamed("bucket", "__name"), "__name")

    # how many more bits a bucket needs, by the rows that it has now: only their documents are read
    narrow = [placed(rows.select(doc), touched.select("bucket")).groupBy("__name").agg(F.count(F.lit(1)).alias("n")) for rows in (chunks, kept) if rows is not None]
    more = F.ceil(F.greatest(F.lit(0.0), F.log2(F.sum("n") / F.lit(bucket_rows)))).cast("int")
    sizes = written(reduce(DataFrame.unionByName, narrow).groupBy(F.col("__name").alias("bucket")).agg(more.alias("__more"), F.sum("n").alias("n")), "sizes")
    made_here.append(sizes)
    rows, fresh = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], chunks.count()
    in_bucket = F.expr("concat('b', substring(__bits, 1, length(__name) + __more))")
    folder = f"data-{uuid.uuid4().hex}"
    made = touched.where("false").select("bucket", F.lit(0).cast("long").alias("n"))
    if rows:
        parts = []
        if fresh:
            # a large bucket is written by several tasks, and a task writes few buckets; what is kept lies in its bucket already
            tasks = min(-(-fresh // FEW_ROWS), max(MANY_TASKS, -(-fresh // TASK_ROWS)))
            new = finish(dealt(chunks, tasks, doc) if deal else chunks)
            parts.append(placed(new, sizes.drop("n")))
        if kept is not None:
            parts.append(placed(kept, sizes.drop("n")))
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("__bucket", in_bucket)
        whole.drop("__bits", "__more", "__name").write.option("compression", "zstd").partitionBy("__bucket").parquet(f"{path}/{folder}")
        made = spark.read.parquet(f"{path}/{folder}").groupBy(F.substring("__bucket", 2, BITS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    made = written(made, "made")
    # what is left without rows stays as an empty bucket, so that later documents find a name
    empty = touched.join(made.select(F.col("bucket").alias("__made")), F.col("__made").startswith(F.col("bucket")), "left_anti")
    new = made.select("bucket", F.lit(folder).alias("folder"), "n").unionByName(empty.select("bucket", F.lit(None).cast("string").alias("folder"), F.lit(0).cast("long").alias("n")))
    new = new.unionByName(_missing(spark, made, touched))
    if buckets is not None:
        new = new.unionByName(buckets.join(touched.select("bucket"), "bucket", "left_anti").select("bucket", "folder", "n"))
    new = new.select(F.lit(version + 1).cast("long").alias("version"), "bucket", "folder", "n")
    new = written(new, "manifest")
    new.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    for table in (*made_here, made, new):
        remove(spark, table.table_path)
    return read_documents(spark, path, version + 1), version + 1
