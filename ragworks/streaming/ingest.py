"""Incremental ingestion: uploads in a stream of page files are admitted, chunked and indexed, each content once.

What a batch decides lies under a folder of its own (tables/uploads, admitted
and rejected ones; tables/status, what became of each), so running it again
replaces what it wrote. What later batches need is kept by key: tables/contents
by content hash and tables/chunks by upload, both in buckets that split, and
tables/index, the term index in segments. A batch opens the buckets of its own
uploads alone, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragworks.operators.index import embed, hashing_encoder
from ragworks.operators.registry import admit_uploads, apply_status
from ragworks.operators.structure import policy_chunks
from ragworks.operators.term_index import add_documents, read_index, segments
from ragworks.sources import buckets
from ragworks.sources.io import remove, written

PAGE_FILES = "doc_id BIGINT, file_hash STRING, filename STRING, page_number INT, text STRING"
NO_TEXT = "no text found"
#: Characters kept of an error.
ERROR_CHARS = 4_000


def ingest_batch(batch: DataFrame, batch_id: int, tables: str, make_encoder: Callable = hashing_encoder) -> None:
    """Admit, chunk and embed one batch of pages.

    Contents that are indexed are rejected; an upload whose
    indexing failed may come again. Uploads without a hash are never rejected.
    One without text fails; if the batch itself fails, in the encoder or
    elsewhere, its uploads fail with the error's text and the stream goes on.
    An upload that comes with several contents in one batch has the last one,
    by the time and name of its file (file_time, file_name, where batch has them).
    """
    spark = batch.sparkSession
    arrived = F.struct(*[c for c in ("file_time", "file_name") if c in batch.columns], F.col("file_hash").isNotNull().alias("hashed"), "file_hash", "filename")
    last = batch.groupBy(F.col("doc_id").alias("upload_id")).agg(F.max(arrived).alias("last"))
    uploads = last.select("upload_id", "last.file_hash", "last.filename")
    hashes = uploads.where("file_hash IS NOT NULL").select("file_hash").distinct()
    known = buckets.documents_of(spark, f"{tables}/contents", hashes, "file_hash")
    taken = hashes.where("false") if known is None else known.where(F.col("status") != "failed").where(F.col("batch_id") != batch_id).select("file_hash")
    accepted, rejected = admit_uploads(uploads, taken)
    both = accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected, allowMissingColumns=True)
    both.write.mode("overwrite").parquet(f"{tables}/uploads/batch_id={batch_id}")
    admitted = spark.read.parquet(f"{tables}/uploads/batch_id={batch_id}").where("reason IS NULL")
    admitted = admitted.select(F.col("upload_id").alias("id"), "policy_name", F.col("file_hash").alias("content"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("file_hash").eqNullSafe(F.col("content"))
    pages = batch.drop("file_time", "file_name").join(admitted, same).drop("id", "content")
    chunks, error = f"{tables}/staged/batch_id={batch_id}", F.lit(None).cast("string")
    # dealt before there are chunks and vectors: what is staged lies as buckets do, and is not shuffled again
    pages = buckets.dealt(pages, max(1, batch.rdd.getNumPartitions()))
    embedded = embed(policy_chunks(pages), make_encoder)
    try:
        embedded.write.mode("overwrite").option("compression", "zstd").parquet(chunks)
        indexed = spark.read.parquet(chunks).select(F.col("doc_id").alias("__indexed")).distinct()
        done = admitted.join(indexed, F.col("id").eqNullSafe(F.col("__indexed")), "left")
        status = F.when(F.col("__indexed").isNotNull() | F.col("id").isNull(), "active").otherwise("failed")
        error = F.when(status == "failed", NO_TEXT)
    except Exception as failure:  # as the service does: the error is kept with the upload
        spark.createDataFrame([], embedded.schema).write.mode("overwrite").parquet(chunks)
        done, status, error = admitted, F.lit("failed"), F.lit(str(failure)[:ERROR_CHARS])
    events = done.select("id", status.alias("status"), error.alias("error"), F.current_timestamp().alias("ts"), F.lit(batch_id).alias("event_id"))
    _index(spark.read.parquet(chunks), admitted.select(F.col("id").alias("doc_id")), tables)
    events.write.mode("overwrite").parquet(f"{tables}/status/batch_id={batch_id}")
    ended = spark.read.parquet(f"{tables}/status/batch_id={batch_id}").select("id", "status")
    state = admitted.where("content IS NOT NULL").join(ended, "id").select(F.col("content").alias("file_hash"), F.col("id").alias("upload_id"), "status", F.lit(batch_id).cast("long").alias("batch_id"))
    buckets.replace_documents(state, f"{tables}/contents", doc="file_hash")
    remove(spark, chunks)


def _index(chunks: DataFrame, ids: DataFrame, tables: str) -> None:
    """Put the chunks of the uploads `ids` in place of their old ones, in the chunk table and in the term index."""
    spark = chunks.sparkSession
    base = int(segments(spark, f"{tables}/index")[2] or 0)
    ids = written(ids, "ids")
    old = buckets.documents_of(spark, f"{tables}/chunks", ids, version=base)
    _, version = buckets.replace_documents(chunks, f"{tables}/chunks", ids, base=base, deal=False)
    add_documents(_keyed(chunks), f"{tables}/index", doc="doc_id", old=None if old is None else _keyed(old), note=str(version))
    remove(spark, ids.table_path)


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_key", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page_number").cast("string"), F.col("piece").cast("string")))


def current_uploads(spark: SparkSession, tables: str) -> DataFrame:
    """Admitted uploads with their last status and its error; those of a batch that has not ended are indexing."""
    uploads = spark.read.parquet(f"{tables}/uploads").where("reason IS NULL")
    last = uploads.groupBy(F.col("upload_id").alias("id")).agg(F.max_by(F.struct("file_hash", "filename", "policy_name", "status"), "batch_id").alias("u"), F.max("batch_id").alias("batch_id"))
    events = spark.read.parquet(f"{tables}/status").drop("batch_id")
    return apply_status(last.select("id", "u.*", "batch_id"), events)


def current_chunks(spark: SparkSession, tables: str) -> DataFrame:
    """Chunks of the uploads whose last content is active: a new content of an upload replaces the old one, one that failed leaves none."""
    return buckets.read_documents(spark, f"{tables}/chunks", int(segments(spark, f"{tables}/index")[2] or 0))


def search_tables(spark: SparkSession, tables: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(chunks, term index) for policy_retrieve: chunks have chunk_key, and manual_id, their upload."""
    chunks = _keyed(current_chunks(spark, tables)).withColumn("manual_id", F.col("doc_id"))
    return chunks, read_index(spark, f"{tables}/index")


def ingest_stream(spark: SparkSession, source: str, tables: str, checkpoint: str, make_encoder: Callable = hashing_encoder, files_per_batch: int = 1000) -> StreamingQuery:
    """Take in what lies in source (JSON lines of pages) and was not taken before, then stop; safe to start again."""
    pages = spark.readStream.schema(PAGE_FILES).option("maxFilesPerTrigger", files_per_batch).json(source)
    pages = pages.select("*", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_name").alias("file_name"))
    writer = pages.writeStream.foreachBatch(lambda batch, i: ingest_batch(batch, i, tables, make_encoder))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
