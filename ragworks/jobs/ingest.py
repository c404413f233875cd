"""Contracts taken in, and deleted, as one job: pages to chunks, features, vectors and the term index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragworks.functions.features import enrich
from ragworks.operators.index import embed, hashing_encoder
from ragworks.operators.structure import contract_chunks
from ragworks.operators.term_index import add_documents, read_index, remove_documents, segments
from ragworks.sources import buckets, io


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat_ws("/", F.col("doc_id").cast("string"), "chunk_id").alias("chunk_key"), "page_content", "doc_id")


def ingest_contracts(pages: DataFrame, path: str, make_encoder: Callable = hashing_encoder, bucket_rows: int = buckets.BUCKET_ROWS, embedder: Callable = embed) -> dict[str, DataFrame]:
    """pages(doc_id, page_number, text, tables) -> the tables under path: chunks, and those of the term index.

    Chunks of three layers get features and a vector. They replace what the
    table and the index had of their documents (those without a chunk are
    deleted); only the buckets of these documents are written anew, and the
    index gets one more segment. Running it again with the same pages changes
    nothing. The index names the version of the chunks that it belongs to, so
    a run that fails leaves the tables as they were. embedder(chunks,
    make_encoder) gives the vectors: `embed`, or `lanes.embed_in_lanes` with
    its store where an encoder has a quota.
    """
    spark = pages.sparkSession
    ids = io.written(pages.select("doc_id").distinct(), "ids")
    chunks = contract_chunks(pages)
    if embedder is embed:  # features and vectors are columns of a row, and made where it is written
        chunks, finish = io.written(chunks, "chunks"), lambda rows: embed(enrich(rows), make_encoder)
    else:
        chunks, finish = io.written(embedder(chunks, make_encoder), "chunks"), enrich
    base = _version(spark, path)
    old = buckets.documents_of(spark, f"{path}/chunks", ids, version=base)
    table, version = buckets.replace_documents(chunks, f"{path}/chunks", ids, bucket_rows=bucket_rows, base=base, finish=finish)
    index = add_documents(_keyed(chunks), f"{path}/index", doc="doc_id", old=None if old is None else _keyed(old), note=str(version))
    for made in (ids, chunks):
        io.remove(spark, made.table_path)
    return {"chunks": table, **index}


def _version(spark: SparkSession, path: str) -> int:
    """The version of the chunks that the index belongs to; 0 without any."""
    return int(segments(spark, f"{path}/index")[2] or 0)


def delete_contracts(ids: DataFrame, path: str) -> dict[str, DataFrame]:
    """The tables under path without the documents of ids(doc_id); documents that are not there change nothing."""
    spark = ids.sparkSession
    base = _version(spark, path)
    ids = io.written(ids.select("doc_id").distinct(), "ids")
    old = buckets.documents_of(spark, f"{path}/chunks", ids, version=base)
    if old is None:
        return read_contracts(spark, path)
    table, version = buckets.replace_documents(old.where("false"), f"{path}/chunks", ids, base=base)
    index = remove_documents(_keyed(old), f"{path}/index", doc="doc_id", note=str(version))
    io.remove(spark, ids.table_path)
    return {"chunks": table, **index}


def read_contracts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"chunks": buckets.read_documents(spark, f"{path}/chunks", _version(spark, path)), **read_index(spark, f"{path}/index")}
