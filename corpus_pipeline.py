"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's rows as Parquet and reads them again
for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragworks.llm import bpe, decontamination, line_dedup, simhash, toxicity
from ragworks.llm.common import documents, free_names, materialize, table
from ragworks.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine, fitted on the labelled rows, scores below the threshold."""
    model = spark.sparkContext.broadcast(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(toxicity.toxicity_score(F.col("text"), model) < toxicity.THRESHOLD)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that stand on too many pages of their site; n_chars follows a changed text."""
    found, dropped = free_names(docs, "n_lines", "n_dropped")
    out = line_dedup.line_dedup(docs, counts=(found, dropped))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, length).otherwise(F.col("n_chars"))).drop(found, dropped)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number, and the digest of the text decoded from them."""
    vocabulary = bpe.vocabulary_broadcast(spark, tokenizer_path())
    coded = bpe.round_trip(F.col("text"), vocabulary)
    return docs.select("doc_id", coded.alias("__coded")).select("doc_id", "__coded.n_tokens", "__coded.ids", "__coded.decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the machine's scores nor fingerprints nor merges; tests hold the near-duplicate stage against brute force, not run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
