"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ragworks.llm import bpe, decontamination, exact_dedup, language_id, license_scan, line_dedup, merkle, oracles, pii, simhash, spelling, suffix_dedup, topk, toxicity
from ragworks.llm.common import ASCII_LOWER, ASCII_UPPER, documents, held_out, table

#: The installed tokenizer file that op4 and the pipeline use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").where(~out)
    scored = toxicity.score_toxicity(docs, docs, labels)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 4, 2)
    got = language_id.identify_language(docs, docs.where(~out))
    return got.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.selectExpr("doc_id", "source", "text", "__n_lines AS n_lines", "__n_dropped AS n_dropped")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", ASCII_UPPER, ASCII_LOWER)
    tampered = merkle.digest(*[merkle.framed(lowered if c == "text" else F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    made = merkle.merkle_manifest(docs, carry={"tampered": F.when(chosen, tampered)})
    made = made.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors.where("vec_id % 100 = 0"), vectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_pii": op2_pii,
        "op3_licenses": op3_licenses,
        "op4_bpe": op4_bpe,
        "op5_toxicity": op5_toxicity,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_language": op7_language,
        "op8_simhash": op8_simhash,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_line_dedup": op10_line_dedup,
        "op11_merkle": op11_merkle,
        "op12_spelling": op12_spelling,
        "op13_topk": op13_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": oracles.DECONTAMINATION,
        "op2_pii": oracles.PII,
        "op3_licenses": oracles.LICENSES,
        "op6_exact_dedup": oracles.EXACT_DEDUP,
        "op10_line_dedup": oracles.LINE_DEDUP,
        "op11_merkle": oracles.MERKLE,
        "op12_spelling": oracles.SPELLING,
        "op13_topk": oracles.TOPK,
    }
