"""How well retrieval and answers do on an evaluation set."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.functions.text import clean_control

LIMITS = (10, 50, 100)
CUTS = (1, 3, 5, 10, 15, 20, 25)

#: What each judge is told, unless the caller has instructions of their own.
JUDGES = {
    "correctness": "Compare the answer with the reference answer. Reply true if all its facts agree with the reference, extra detail allowed, else false.",
    "relevance": "Reply true if the answer addresses the question briefly and helps with it, else false.",
    "groundedness": "Reply true if the given facts support everything that the answer states, else false.",
    "retrieval_relevance": "Reply true if some of the given facts bear on the question, else false.",
}


def _first_hit(run: DataFrame, expected: DataFrame) -> DataFrame:
    """expected with answered (has the query an output row?) and hit (first rank of the expected chunk).

    run(query_id, chunk_id, rank); a row with a null chunk_id is an output without chunks.
    """
    best = run.join(expected.select("query_id", "expected_chunk_id"), "query_id")
    best = best.groupBy("query_id").agg(F.min(F.when(F.col("chunk_id") == F.col("expected_chunk_id"), F.col("rank"))).alias("hit"), F.lit(True).alias("answered"))
    return expected.join(best, "query_id", "left")


def _no_target() -> Column:
    return F.coalesce(F.col("expected_chunk_id"), F.lit("")) == ""


def retrieval_recall(run: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, recall): false without an output, true without an expected chunk, else whether it was retrieved."""
    score = F.when(F.col("answered").isNull(), False).when(_no_target(), True).otherwise(F.col("hit").isNotNull())
    return _first_hit(run, expected).select("query_id", score.alias("recall"))


def reciprocal_rank(run: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rr): 0 without an output or a hit, 1 without an expected chunk, else 1 / first rank."""
    score = F.when(F.col("answered").isNull(), 0.0).when(_no_target(), 1.0).otherwise(F.coalesce(F.lit(1.0) / F.col("hit"), F.lit(0.0)))
    return _first_hit(run, expected).select("query_id", score.alias("rr"))


def limit_sweep(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(limit, k, mrr, recall): means over the queries of qrels, for every limit of the run and every cut-off.

    run(limit, query_id, doc_id, rank), qrels(query_id, doc_id). Each ranked
    row is scored once; the cut-offs are columns of one aggregation.
    """
    relevant = qrels.select("query_id", "doc_id").distinct()
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return _sweep(run, run.join(relevant, ["query_id", "doc_id"]), wanted, cuts)


def label_sweep(run: DataFrame, queries: DataFrame, docs: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """limit_sweep where the documents with a query's label are relevant: queries(query_id, label), docs(doc_id, label).

    Pairs of query and relevant document are never made: labels are counted, and rows of the run compared.
    """
    queries, docs = queries.where("label IS NOT NULL").distinct(), docs.where("label IS NOT NULL").distinct()
    wanted = queries.join(docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant")), "label").select("query_id", "n_relevant")
    return _sweep(run, run.join(queries, "query_id").join(docs, ["doc_id", "label"]), wanted, cuts)


def _sweep(run: DataFrame, relevant: DataFrame, wanted: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """relevant: the rows of the run that are; wanted(query_id, n_relevant)."""
    hits = relevant.groupBy("limit", "query_id")
    hits = hits.agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in cuts])
    limits = run.select("limit").distinct()
    grid = wanted.crossJoin(F.broadcast(limits)).join(hits, ["limit", "query_id"], "left")  # as many limits as the sweep has
    each = F.explode(
        F.array(*[
            F.struct(
                F.lit(k).alias("k"),
                F.when(F.col("first") <= k, F.lit(1.0) / F.col("first")).otherwise(0.0).alias("rr"),
                (F.coalesce(F.col(f"in_{k}"), F.lit(0)) / F.col("n_relevant")).alias("recall"),
            )
            for k in cuts
        ])
    )
    rows = grid.select("limit", each.alias("x")).select("limit", "x.*")
    return rows.groupBy("limit", "k").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"))


def page_hit(run: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, page_hit): is a retrieved chunk on an expected page? expected(query_id, sources: page numbers as text)."""
    pages = expected.select("query_id", F.explode("sources").alias("__page")).select("query_id", F.expr("try_cast(__page AS INT)").alias("page_number"))
    hit = run.join(pages, ["query_id", "page_number"], "left_semi").select("query_id").distinct().withColumn("page_hit", F.lit(True))
    return expected.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce("page_hit", F.lit(False)).alias("page_hit"))


def judge_requests(outputs: DataFrame, kind: str, instructions: dict[str, str] = JUDGES) -> DataFrame:
    """(query_id, kind, system, user, grade): a request for a judge; where answer or sources are missing none, and grade false.

    outputs(query_id, question, answer, expected, sources: array of snippets).
    """
    facts = F.concat(F.lit("FACTS: "), clean_control(F.array_join("sources", "\n\n")))
    question, answer = F.concat(F.lit("QUESTION: "), F.col("question")), F.concat(F.lit("STUDENT ANSWER: "), F.col("answer"))
    truth = F.concat(F.lit("GROUND TRUTH ANSWER: "), F.coalesce("expected", F.lit("")))
    parts = {"correctness": [question, truth, answer], "relevance": [question, answer], "groundedness": [facts, answer], "retrieval_relevance": [facts, question]}[kind]
    needs = {"correctness": ["answer"], "relevance": ["answer"], "groundedness": ["answer", "sources"], "retrieval_relevance": ["sources"]}[kind]
    ready = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needs])
    return outputs.select(
        "query_id", F.lit(kind).alias("kind"), F.when(ready, F.lit(instructions[kind])).alias("system"),
        F.when(ready, F.concat_ws("\n", *parts)).alias("user"), F.when(~ready, F.lit(False)).alias("grade"),
    )


#: The field of a verdict that holds its grade.
GRADE_FIELDS = {"correctness": "correct", "relevance": "relevant", "groundedness": "grounded", "retrieval_relevance": "relevant"}


def parse_grades(verdicts: DataFrame) -> DataFrame:
    """verdicts(..., kind, verdict: JSON text) with grade: true exactly where the grade field says true in any case."""
    fields = "correct string, relevant string, grounded string"
    parsed = F.from_json("verdict", fields)
    out = F
    for kind, field in GRADE_FIELDS.items():
        out = out.when(F.col("kind") == kind, parsed[field])
    return verdicts.withColumn("grade", F.coalesce(F.lower(out) == "true", F.lit(False)))


def experiment_summary(scores: DataFrame) -> DataFrame:
    """scores(experiment, metric, score) -> (experiment, metric, mean, n)."""
    return scores.groupBy("experiment", "metric").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))


def evaluate_run(run: DataFrame, expected: DataFrame, experiment: str) -> DataFrame:
    """(experiment, metric, mean, n) of a run: recall, reciprocal rank and page hits over an evaluation set.

    run(query_id, chunk_id, rank, page_number), a table; expected(query_id, expected_chunk_id, sources).
    """
    named = lambda df, column: df.select(F.lit(experiment).alias("experiment"), F.lit(column).alias("metric"), F.col(column).cast("double").alias("score"))
    ranks = reciprocal_rank(run, expected).withColumnRenamed("rr", "reciprocal_rank")
    scores = named(retrieval_recall(run, expected), "recall").unionByName(named(ranks, "reciprocal_rank")).unionByName(named(page_hit(run, expected), "page_hit"))
    return experiment_summary(scores)


def evaluate_answers(outputs: DataFrame, judge: Callable[[Column, Column], Column], experiment: str, kinds: tuple[str, ...] = tuple(JUDGES)) -> DataFrame:
    """(experiment, metric, mean, n) of the grades that judge(system, user) gives outputs as in judge_requests, by kind.

    Outputs that have nothing to judge count as false.
    """
    asked = reduce(DataFrame.unionByName, [judge_requests(outputs, kind) for kind in kinds])
    judged = parse_grades(asked.drop("grade").withColumn("verdict", F.when(F.col("user").isNotNull(), judge(F.col("system"), F.col("user")))))
    return experiment_summary(judged.select(F.lit(experiment).alias("experiment"), F.col("kind").alias("metric"), F.col("grade").cast("double").alias("score")))


def sample_chunks_for_eval(chunks: DataFrame, n: int = 15) -> DataFrame:
    """The first n chunks by key, with what a question writer needs: a report of fixed size."""
    return chunks.select("chunk_key", "page_content", "manual_id", "filename").orderBy("chunk_key").limit(n)


def synthetic_eval_rows(chunks: DataFrame, generated: DataFrame) -> DataFrame:
    """Evaluation rows of generated(chunk_key, question, answer); failed generations (a null in either) drop out."""
    good = generated.where("question IS NOT NULL AND answer IS NOT NULL")
    return good.join(chunks, "chunk_key").select(
        F.col("question").alias("input"), F.col("answer").alias("expected"), F.col("chunk_key").cast("string").alias("expected_chunk_id"), "manual_id", "filename"
    )
