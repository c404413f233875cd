"""From retrieved chunks to answers, their log and their grades, for a whole table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.operators.evaluate import evaluate_answers, evaluate_run
from ragworks.operators.registry import append_query_log
from ragworks.operators.retrieve import answer_requests, build_context, source_list
from ragworks.sources.io import written

#: How a request (system prompt, question) becomes an answer: an expression, or a Pandas UDF that calls a model.
Answerer = Callable[[Column, Column], Column]


def answer_queries(queries: DataFrame, hits: DataFrame, system_prompt: str, answer: Answerer) -> DataFrame:
    """(query_id, query, response, sources: array of structs by rank) of queries(query_id, query) and what was retrieved for them.

    hits(query_id, rank, chunk_id, chunk_type, section_number, section,
    page_content, ...). system_prompt holds {context} once. Queries without
    hits get the fixed answer and no sources, and nothing is asked for them.
    """
    hits = written(hits, "hits")  # contexts and sources both come from it
    requests = answer_requests(queries, build_context(hits), system_prompt)
    response = F.when(F.col("system").isNotNull(), answer(F.col("system"), F.col("user"))).otherwise(F.col("answer"))
    answered = requests.select("query_id", response.alias("response")).join(queries.select("query_id", "query"), "query_id")
    cited = source_list(hits)
    cited = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in cited.columns if c != "query_id"]))).alias("sources"))  # MAX_CHUNKS at most
    return answered.join(cited, "query_id", "left").select("query_id", "query", "response", "sources")


def log_answers(logs: DataFrame, answers: DataFrame, asked_at: Column) -> DataFrame:
    """logs with a row for each of answers(query_id, query, response, sources)."""
    rows = answers.select("query_id", F.col("query").alias("query_text"), F.col("response").alias("response_text"), asked_at.alias("created_at"), F.explode_outer("sources").alias("source"))
    return append_query_log(logs, rows)


def evaluate_answered(run: DataFrame, answers: DataFrame, expected: DataFrame, judge: Answerer, experiment: str) -> DataFrame:
    """(experiment, metric, mean, n): retrieval metrics and the grades of judges over one evaluation set.

    run(query_id, chunk_id, rank, page_number), a table; answers as above;
    expected(query_id, expected, expected_chunk_id, sources: page numbers).
    """
    outputs = expected.select("query_id", "expected").join(answers, "query_id", "left")
    outputs = outputs.select("query_id", F.col("query").alias("question"), F.col("response").alias("answer"), "expected", F.transform("sources", lambda s: s["snippet"]).alias("sources"))
    return evaluate_run(run, expected, experiment).unionByName(evaluate_answers(outputs, judge, experiment))
