"""The registry of manuals, and logs with feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragworks.functions.text import normalize_policy_name
from ragworks.operators.index import delete_document
from ragworks.operators.structure import policy_chunks


def admit_uploads(incoming: DataFrame, manuals: DataFrame, contract: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of incoming(upload_id, file_hash, filename, ...).

    Rejected with a reason: content that manuals has, a second upload of one
    content in the batch (the smallest upload_id wins), and for contracts
    names that do not end in .pdf.
    """
    known = manuals.select(F.col("file_hash").alias("__hash")).distinct()
    named = F.coalesce(F.lower("filename").endswith(".pdf"), F.lit(False)) if contract else F.lit(True)
    # the first upload of each content is found on the map side; rows without a hash take no part
    first = incoming.where(named & F.col("file_hash").isNotNull()).groupBy(F.col("file_hash").alias("__content")).agg(F.min("upload_id").alias("__first"))
    rows = incoming.join(known, F.col("file_hash") == F.col("__hash"), "left").join(first, F.col("file_hash") == F.col("__content"), "left")
    # an upload may be listed twice; only rows of one upload are in a group here
    twin = F.row_number().over(Window.partitionBy("file_hash", "upload_id", named).orderBy("filename")) > 1
    again = named & F.col("file_hash").isNotNull() & (~F.col("upload_id").eqNullSafe(F.col("__first")) | twin)
    reason = F.when(~named, "not a pdf").when(F.col("__hash").isNotNull() | again, "already indexed")
    rows = rows.withColumn("reason", reason).drop("__hash", "__content", "__first")
    accepted = rows.where("reason IS NULL").drop("reason").withColumn("policy_name", normalize_policy_name(F.col("filename")))
    return accepted.withColumn("status", F.lit("queued" if contract else "indexing")), rows.where("reason IS NOT NULL")


def apply_status(manuals: DataFrame, events: DataFrame) -> DataFrame:
    """manuals with the last status (and its error) of events(id, status, error, ts, event_id); those without an event keep theirs."""
    last = F.struct("ts", "event_id")
    new = events.groupBy("id").agg(F.max_by(F.struct("status", "error"), last).alias("__new"))
    old = F.col("error") if "error" in manuals.columns else F.lit(None).cast("string")
    out = manuals.join(new, "id", "left")
    return out.withColumn("error", F.when(F.col("__new").isNotNull(), F.col("__new.error")).otherwise(old)).withColumn("status", F.coalesce("__new.status", "status")).drop("__new")


def list_manuals(manuals: DataFrame) -> DataFrame:
    """All manuals, newest first, ties by id."""
    return manuals.orderBy(F.desc("created_at"), "id")


def stored_name(manuals: DataFrame) -> DataFrame:
    return manuals.withColumn("__name", F.concat_ws("_", F.col("id").cast("string"), F.col("filename")))


def reconcile_stale(manuals: DataFrame, files: DataFrame) -> DataFrame:
    """manuals without those still indexing, or failed, whose stored file files(name) has not."""
    names = files.select(F.col("name").alias("__name")).distinct()
    stale = stored_name(manuals).where(F.col("status").isin("indexing", "failed")).join(names, "__name", "left_anti").select(F.col("id").alias("__stale"))
    return manuals.join(stale, F.col("id") == F.col("__stale"), "left_anti")


def reindex_plan(manuals: DataFrame, files: DataFrame) -> DataFrame:
    """Manuals whose file exists, with the policy name made anew and status active: what is to be chunked again."""
    names = files.select(F.col("name").alias("__name")).distinct()
    found = stored_name(manuals).join(names, "__name", "left_semi").drop("__name")
    return found.withColumn("policy_name", normalize_policy_name(F.col("filename"))).withColumn("status", F.lit("active"))


def reindex(manuals: DataFrame, files: DataFrame, pages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manuals, chunks) after all manuals whose file exists were chunked again.

    pages(manual_id, page_number, text, ...), chunks(manual_id, ...). Old
    chunks of these manuals go, new ones take their place, and the manuals get
    their policy name anew and are active. Others stay as they are.
    """
    plan = reindex_plan(manuals, files)
    named = plan.select(F.col("id").alias("manual_id"), "policy_name")
    made = policy_chunks(pages.drop("policy_name").join(named, "manual_id"))
    left = delete_document(chunks, named.select("manual_id"))
    rest = manuals.join(plan.select(F.col("id").alias("__done")), F.col("id") == F.col("__done"), "left_anti")
    return rest.unionByName(plan, allowMissingColumns=True), left.unionByName(made, allowMissingColumns=True)


def apply_feedback(logs: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs with the last feedback, rejected rows): feedback(log_id, value, ts, event_id) on ids that logs has not is rejected."""
    valid = feedback.where(F.col("value").isin(1, -1))
    last = valid.groupBy("log_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("__value"))
    out = logs.join(last, logs["id"] == last["log_id"], "left")
    out = out.withColumn("feedback", F.coalesce(F.col("__value").cast("int"), F.col("feedback"))).drop("__value", "log_id")
    return out, feedback.join(logs.select(F.col("id").alias("__id")), F.col("log_id") == F.col("__id"), "left_anti")


def list_documents(uploads: DataFrame, index: DataFrame) -> DataFrame:
    """uploads(doc_id, filename, status, error), or, without any, one row for an index that has chunks."""
    count = index.agg(F.count(F.lit(1)).alias("n_chunks"))
    none = uploads.agg(F.count(F.lit(1)).alias("__uploads"))
    lone = count.crossJoin(none).where("__uploads = 0 AND n_chunks > 0")  # one row each
    lone = lone.select(F.lit("pre-indexed").alias("doc_id"), F.lit(None).cast("string").alias("filename"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("error"), "n_chunks")
    return uploads.select(F.col("doc_id").cast("string").alias("doc_id"), "filename", "status", "error", F.lit(None).cast("long").alias("n_chunks")).unionByName(lone)


def append_query_log(logs: DataFrame, answers: DataFrame) -> DataFrame:
    """logs and, for answers(query_id, query_text, response_text, created_at, source: struct or null), a row a query with its sources as JSON."""
    rows = answers.groupBy("query_id").agg(
        F.first("query_text").alias("query_text"), F.first("response_text").alias("response_text"),
        F.to_json(F.array_sort(F.collect_list("source"))).alias("sources_used"), F.max("created_at").alias("created_at"),
    )
    rows = rows.select(F.col("query_id").alias("id"), "query_text", "response_text", "sources_used", F.lit(None).cast("int").alias("feedback"), "created_at")
    return logs.unionByName(rows, allowMissingColumns=True)
