"""Reading and writing: raw files, parsed pages, indexes, feature exports and evaluation sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ragworks.functions.text import clean_control, first_filled, strip
from ragworks.operators.tables import md_table_to_grid
from ragworks.schemas import PARSER_RESULT

#: Files that one task writes where each has rows of one key.
FILES_PER_TASK = 500


def write_each(rows: DataFrame, key: str, path: str, form: str) -> None:
    """Each key's rows as a file of its own under path, FILES_PER_TASK files a task; tasks move their files into place themselves."""
    tasks = max(1, -(-rows.count() // FILES_PER_TASK))
    dealt = rows.repartition(tasks, key)
    dealt.write.partitionBy(key).format(form).option("mapreduce.fileoutputcommitter.algorithm.version", "2").save(path)


def _files(spark: SparkSession, names: str | None) -> DataFrameReader:
    """A reader of a path; with a pattern of names, of such files in all folders below, which executors list."""
    return spark.read if names is None else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names)


def read_raw_files(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """(path, content, file_hash): each file with the SHA-256 of its bytes as identity. names: a pattern of files anywhere below path."""
    return _files(spark, names).format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("file_hash"))


def read_pages_cache(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """Cached pages (file_hash, page_number, text, tables); a file that can't be read is a miss. names: a pattern of files anywhere below path."""
    schema = "page_number INT, text STRING, tables ARRAY<ARRAY<ARRAY<STRING>>>, _corrupt_record STRING"
    rows = _files(spark, names).schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("file_hash", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    return rows.where("_corrupt_record IS NULL AND page_number IS NOT NULL").select("file_hash", "page_number", "text", "tables")


def needs_parse(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content is not cached."""
    return files.join(cache.select("file_hash").distinct(), "file_hash", "left_anti")


def _md_blocks(md: Column) -> Column:
    """Runs of lines that begin with a bar, each as one text."""
    lines = F.split(md, r"\r\n|[\n\r]")
    marked = F.transform(lines, lambda x: F.when(strip(x).startswith("|"), x).otherwise(F.lit("\x00")))
    return F.filter(F.split(F.array_join(marked, "\n"), "\n?\x00\n?"), lambda b: strip(b) != "")


def parse_results_to_pages(results: DataFrame, json: str = "json") -> DataFrame:
    """results(doc_id, json) -> pages: the page's own number or its place, text else md, tables from items or from md."""
    pages = results.select("doc_id", F.posexplode(F.from_json(json, PARSER_RESULT)["pages"]).alias("at", "p"))
    source = lambda i: first_filled(i["value"], i["md"], F.lit(""))
    items = F.filter(F.coalesce("p.items", F.expr("CAST(array() AS array<struct<type:string,value:string,md:string>>)")), lambda i: F.lower(i["type"]) == "table")
    from_items = F.filter(F.transform(items, lambda i: md_table_to_grid(source(i))), lambda g: F.size(g) > 0)
    from_md = F.filter(F.transform(_md_blocks(F.coalesce("p.md", F.lit(""))), md_table_to_grid), lambda g: F.size(g) > 0)
    return pages.select(
        "doc_id",
        F.coalesce("p.page", F.col("at") + 1).alias("page_number"),
        F.coalesce(first_filled(F.col("p.text"), F.col("p.md")), F.lit("")).alias("text"),
        F.when(F.size(from_items) > 0, from_items).otherwise(from_md).alias("tables"),
    )


def page_text(pages: DataFrame) -> DataFrame:
    """pages(doc_id, at, markdown, text, content) -> (doc_id, page_number, text): first filled one, cleaned; blank pages go, numbers count all."""
    text = strip(clean_control(F.coalesce(first_filled(F.col("markdown"), F.col("text"), F.col("content")), F.lit(""))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return pages.select("doc_id", number.alias("page_number"), text.alias("text")).where(F.length("text") > 0)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def write_feature_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_eval_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_eval_set(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def new_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Only a session within one process may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-ragworks-")
    return f"{root.rstrip('/')}/ragworks-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: made once, whatever reads it, and of a size that the optimizer knows."""
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out
