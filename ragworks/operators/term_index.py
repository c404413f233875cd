"""The sparse index as a table: segments of blocked postings that grow, shrink and merge with the documents.

Under one folder every ingest writes a segment, and a manifest lists those
that count. A segment has

* docs(at, key, doc, dl): its chunks, their documents and lengths,
* blocks(term, block, n, max_tf, min_dl, offsets, tfs, dls): the postings of a
  term among BLOCK chunks in one row, with what bounds their scores, written
  once by the task that gathered them,
* counts(term, df): how it changes the number of chunks with a term; chunks
  that it replaces count against it,
* gone(doc): documents whose chunks in earlier segments no longer count.

So an ingest reads and writes in proportion to its own documents, and what
they replace. A segment is merged with earlier ones of at most twice its
size, so that there are few of them and a posting is rewritten a logarithmic
number of times. One writer at a time; readers see the last manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragworks.operators.index import EPSILON, tokens
from ragworks.sources.io import exists, new_folder, remove, written

#: Chunks of one block of postings.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
#: Characters after which a block ends all the same (a task holds the words of one), and rows that a task hands on at once.
BLOCK_CHARS = 16_000_000
OUT_ROWS = 50_000
#: Numbers of blocks that a merge has moved as they are begin here.
WHOLE = 1 << 49
BLOCK_COLUMNS = ("term", "block", "n", "max_tf", "min_dl", "offsets", "tfs", "dls")
MANIFEST = "version long, seq long, segment string, n_docs long, n_tokens long, n_postings long, n_gone long, note string"


@dataclass(frozen=True)
class Segment:
    """A line of the manifest: n_docs and n_tokens are changes of the whole index, n_postings and n_gone sizes."""

    seq: int
    segment: str
    n_docs: int
    n_tokens: int
    n_postings: int
    n_gone: int


def segments(spark: SparkSession, path: str) -> tuple[int, list[Segment], str | None]:
    """(version, segments by age, note of the last ingest) of the index at path; version 0 without any."""
    if not exists(spark, f"{path}/manifest"):
        return 0, [], None
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    last = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("seq").collect()  # a logarithmic number
    return last[0]["version"], [Segment(*r[1:-1]) for r in last], last[0]["note"]


def _commit(spark: SparkSession, path: str, version: int, found: list[Segment], note: str | None) -> None:
    rows = [(version, s.seq, s.segment, s.n_docs, s.n_tokens, s.n_postings, s.n_gone, note) for s in found]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, found: list[Segment], name: str) -> DataFrame:
    parts = [_part(spark, f"{path}/{s.segment}", name).withColumn("seq", F.lit(s.seq).cast("long")) for s in found]
    return reduce(DataFrame.unionByName, parts)


def _part(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the segment in folder. Blocks of an ingest lie among its chunks, as they were gathered."""
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows.where("term IS NOT NULL").select(*BLOCK_COLUMNS) if name == "blocks" else rows


def _table(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _counted(chunks: DataFrame, text: str) -> DataFrame:
    return chunks.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _gathered(chunks: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """chunks(key, doc, tokens, size: characters) -> the rows of a segment: docs (term is null) and blocks (key is null), in one pass.

    A task numbers its chunks and gathers the postings of a block before they
    leave it, so that no posting is shuffled by itself. Numbers of a block run
    from its start; it ends with BLOCK chunks, or before with block_chars characters.
    """
    key = chunks.schema["key"].dataType.simpleString()
    names = "at long, key {}, doc string, dl int, term string, block long, n int, max_tf int, min_dl int, offsets array<int>, tfs array<int>, dls array<int>".format(key)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: pa.Schema | None = None
        block, held, lengths, n, chars = TaskContext.get().partitionId() << (33 - BLOCK_BITS), [], [], 0, 0

        def rows(**values: pa.Array) -> pa.RecordBatch:
            count = len(next(iter(values.values())))
            return pa.RecordBatch.from_arrays([values[f.name].cast(f.type) if f.name in values else pa.nulls(count, f.type) for f in columns], schema=columns)

        def postings() -> Iterator[pa.RecordBatch]:
            made = block_rows(pa.concat_arrays(held), np.concatenate(lengths), block)
            whole = rows(**made) if len(made["term"]) else None
            for i in range(0, 0 if whole is None else whole.num_rows, OUT_ROWS):
                yield whole.slice(i, OUT_ROWS)

        for batch in batches:
            if columns is None:
                ints = pa.list_(pa.int32())
                types = {"at": pa.int64(), "key": batch.schema.field("key").type, "doc": pa.string(), "dl": pa.int32(), "term": pa.string(), "block": pa.int64(), "n": pa.int32(), "max_tf": pa.int32(), "min_dl": pa.int32(), "offsets": ints, "tfs": ints, "dls": ints}
                columns = pa.schema(list(types.items()))
            sizes, i = batch.column("size").to_numpy(), 0
            while i < batch.num_rows:
                fit = int(np.searchsorted(chars + np.cumsum(sizes[i : i + BLOCK - n]), block_chars)) + 1
                part = batch.slice(i, min(fit, BLOCK - n, batch.num_rows - i))
                tokens = part.column("tokens")
                dl = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int32)
                yield rows(at=pa.array((block << BLOCK_BITS) + n + np.arange(part.num_rows)), key=part.column("key"), doc=part.column("doc"), dl=pa.array(dl))
                held.append(tokens.flatten())
                lengths.append(dl)
                n, chars, i = n + part.num_rows, chars + int(sizes[i : i + part.num_rows].sum()), i + part.num_rows
                if n == BLOCK or chars >= block_chars:
                    yield from postings()
                    block, held, lengths, n, chars = block + 1, [], [], 0, 0
        if held:
            yield from postings()

    return chunks.mapInArrow(gather, names)


def block_rows(tokens: pa.Array, lengths: np.ndarray, block: int) -> dict[str, pa.Array]:
    """The columns of the rows of one block; tokens of its chunks one behind the other, lengths of them by chunk."""
    found = tokens.dictionary_encode()
    keyed = (found.indices.to_numpy().astype(np.int64) << BLOCK_BITS) | np.repeat(np.arange(len(lengths)), lengths)
    keyed, tf = np.unique(keyed, return_counts=True)
    code, offset = keyed >> BLOCK_BITS, (keyed & (BLOCK - 1)).astype(np.int32)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    ends, tf, dl = np.append(first, len(code)).astype(np.int32), tf.astype(np.int32), lengths[offset].astype(np.int32)
    lists = {"offsets": offset, "tfs": tf, "dls": dl}
    some = len(first) > 0
    return {
        "term": found.dictionary.take(pa.array(code[first])), "block": pa.array(np.full(len(first), block, np.int64)), "n": pa.array(np.diff(ends)),
        "max_tf": pa.array(np.maximum.reduceat(tf, first) if some else tf), "min_dl": pa.array(np.minimum.reduceat(dl, first) if some else dl),
        **{name: pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for name, values in lists.items()},
    }


def _blocks(rows: DataFrame) -> DataFrame:
    """rows(term, block, p: array<struct(offset, tf, dl)>) -> blocks."""
    part = lambda name: F.transform("p", lambda p: p[name])
    return rows.select("term", "block", F.size("p").alias("n"), F.array_max(part("tf")).alias("max_tf"), F.array_min(part("dl")).alias("min_dl"), part("offset").alias("offsets"), part("tf").alias("tfs"), part("dl").alias("dls"))


def _write(docs: DataFrame, less: DataFrame | None, folder: str) -> int:
    """Write the rest of a segment whose blocks are written; its number of postings. less: counts (term, df, negative) of what it replaces."""
    docs.write.parquet(f"{folder}/docs")
    sizes = _part(docs.sparkSession, folder, "blocks").select("term", F.col("n").cast("long").alias("df"))
    counts = (sizes if less is None else sizes.unionByName(less)).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    counts.write.parquet(f"{folder}/counts")
    return sizes.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]


def add_documents(chunks: DataFrame, path: str, key: str = "chunk_key", text: str = "page_content", doc: str | None = None, old: DataFrame | None = None, note: str | None = None, merge: bool = True) -> dict[str, DataFrame]:
    """The index at path with the documents of chunks(key, text, doc), instead of what it had of them; read again.

    old has the chunks (with the same columns) that the index holds of these
    documents, and of others that go; its documents need not be in chunks.
    Without doc every chunk is its own document. chunks and old should be
    tables. note is kept with the manifest, such as the version of the chunk
    table that this index belongs to.
    """
    spark = chunks.sparkSession
    version, found, _ = segments(spark, path)
    folder = f"segment-{uuid.uuid4().hex}"
    owner = F.coalesce(F.col(doc or key).cast("string"), F.lit("")).alias("doc")
    # numbered once, then written: docs and postings use the same numbers. Postings stay where they were gathered
    gathered = _gathered(chunks.select(F.col(key).alias("key"), owner, tokens(F.col(text)).alias("tokens"), F.coalesce(F.length(text), F.lit(0)).alias("size")))
    gathered.write.option("compression", "zstd").parquet(f"{path}/{folder}/blocks")
    docs = spark.read.schema(gathered.schema).parquet(f"{path}/{folder}/blocks").where("term IS NULL").select("at", "key", "doc", "dl")
    total = F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))
    nobody = docs.where("false").select("doc")
    gone = None if old is None else _table(old.select(owner).distinct(), f"{path}/{folder}/replaced")
    # the index knows the lengths of what goes
    less = (0, 0) if old is None or not found else _live(spark, path, found).join(gone, "doc", "left_semi").agg(*total).first()
    if less[0] and less[0] == sum(s.n_docs for s in found):  # nothing that it has counts any longer, so it begins anew
        found, less, gone = [], (0, 0), None
    minus = None if gone is None else _counted(old, text).withColumn("df", -F.col("df"))
    size = _write(docs, minus, f"{path}/{folder}")
    new = spark.read.parquet(f"{path}/{folder}/docs").agg(*total).first()
    dead = _table(nobody if gone is None else gone, f"{path}/{folder}/gone").count()
    seq = max((s.seq for s in found), default=0) + 1
    found = [*found, Segment(seq, folder, new[0] - less[0], new[1] - less[1], size, dead)]
    _commit(spark, path, version + 1, found, note)
    if merge:
        merge_segments(spark, path)
    return read_index(spark, path, key)


def remove_documents(old: DataFrame, path: str, key: str = "chunk_key", text: str = "page_content", doc: str | None = None, note: str | None = None) -> dict[str, DataFrame]:
    """The index at path without the documents of old, which has all their chunks."""
    return add_documents(old.where("false"), path, key, text, doc, old, note)


def to_merge(found: list[Segment]) -> int:
    """How many of the newest segments become one: each earlier one that has at most twice the postings of those after it."""
    n, size = 1, found[-1].n_postings
    while n < len(found) and found[-1 - n].n_postings <= 2 * size:
        size += found[-1 - n].n_postings
        n += 1
    return n


def merge_segments(spark: SparkSession, path: str, everything: bool = False) -> None:
    """Write the newest segments anew as one, without the chunks that no longer count, if it is time to."""
    version, found, note = segments(spark, path)
    n = len(found) if everything else to_merge(found)
    if n < 2:
        return
    left, merged = found[:-n], found[-n:]
    folder = f"segment-{uuid.uuid4().hex}"
    every, live = _read(spark, path, merged, "docs"), _live(spark, path, merged)
    whole = _whole_blocks(every, live)
    at_new = F.when(F.col("block_new").isNull(), F.monotonically_increasing_id()).otherwise(F.shiftleft("block_new", BLOCK_BITS) + F.col("at").bitwiseAND(BLOCK - 1))
    number = F.shiftright("at", BLOCK_BITS).alias("block")
    docs = written(live.select("*", number).join(whole, ["seq", "block"], "left").withColumn("at_new", at_new), "renumbered")
    blocks, parts = _read(spark, path, merged, "blocks"), docs.where("block_new IS NULL")
    as_they_are = blocks.join(whole, ["seq", "block"]).withColumn("block", F.col("block_new")).select(*BLOCK_COLUMNS)
    anew = blocks.join(parts.select("seq", "block").distinct(), ["seq", "block"], "left_semi")
    as_they_are.unionByName(_renumbered(anew, every, parts)).write.option("compression", "zstd").parquet(f"{path}/{folder}/blocks")
    blocks = _part(spark, f"{path}/{folder}", "blocks")
    # counts of the merged segments are changes too: what they say beyond their live postings stays said
    before = _read(spark, path, merged, "counts").groupBy("term").agg(F.sum("df").alias("df"))
    before = written(before.unionByName(blocks.groupBy("term").agg((-F.sum("n")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "counts") if left else None
    gone = _read(spark, path, merged, "gone").select("doc").distinct()
    size = _write(docs.select(F.col("at_new").alias("at"), "key", "doc", "dl"), before, f"{path}/{folder}")
    dead = _table(gone if left else gone.where("false"), f"{path}/{folder}/gone").count()
    for table in (docs, whole):
        remove(spark, table.table_path)
    one = Segment(merged[-1].seq, folder, sum(s.n_docs for s in merged), sum(s.n_tokens for s in merged), size, dead)
    _commit(spark, path, version + 1, [*left, one], note)


def _whole_blocks(docs: DataFrame, live: DataFrame, least: int = BLOCK // 2) -> DataFrame:
    """(seq, block, block_new), a table: blocks that a merge moves as they are, as all of their chunks count and they are half full or more."""
    count = lambda rows, name: rows.groupBy("seq", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.count(F.lit(1)).alias(name), F.sum("dl").alias(f"{name}_tokens"))
    full = count(docs, "n").join(count(live, "left"), ["seq", "block"]).where("n = left").where((F.col("n") >= least) | (F.col("n_tokens") >= BLOCK_CHARS // 16))
    # beyond the numbers of chunks that are numbered anew
    return written(full.select("seq", "block", (F.lit(WHOLE) + F.monotonically_increasing_id()).alias("block_new")), "whole")


def _renumbered(blocks: DataFrame, docs: DataFrame, live: DataFrame) -> DataFrame:
    """blocks(seq, ...) by the numbers at_new of live(seq, at, at_new); postings of other chunks go.

    docs(seq, at) has all chunks of the blocks. Blocks move whole: each meets
    the new numbers of its chunks, by place, as their old ones run from its start.
    """
    place = F.col("at").bitwiseAND(BLOCK - 1).cast("int")
    moved = docs.select("seq", "at").join(live.select("seq", "at", "at_new"), ["seq", "at"], "left")
    moved = moved.groupBy("seq", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "at_new"))).alias("moved"))
    moved = moved.withColumn("moved", F.transform("moved", lambda m: m["at_new"]))
    new = F.transform(F.arrays_zip("offsets", "tfs", "dls"), lambda p: F.struct(F.get("moved", p["offsets"]).alias("at"), p["tfs"].alias("tf"), p["dls"].alias("dl")))
    rows = blocks.join(moved, ["seq", "block"]).select("term", F.filter(new, lambda p: p["at"].isNotNull()).alias("new"))
    number = lambda p: F.shiftright(p["at"], BLOCK_BITS)
    rows = rows.select("term", "new", F.explode(F.array_distinct(F.transform("new", number))).alias("block"))
    inside = F.transform(F.filter("new", lambda p: number(p) == F.col("block")), lambda p: F.struct(p["at"].bitwiseAND(BLOCK - 1).cast("int").alias("offset"), p["tf"].alias("tf"), p["dl"].alias("dl")))
    return _blocks(rows.select("term", "block", inside.alias("p")).groupBy("term", "block").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p")))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the segments that the last manifest does not list; for when nobody reads an earlier one."""
    kept = {s.segment for s in segments(spark, path)[1]}
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(there)]
    dropped = sorted(n for n in names if n.startswith("segment-") and n not in kept)
    for name in dropped:
        remove(spark, f"{path}/{name}")
    return dropped


def _live(spark: SparkSession, path: str, found: list[Segment]) -> DataFrame:
    """The chunks of these segments that no later one of them has replaced."""
    docs = _read(spark, path, found, "docs")
    if not any(s.n_gone for s in found[1:]):
        return docs
    last = _read(spark, path, found, "gone").groupBy("doc").agg(F.max("seq").alias("__gone")).withColumnRenamed("doc", "__doc")
    return docs.join(last, (F.col("doc") == F.col("__doc")) & (F.col("seq") < F.col("__gone")), "left_anti")


def explode_blocks(blocks: DataFrame, *more: str, wanted: Column | None = None) -> DataFrame:
    """(seq, term, at, tf, dl) and more columns, a row a posting; wanted: the offsets (array) that count, of others no row is made."""
    zipped = F.arrays_zip("offsets", "tfs", "dls")
    if wanted is not None:
        zipped = F.filter(zipped, lambda p: F.array_contains(wanted, p["offsets"]))
    at = (F.shiftleft("block", BLOCK_BITS) + F.col("__p.offsets")).alias("at")
    return blocks.select("seq", "term", "block", *more, F.explode(zipped).alias("__p")).select("seq", "term", *more, at, F.col("__p.tfs").alias("tf"), F.col("__p.dls").alias("dl"))


def read_index(spark: SparkSession, path: str, key: str = "chunk_key", epsilon: float = EPSILON) -> dict[str, DataFrame]:
    """The tables of the index: live docs (seq, at, key, doc, dl), blocks, and, put together from the segments:

    doc_stats (key, dl), postings (term, key, tf), corpus_stats (n_docs,
    avgdl), term_stats (term, df, idf), where idf is
    ln((n - df + 0.5) / (df + 0.5)) and negative ones become epsilon times the
    mean. Nothing of this is stored, so it is right after any ingest.
    """
    _, found, _ = segments(spark, path)
    docs, blocks = _live(spark, path, found).withColumnRenamed("key", key), _read(spark, path, found, "blocks")
    n, length = sum(s.n_docs for s in found), sum(s.n_tokens for s in found)
    corpus = spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(length / n if n else None).cast("double").alias("avgdl"))
    counts = _read(spark, path, found, "counts").drop("seq")
    if len(found) > 1:
        counts = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    raw = counts.withColumn("raw", F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # summed as decimals: the same whatever the order of the terms
    mean = F.broadcast(raw.agg(F.try_divide(F.sum(F.col("raw").cast("decimal(38,18)")).cast("double"), F.count("raw")).alias("mean")))  # one row
    terms = raw.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    postings = explode_blocks(blocks).drop("dl").join(docs.select("seq", "at", key), ["seq", "at"]).select("term", key, "tf")
    return {"docs": docs, "blocks": blocks, "doc_stats": docs.select(key, "dl"), "postings": postings, "term_stats": terms, "corpus_stats": corpus}


def posting_counts(spark: SparkSession, path: str) -> DataFrame:
    """(n_postings, n_tokens) of the index at path, in one row; single postings are looked at only where chunks were replaced."""
    found = segments(spark, path)[1]
    if any(s.n_gone for s in found[1:]):
        rows = read_index(spark, path)["postings"].select(F.lit(1).alias("n"), "tf")
    else:
        rows = _read(spark, path, found, "blocks").select("n", F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("tf"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_postings"), F.sum("tf").alias("n_tokens"))


def build_term_index(chunks: DataFrame, path: str | None = None, key: str = "chunk_key", text: str = "page_content") -> dict[str, DataFrame]:
    """An index of one segment under path, or in a new folder, read again."""
    return add_documents(chunks, path or new_folder(chunks.sparkSession), key, text)
