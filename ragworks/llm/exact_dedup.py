"""Exact dedup by deterministic block naming.

Level 0 names every distinct block of BLOCK_BYTES bytes by its place in sorted
order. Each further level names the distinct pairs of adjacent names, again
by their places in sorted order, until a document has one name; two documents
of as many blocks are equal exactly if their last names are. Blocks are
sorted by a hash and, where several share one, by content, so no name stands
for two contents, and names are the same at any partitioning. Texts cross the
network once (distinct blocks, combined on the map side); everything else
moves hashes and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragworks.llm.common import discard, materialize

BLOCK_BYTES = 1_024


def _cut(body: Column, size: int) -> Column:
    """The blocks of a binary column; an empty one is one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / F.lit(size)).cast("int"))
    # the body is bound by the outer transform, so that its bytes are made once and not for each block
    whole = F.transform(F.array(body), lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * size + 1, F.lit(size))))
    return F.get(whole, 0)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(doc_id, sha, width, pos, block, h): width is the number of the document's blocks."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    cut = docs.select("doc_id", F.unhex(F.sha2(body, 256)).alias("sha"), _cut(body, block_bytes).alias("blocks"))
    cut = cut.select("doc_id", "sha", F.size("blocks").alias("width"), F.posexplode("blocks").alias("pos", "block"))
    return cut.withColumn("h", F.xxhash64("block"))


def ranked(keys: DataFrame) -> DataFrame:
    """A table of keys, which are distinct, with `name`: the place of each in the order of all, from 0."""
    columns = keys.columns
    in_order = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = materialize(in_order.select(*columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "placed")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as partitions: bounded for the window and for the broadcast
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    names = materialize(placed.join(F.broadcast(before), "part").select(*columns, (F.col("before") + F.col("at")).alias("name")), "names")
    discard(placed)
    return names


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, sha, n, width, pos, name) of every block."""
    counted = blocks.select("h", "block").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    names = ranked(counted.select("h", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("sub")))
    rows = blocks.withColumn("sub", F.lit(0))
    shared = names.where("sub > 0").select("h").distinct()
    if not shared.isEmpty():  # different blocks with one hash: told apart by their places in sorted order
        order = Window.partitionBy("h").orderBy("block")
        places = blocks.join(shared, "h", "left_semi").select("h", "block").distinct().withColumn("place", F.row_number().over(order) - 1)
        rows = blocks.join(places, ["h", "block"], "left").withColumn("sub", F.coalesce("place", F.lit(0)))
    return rows.select("doc_id", "sha", "width", "pos", "h", "sub").join(names, ["h", "sub"]).select("doc_id", "sha", F.col("width").alias("n"), "width", "pos", "name")


def document_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, sha, n (blocks), name; equal (n, name) exactly for equal texts."""
    level = materialize(_name_blocks(_blocks(docs, block_bytes)), "level")
    first = level
    done = level.where("width = 1").select("doc_id", "sha", "n", "name")
    last: list[DataFrame] = []
    while not (open_ := level.where("width > 1")).isEmpty():
        # rows that repeat id and text become one here and are told apart again below
        pairs = open_.groupBy("doc_id", "sha", "n", "width", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = materialize(pairs, "pairs")
        names = ranked(pairs.select("left", "right").distinct())
        named = pairs.join(names, ["left", "right"]).select("doc_id", "sha", "n", F.ceil(F.col("width") / 2).cast("int").alias("width"), "pos", "name")
        named = materialize(named, "level")
        discard(pairs, names)
        level = named
        last.append(level.where("width = 1").select("doc_id", "sha", "n", "name"))
    if not last:
        return done
    several = last[0]
    for more in last[1:]:
        several = several.unionByName(more)
    several = several.select(F.col("doc_id").alias("id"), F.col("sha").alias("digest"), "name")
    heads = first.where("width > 1 AND pos = 0").select("doc_id", "sha", "n")
    back = heads.join(several, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("digest")))
    return done.unionByName(back.select("doc_id", "sha", "n", "name"))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of docs with its group: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the
    largest doc_id stays. Repeated rows are rows of their own: they count in
    group_size, and rows that repeat the largest doc_id are all kept. A null
    doc_id is never kept unless all of its group are null. An empty table
    gives an empty result; columns besides doc_id and text are not read.
    """
    rows = materialize(document_identities(docs, block_bytes), "identities")
    groups = materialize(
        rows.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups"
    )
    out = rows.join(groups, ["n", "name"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
