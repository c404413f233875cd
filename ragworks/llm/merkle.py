"""Merkle manifest of a dataset: a tree of digests for each group of rows, one over their roots, and a proof for every row.

Leaves are sorted by range into an RDD, so that a large group spans several
partitions. One pass counts, in every partition, the rows of its first and
its last group: two counts a partition are all that the driver sees, and the
sums of the counts before give each partition the places of its leaves. A
second pass builds all subtrees whose leaves lie in one partition. The nodes
on ragged borders (at most 2 * 15 a level and partition) are shuffled by
their coordinate, and the upper levels are finished by grouping, 16 nodes a
group. Paths then go down from the root to the borders, and one join adds
them to what the partitions know themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragworks.llm.common import discard, materialize

FANOUT = 16
#: Leaves of one range partition, which a task holds (some 200 bytes each).
ROWS_A_PARTITION = 250_000
#: Leaves for which it is worth starting one more task.
ROWS_A_TASK = 5_000

STEPS = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings behind each other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value so that several can stand behind each other: `-` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _width(level: Column | int) -> Column:
    """Nodes of a tree of `total` leaves at a level."""
    return F.ceil(F.col("total") / F.pow(F.lit(float(FANOUT)), F.lit(level) if isinstance(level, int) else level))


def _ends(part: int, rows: Iterator) -> Iterator[tuple]:
    """(part, first tree, its leaves, last tree, its leaves) of one partition in order."""
    first = last = None
    for tree, run in groupby(rows, key=lambda r: r[0]):
        last = (tree, sum(1 for _ in run))
        first = first or last
    if first:
        yield (part, *first, *last)


def places(ends: list[tuple]) -> tuple[dict[int, dict[str, tuple[int, int]]], int]:
    """({part: {tree: (leaves before, leaves in all)}} for the first and last tree of each part, the most leaves of a tree that spans parts)."""
    total: dict[str, int] = {}
    known: dict[int, dict[str, tuple[int, int]]] = {}
    spread: dict[str, int] = {}
    for part, first, n, last, m in sorted(ends):
        for tree, count in dict([(first, n), (last, m)]).items():
            known.setdefault(part, {})[tree] = (total.get(tree, 0), count)
            total[tree] = total.get(tree, 0) + count
            spread[tree] = spread.get(tree, 0) + 1
    most = max((total[t] for t, k in spread.items() if k > 1), default=0)
    return {part: {t: (before, total[t]) for t, (before, _) in trees.items()} for part, trees in known.items()}, most


def build(start: int, total: int, nodes: list[str]) -> list[tuple[int, list[str]]]:
    """The levels (index of the first node, nodes) that leaves start, start + 1, ... of a tree of `total` decide alone."""
    levels, first, width = [(start, nodes)], start, total
    while width > 1:
        end = first + len(nodes)
        low, high = -(-first // FANOUT), -(-end // FANOUT) if end == width else end // FANOUT
        if high <= low:
            break
        nodes = [sha256("".join(nodes[max(0, j * FANOUT - first) : (j + 1) * FANOUT - first]).encode()).hexdigest() for j in range(low, high)]
        first, width = low, -(-width // FANOUT)
        levels.append((first, nodes))
    return levels


def families(start: int, total: int, leaves: list[tuple[str, tuple]]) -> Iterator[tuple]:
    """(level, index and digest of the highest local node, leaves below one parent, steps from that parent up to the node)."""
    levels = build(start, total, [node for node, _ in leaves])

    def parent(level: int, index: int) -> bool:
        return level + 1 < len(levels) and levels[level + 1][0] <= index // FANOUT < levels[level + 1][0] + len(levels[level + 1][1])

    at = 0
    while at < len(leaves):
        index, steps = start + at, []
        if not parent(0, index):
            yield 0, index, leaves[at][0], [leaves[at]], steps
            at += 1
            continue
        own = leaves[at : at + FANOUT - index % FANOUT]
        at, level, index = at + len(own), 1, index // FANOUT
        while parent(level, index):
            first, nodes = levels[level]
            low = index // FANOUT * FANOUT - first
            steps.append(("".join(nodes[low : index - first]), "".join(nodes[index - first + 1 : low + FANOUT])))
            level, index = level + 1, index // FANOUT
        yield level, index, levels[level][1][index - levels[level][0]], own, steps


def _kin(nodes: DataFrame) -> DataFrame:
    """nodes(tree, total, index, node) of one level -> a row a parent: tree, total, parent, kids in order; at most 16 rows a group."""
    grouped = nodes.groupBy("tree", "total", F.expr(f"index div {FANOUT}").alias("parent"))
    return grouped.agg(F.array_sort(F.collect_list(F.struct("index", "node"))).alias("kids"))


def _text(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda k: k["node"]), "")


def _paths(anchors: DataFrame, most: int) -> list[DataFrame]:
    """For every level of trees that span partitions, a table (tree, level, index, path, root) of its nodes."""
    height = 0
    while most > FANOUT**height:
        height += 1
    kin, built = [], None
    for level in range(height):
        nodes = anchors.where((F.col("level") == level) & (_width(level) > 1)).select("tree", "total", "index", "node")
        if built is not None:
            nodes = nodes.unionByName(built.where(_width(level) > 1))
        kin.append(materialize(_kin(nodes), f"kin{level}"))
        built = kin[-1].select("tree", "total", F.col("parent").alias("index"), digest(_text(F.col("kids"))).alias("node"))
    out: list[DataFrame] = []
    for level in reversed(range(height)):
        rows = kin[level]
        if out:
            above = out[-1].select("tree", F.col("index").alias("parent"), F.col("path").alias("over"), F.col("root").alias("top"))
            rows = rows.join(above, ["tree", "parent"], "left")
        else:
            rows = rows.select("*", F.lit(None).cast(STEPS).alias("over"), F.lit(None).cast("string").alias("top"))
        rows = rows.withColumn("top", F.coalesce("top", digest(_text(F.col("kids"))))).select("*", F.posexplode("kids").alias("at", "kid"))
        left, right = _text(F.slice("kids", 1, F.col("at"))), _text(F.slice("kids", F.col("at") + 2, F.lit(FANOUT)))
        path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.coalesce("over", F.array().cast(STEPS)))
        out.append(materialize(rows.select("tree", F.lit(level).alias("level"), F.col("kid.index").alias("index"), path.alias("path"), F.col("top").alias("root")), f"paths{level}"))
    discard(*kin)
    return out


def trees(leaves: DataFrame, order: list[str], rows_a_partition: int = ROWS_A_PARTITION) -> DataFrame:
    """leaves(tree, node, item, and `order`), a table -> (tree, whole, kids: array<struct<node, item>>, steps, root), a table.

    A row holds up to 16 leaves with one parent, and the steps from that
    parent to the root of their tree; where whole is false it holds a single
    leaf, whose steps begin at the leaf. tree must not be null; leaves of
    equal `order` lie in order of their digests.
    """
    spark = leaves.sparkSession
    n = leaves.count()
    parts = max(1, -(-n // rows_a_partition), min(spark.sparkContext.defaultParallelism, n // ROWS_A_TASK))
    # the last key tells rows that repeat as a whole apart, so that they too can lie in several partitions
    keys = ["tree", *order, "node", "_at"]
    ranged = leaves.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = ranged.select("tree", "node", "item").rdd
    known, most = places(rows.mapPartitionsWithIndex(_ends).collect())
    shared = spark.sparkContext.broadcast(known)

    def local(part: int, rows: Iterator) -> Iterator[tuple]:
        for tree, run in groupby(rows, key=lambda r: r[0]):
            own = [(r[1], r[2]) for r in run]
            start, total = shared.value[part].get(tree, (0, len(own)))
            for level, index, node, kids, steps in families(start, total, own):
                yield tree, total, level, index, node, kids, steps

    kind = leaves.schema["item"].dataType
    schema = T.StructType.fromDDL("tree string, total long, level int, index long, node string")
    schema.add("kids", T.ArrayType(T.StructType([T.StructField("node", T.StringType()), T.StructField("item", kind)])))
    schema.add("steps", T.DataType.fromDDL(STEPS))
    found = materialize(spark.createDataFrame(rows.mapPartitionsWithIndex(local), schema, verifySchema=False), "families")
    whole = F.col("level") > 0
    if not most:
        return found.select("tree", whole.alias("whole"), "kids", "steps", F.col("node").alias("root"))
    paths = _paths(materialize(found.select("tree", "total", "level", "index", "node").distinct(), "anchors"), most)
    upper = paths[0]
    for more in paths[1:]:
        upper = upper.unionByName(more)
    met = found.join(upper, ["tree", "level", "index"], "left")
    steps = F.concat("steps", F.coalesce("path", F.array().cast(STEPS)))
    out = materialize(met.select("tree", whole.alias("whole"), "kids", steps.alias("steps"), F.coalesce("root", "node").alias("root")), "trees")
    discard(found, *paths)
    return out


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None, rows_a_partition: int = ROWS_A_PARTITION) -> DataFrame:
    """A row for each row of docs: key, group, leaf, subroot, root, steps, and the columns of `carry`.

    leaf is the digest of `columns`. steps lead from the leaf to the root:
    what stands left and right of its ancestor in each run of 16, level by
    level, first in the tree of its group, then in the tree of all subroots.
    Groups are ordered by their bytes, null first; leaves of a group by key
    (null first), ties by digest. Rows that repeat are leaves of their own. An
    empty table gives an empty result; other columns of docs are not read.
    """
    carry = carry or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    item = F.struct(F.col(key).alias("key"), F.col(group).alias("group"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    leaves = materialize(docs.select(name.alias("tree"), digest(*[framed(F.col(c)) for c in columns]).alias("node"), F.col(key).alias("order"), item.alias("item")), "leaves")
    below = trees(leaves, ["order"], rows_a_partition)
    tops = materialize(below.select("tree", "root").distinct(), "subroots")
    above = trees(tops.select(F.lit("").alias("tree"), F.col("root").alias("node"), F.col("tree").alias("order"), F.struct("tree").alias("item")), ["order"], rows_a_partition)
    above = _leaves(above).select(F.col("item.tree").alias("tree"), F.col("steps").alias("over"), F.col("root").alias("top"))
    rows = _leaves(below.join(above, "tree").withColumn("steps", F.concat("steps", "over")))
    return rows.select(
        F.col("item.key").alias(key), F.col("item.group").alias(group), F.col("node").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"),
        "steps", *[F.col(f"item.c{i}").alias(c) for i, c in enumerate(carry)],
    )


def _leaves(found: DataFrame) -> DataFrame:
    """A row a leaf, with its own step before the others."""
    rows = found.select("*", F.posexplode("kids").alias("_pos", "_kid"))
    left, right = _text(F.slice("kids", 1, F.col("_pos"))), _text(F.slice("kids", F.col("_pos") + 2, F.lit(FANOUT)))
    own = F.when(F.col("whole"), F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(STEPS))
    return rows.select(*[c for c in found.columns if c not in ("kids", "steps", "whole")], F.concat(own, "steps").alias("steps"), "_kid.node", "_kid.item")


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings of a proof, level by level, from left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of a proof lead to."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["left"], node, s["right"]))
