"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are made unique first (copies of one text cost one row). Two
fingerprints at most `max_bits` apart agree wholly on one of `max_bits + 1`
parts of their bits, so each goes to one bucket a part. A task turns each
fingerprint so that its part leads, sorts by Gray rank and builds the index:
groups of neighbours, and groups of groups, each with the bits that all its
members share. A search walks pairs of groups downwards and drops a pair when
the shared bits alone differ in the leading part or in more than `max_bits`
places. What is found goes out as a forest (at most one link for each
fingerprint and part), never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.llm.common import ASCII_LOWER, ASCII_UPPER, discard, free_names, materialize, maybe_in, small_batches
from ragworks.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
FANOUT = 8
#: Pairs of groups that a task looks at together.
FRONTIER = 1 << 16
#: Buckets with more fingerprints than this are dealt once more, by parts of the bits that are left.
HOT_BUCKET = 20_000

_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle, repeats included; of the whole where it has fewer words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist())], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint as a signed long: a bit is set where more than half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """SimHash of a text column as a long; null and blank texts get 0."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fold(shingle_hashes(t, n)) for t in batch], dtype="int64")

    return simhash(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _levels(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask of shared bits) of each node, from the points up to one root."""
    levels = [(points, np.full(len(points), ~np.uint64(0)))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        first = np.arange(0, len(pattern), FANOUT)
        differ = (pattern ^ np.repeat(pattern[first], FANOUT)[: len(pattern)]) | ~mask
        levels.append((pattern[first], ~np.bitwise_or.reduceat(differ, first)))
    return levels


def _classes(label: np.ndarray) -> list[np.ndarray]:
    """Level by level the class that all members of a node share, or -1."""
    levels = [label]
    while len(levels[-1]) > 1:
        first = np.arange(0, len(levels[-1]), FANOUT)
        low, high = np.minimum.reduceat(levels[-1], first), np.maximum.reduceat(levels[-1], first)
        levels.append(np.where(low == high, high, -1))
    return levels


def close_pairs(points: np.ndarray, lead: np.uint64, max_bits: int, label: Callable[[], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of index pairs i < j of points (in Gray order) that agree on `lead` and differ in at most max_bits bits.

    With label, pairs of groups whose members are all in one class of it are left out.
    """
    levels = _levels(points)
    known, classes = None, None
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    a_step, b_step = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
    while stack:
        level, a, b = stack.pop()
        pattern, mask = levels[level]
        if label is not None:
            if known is not label():
                known = label()
                classes = _classes(known)
            apart = (classes[level][a] != classes[level][b]) | (classes[level][a] < 0)
            a, b = a[apart], b[apart]
        differ = (pattern[a] ^ pattern[b]) & mask[a] & mask[b]
        near = ((differ & lead) == 0) & (np.bitwise_count(differ) <= max_bits)
        a, b = a[near], b[near]
        if not level:
            apart = a < b
            if apart.any():
                yield a[apart], b[apart]
            continue
        size = len(levels[level - 1][0])
        for i in range(0, len(a), FRONTIER // FANOUT**2):
            x = (a[i : i + FRONTIER // FANOUT**2, None] * FANOUT + a_step).ravel()
            y = (b[i : i + FRONTIER // FANOUT**2, None] * FANOUT + b_step).ravel()
            real = (x <= y) & (y < size) & (x < size)
            stack.append((level - 1, x[real], y[real]))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the classes of a[i] and b[i] made one, named by the smallest index."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, up := label[label]):
            label = up


def _part_masks(bits: list[int], parts: int) -> list[list[int]]:
    size, rest = divmod(len(bits), parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k < rest)
        out.append(bits[at : at + n])
        at += n
    return out


def _mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _search(max_bits: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        rows = pd.concat(got)
        for mask, group in rows.groupby("mask", sort=True):
            lead = np.uint64(mask & ((1 << 64) - 1))
            fp = group["fp"].to_numpy().astype(np.uint64)
            bits = [b for b in range(63, -1, -1) if int(lead) >> b & 1] + [b for b in range(63, -1, -1) if not int(lead) >> b & 1]
            turned = np.zeros(len(fp), np.uint64)
            for at, b in enumerate(bits):  # the leading part first
                turned |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - at)
            order = np.argsort(gray_rank(turned), kind="stable")
            fp, points = fp[order], turned[order]
            front = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - int(lead).bit_count())) - 1))
            label = np.arange(len(fp))
            for a, b in close_pairs(points, front, max_bits):
                label = join_labels(label, a, b)
            linked = label != np.arange(len(fp))
            if linked.any():
                yield pd.DataFrame({"a": fp[linked].astype(np.int64), "b": fp[label[linked]].astype(np.int64)})

    return search


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """fp (unique longs) -> forest of links (a, b) with the same components as all pairs within max_bits."""
    parts = _part_masks(list(range(63, -1, -1)), max_bits + 1)
    masks = F.array(*[F.lit(_mask(p)) for p in parts])
    dealt = fingerprints.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    hot = materialize(dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket).select("mask", "key", F.lit(True).alias("hot")), "hot")
    if not hot.isEmpty():
        finer = F.lit(None)
        for p in parts:  # what agrees on this part also agrees on one part of the rest
            rest = _part_masks([b for b in range(63, -1, -1) if b not in p], max_bits + 1)
            finer = F.when(F.col("mask") == _mask(p), F.array(*[F.lit(_mask(p + r)) for r in rest])).otherwise(finer)
        dealt = dealt.join(hot, ["mask", "key"], "left")
        dealt = dealt.select("fp", F.explode(F.when(F.col("hot"), finer).otherwise(F.array("mask"))).alias("mask"))
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return dealt.repartition("mask", "key").select("fp", "mask").mapInPandas(_search(max_bits), "a long, b long")


def near_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """prints(doc_id, fp) -> (doc_id, fp, component_id).

    component_id is the smallest doc_id that a chain of links reaches. Equal
    fingerprints are linked. Rows with a null doc_id take the component of
    their fingerprint. `prints` should be a table, as it is read three times.
    """
    unique = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "unique")
    roots = materialize(connected_components(links(unique.select("fp"), max_bits)), "roots")
    named = unique.join(roots, unique["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    classes = materialize(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def simhash_near_dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    Null and blank texts have fingerprint zero and link like any other; texts
    of fewer words than a shingle are one shingle. Repeated rows give repeated
    rows. An empty table gives an empty result. Other columns are not read.
    """
    prints = materialize(docs.select("doc_id", fingerprint(F.col("text"), shingle_words).alias("fp")), "prints")
    out = near_components(prints, max_bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near-duplicates by similarity ------------------------------------------------------------------------------

#: Words of a shingle, and the Jaccard similarity of shingle sets from which documents are near-duplicates.
WIDE_SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A wide fingerprint holds several narrow prints; a pair is a candidate if it differs in a few bits of one. Recall that
#: SIMILARITY gives by calculation, and other texts that a text meets in one print by chance, at most.
PRINT_RECALL = 0.99
STRANGERS = 8
#: Smaller tables take the prints of one with so many rows. A print has so many bits for each part that leads in the index.
LEAST_ROWS = 400_000
PART_BITS = 8
#: Bits that travel to the index with each narrow print; two texts without a common shingle differ in half of them, 9 deviations beyond what is allowed.
TRAVEL_BITS = 256
#: Standard deviations that a candidate's wide distance may lie beyond that of SIMILARITY; exact similarity decides later.
MARGIN = 3.0
#: Shingle sets of up to so many are also found exactly, by shared rare shingles, as prints are few and coarse there.
SHORT_SHINGLES = 16
#: Characters of a candidate group that are compared in one task; larger groups go in pairs of blocks.
BLOCK_CHARS = 4_000_000


@dataclass(frozen=True)
class Prints:
    """`count` narrow prints of `bits` bits, of which candidates differ in at most max_bits of one."""

    bits: int
    count: int
    max_bits: int

    @property
    def wide_bits(self) -> int:
        return max(TRAVEL_BITS, -(-self.bits * self.count // 64) * 64)


def bit_share(similarity: float) -> float:
    """The share of bits in which two texts of this similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def choose_prints(rows: int, similarity: float = SIMILARITY, least_rows: int = LEAST_ROWS) -> Prints:
    """The prints with the fewest rows in the index that have PRINT_RECALL, and STRANGERS by chance among so many rows.

    The number of bits grows with the logarithm of the rows, so the chance
    meetings of a row are bounded at any number.
    """
    rows, p, best = max(rows, least_rows), bit_share(similarity), None
    for bits in range(20, 64, 4):
        ways = [comb(bits, i) for i in range(bits)]
        for max_bits in (1, 2, 3):
            if bits < PART_BITS * (max_bits + 1) or rows * sum(ways[: max_bits + 1]) / 2**bits > STRANGERS:
                continue
            met = sum(w * p**i * (1 - p) ** (bits - i) for i, w in enumerate(ways[: max_bits + 1]))
            count = int(np.ceil(np.log(1 - PRINT_RECALL) / np.log(1 - met)))
            if best is None or count * (max_bits + 1) < best.count * (best.max_bits + 1):
                best = Prints(bits, count, max_bits)
    if best is None:
        raise ValueError(f"no prints for {rows} rows")
    return best


def wide_distance(similarity: float = SIMILARITY, bits: int = TRAVEL_BITS) -> int:
    """Differing bits up to which a pair is a candidate: what the similarity implies, plus MARGIN."""
    share = bit_share(similarity)
    return int(bits * share + MARGIN * np.sqrt(bits * share * (1 - share)))


def wide_fold(hashes: np.ndarray, bits: int) -> bytes:
    """Fingerprint of so many bits: the hashes are mixed anew for every 64 bits."""
    lanes = [fold(hashes)]
    for k in range(1, bits // 64):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        lanes.append(fold(x ^ (x >> np.uint64(32))))
    return b"".join(x.to_bytes(8, "big", signed=True) for x in lanes)


def rare_shingles(hashes: np.ndarray, similarity: float, longest: int = SHORT_SHINGLES) -> list[int]:
    """Of a short shingle set so many of the smallest hashes that two sets of this similarity share one; of a longer one none.

    The smaller of two sets has at most `longest` shingles, the larger one at most longest / similarity.
    """
    n = len(hashes)
    if n > longest / similarity:
        return []
    return np.sort(hashes)[: n - int(np.ceil(similarity * n - 1e-9)) + 1].astype(np.int64).tolist()


def wide_fingerprint(text: Column, bits: int, n: int = WIDE_SHINGLE_WORDS, similarity: float = SIMILARITY) -> Column:
    """struct(content: 128-bit id of the word sequence, wide: fingerprint of the shingle set, without repeats, rare: see rare_shingles, size) of a text column; null counts as empty."""

    @F.pandas_udf("content binary, wide binary, rare array<long>, size int")
    def wide(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for batch in texts:
            out = []
            for t in batch:
                ws = (t or "").encode("utf-8", "replace").translate(_LOWER).split()
                hashes = np.unique(shingle_hashes(t, n))
                out.append((sha256(b" ".join(ws)).digest()[:16], wide_fold(hashes, bits), rare_shingles(hashes, similarity), len(hashes)))
            yield pd.DataFrame(out, columns=["content", "wide", "rare", "size"])

    return wide(text)


def short_links(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """prints(content, rare, size), a row a content -> links (a, b) that join all short texts of this similarity.

    Texts meet under a rare shingle and the size of the smaller one; each goes
    with the first under its key, as exact similarity decides among all that
    are joined. Sizes differ by the factor `similarity` at most.
    """
    low = F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int")
    met = prints.where("size > 0").select("content", "size", low.alias("low"), F.explode("rare").alias("shingle"))
    met = met.select("content", "shingle", F.explode(F.sequence("low", "size")).alias("smaller"))
    first = met.groupBy("shingle", "smaller").agg(F.min("content").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return met.join(first, ["shingle", "smaller"]).where("a <> content").select("a", F.col("content").alias("b")).distinct()


def _search_wide(most: int, bits: int, max_bits: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        rows = pd.concat(got)
        for (_, mask), group in rows.groupby(["place", "mask"], sort=True):
            ids = group["content"].to_numpy()
            lead = int(mask)
            fp = group["fp"].to_numpy().astype(np.uint64)
            all_bits = range(bits - 1, -1, -1)
            order_of_bits = [b for b in all_bits if lead >> b & 1] + [b for b in all_bits if not lead >> b & 1]
            turned = np.zeros(len(fp), np.uint64)
            for at, b in enumerate(order_of_bits):
                turned |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - at)
            order = np.argsort(gray_rank(turned), kind="stable")
            points, ids = turned[order], ids[order]
            wide = np.frombuffer(b"".join(group["wide"].iloc[order]), np.uint64).reshape(len(ids), -1)
            front = np.uint64(((1 << lead.bit_count()) - 1) << (64 - lead.bit_count()))
            label = near_labels(points, wide, front, max_bits, most)
            linked = label != np.arange(len(ids))
            if linked.any():
                yield pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    return search


def near_labels(points: np.ndarray, wide: np.ndarray, lead: np.uint64, max_bits: int, most: int) -> np.ndarray:
    """Classes of points joined by pairs near in points (max_bits, equal on lead) and in wide (most).

    Neighbours in Gray order are joined first; a search then leaves out pairs
    of groups that are wholly in one class, so that a dense group costs about
    its size and not its square.
    """
    n = len(points)
    label = np.arange(n)

    def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        near = np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int64) <= most
        return join_labels(label, a[near], b[near])

    for lag in (1, 2, 3, 5, 8, 13, 21, 34):
        if lag < n:
            a, b = np.arange(n - lag), np.arange(lag, n)
            differ = points[a] ^ points[b]
            ok = ((differ & lead) == 0) & (np.bitwise_count(differ) <= max_bits)
            label = join(label, a[ok], b[ok])
    for a, b in close_pairs(points, lead, max_bits, lambda: label):
        label = join(label, a, b)
    return label


def wide_links(prints: DataFrame, kind: Prints, similarity: float = SIMILARITY, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """prints(content, wide), a row a content -> forest of links (a, b) with the components of all candidate pairs.

    Candidates differ in at most kind.max_bits bits of a narrow print (each is
    searched by the index above) and in at most wide_distance of the first
    TRAVEL_BITS bits.
    """
    max_bits = kind.max_bits
    all_bits = list(range(kind.bits - 1, -1, -1))
    parts = _part_masks(all_bits, max_bits + 1)
    digits = kind.bits // 4
    narrow = F.array(*[F.struct(F.lit(k).alias("place"), F.conv(F.substring(F.hex("wide"), digits * k + 1, digits), 16, 10).cast("long").alias("fp")) for k in range(kind.count)])
    rows = prints.select("content", F.substring("wide", 1, TRAVEL_BITS // 8).alias("travel"), F.explode(narrow).alias("x")).select("content", F.col("travel").alias("wide"), "x.place", "x.fp")
    dealt = rows.withColumn("mask", F.explode(F.array(*[F.lit(_mask(p)).cast("long") for p in parts])))
    dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    counts = dealt.groupBy("place", "mask", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(counts.where(F.col("n") > hot_bucket).select("place", "mask", "key", F.lit(True).alias("hot")), "hot")
    if not hot.isEmpty():
        finer = F.lit(None)
        for p in parts:
            rest = _part_masks([b for b in all_bits if b not in p], max_bits + 1)
            finer = F.when(F.col("mask") == _mask(p), F.array(*[F.lit(_mask(p + r)).cast("long") for r in rest])).otherwise(finer)
        dealt = dealt.join(hot, ["place", "mask", "key"], "left")
        dealt = dealt.select("content", "wide", "place", "fp", F.explode(F.when(F.col("hot"), finer).otherwise(F.array("mask"))).alias("mask"))
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    search = _search_wide(wide_distance(similarity), kind.bits, max_bits)
    return dealt.repartition("place", "mask", "key").select("content", "wide", "place", "fp", "mask").mapInPandas(search, _pairs_of(prints))


def _pairs_of(contents: DataFrame) -> str:
    kind = contents.schema["content"].dataType.simpleString()
    return f"a {kind}, b {kind}"


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Forest with the components of all pairs of sets (arrays without repeats) of at least this Jaccard similarity.

    A search from set to set: each is compared with all that none has reached
    yet, so that a dense group costs about its size. Empty sets link to none.
    """
    full = [i for i, x in enumerate(sets) if len(x)]
    if len(full) < 2:
        return []
    size = np.array([len(sets[i]) for i in full])
    tokens, flat = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(len(tokens), np.int32)
    rest = np.arange(1, len(full))  # not reached yet; flat has their tokens
    flat, queue, out = flat[size[0] :], [0], []
    while len(rest):
        if not queue:
            queue, flat, rest = [rest[0]], flat[size[rest[0]] :], rest[1:]
            continue
        i = queue.pop()
        mark[own[i]] = 1
        shared = np.add.reduceat(mark[flat], np.cumsum(size[rest]) - size[rest])
        mark[own[i]] = 0
        near = shared >= similarity * (size[i] + size[rest] - shared) - 1e-9
        if near.any():
            out += [(full[i], full[j]) for j in rest[near]]
            queue.extend(rest[near])
            flat, rest = flat[np.repeat(~near, size[rest])], rest[~near]
    return out


def _confirm(similarity: float):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        for _, group in pd.concat(got).groupby(["root", "i", "j"], sort=True):
            group = group.drop_duplicates("content")
            ids = group["content"].to_numpy()
            found = similar_links([np.unique(shingle_hashes(t, WIDE_SHINGLE_WORDS)) for t in group["text"]], similarity)
            if found:
                a, b = np.array(found).T
                yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    return confirm


def confirmed_links(texts: DataFrame, similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """texts(root, content, text), a table -> forest of links (a, b) with the components of all similar pairs of one root.

    Shingle sets are compared exactly. A root with more than block_chars goes
    in blocks, and each pair of its blocks to one group: no pair is left out
    and no task holds more than two blocks.
    """
    sizes = texts.groupBy("root").agg(F.ceil(F.sum(F.length("text")) / block_chars).cast("int").alias("blocks"))
    large = materialize(sizes.where("blocks > 1"), "large")
    whole = texts.select("root", "content", "text", F.lit(0).alias("i"), F.lit(0).alias("j"))
    if not large.isEmpty():
        block = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
        dealt = texts.join(large, "root").withColumn("b", block).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("b <> k")
        dealt = dealt.select("root", "content", "text", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"))
        whole = whole.join(large, "root", "left_anti").unionByName(dealt)
    return whole.repartition("root", "i", "j").mapInPandas(_confirm(similarity), _pairs_of(texts))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id (nulls last).

    Near-duplicates have five-word shingle sets (without repeats) of this
    Jaccard similarity or more, or are joined by a chain of such pairs.
    SimHash fingerprints propose groups, for short texts shared shingles too;
    in them the sets are compared exactly. Rows of the same words are always one group, as are
    all rows without words. Repeated rows count as copies; of rows that share
    id and text but not the rest, either stays. All columns pass through,
    whatever their names. `docs` should be a table, as it is read three times.
    """
    # each part behind its length, so that no two pairs of id and text give one key
    told = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    key = F.unhex(F.md5(F.concat(told("doc_id"), told("text")).cast("binary")))
    kind = choose_prints(docs.count(), similarity)
    wide = wide_fingerprint(F.col("text"), kind.wide_bits, similarity=similarity)
    with small_batches(docs.sparkSession):
        prints = materialize(docs.select("doc_id", key.alias("row_key"), wide.alias("x")).select("doc_id", "row_key", "x.*"), "wide_prints")
    unique = prints.groupBy("content").agg(F.first("wide").alias("wide"), F.first("rare").alias("rare"), F.first("size").alias("size"), F.min("row_key").alias("row_key"))
    # the search proposes by a short name: contents that share one are proposed together, and compared exactly below
    unique = materialize(unique.withColumn("short", F.xxhash64("content")), "contents")
    named = unique.select(F.col("short").alias("content"), "wide", "rare", "size")
    links_ = wide_links(named, kind, similarity).unionByName(short_links(named, similarity))
    groups = materialize(connected_components(links_), "groups")
    # components leave out no node: each root is a row of its own
    members = groups.select(F.col("node").alias("short"), "root").unionByName(groups.select(F.col("root").alias("short"), "root")).distinct()
    members = materialize(members.join(unique.select("short", "content", "row_key"), "short").select("content", "root", "row_key"), "members")
    # few documents have a candidate: only these cross the network
    texts = maybe_in(docs.select(key.alias("row_key"), "text"), F.col("row_key"), members.select("row_key"), "maybe").where("maybe")
    texts = texts.join(members, "row_key").select("root", "content", "text")
    texts = materialize(texts, "texts")
    roots = materialize(connected_components(confirmed_links(texts, similarity)), "roots").select(F.col("node").alias("content"), "root")
    discard(texts, members, groups, unique)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    least = prints.groupBy("content").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n"))
    grouped = least.join(roots, "content", "left").groupBy(F.coalesce("root", "content").alias("root"))
    kept = materialize(grouped.agg(F.min("least").alias("least")).select("least.row_key"), "kept")
    # rows to look at: all that go, and of what stays those that repeat as a whole (one of each stays)
    counted = prints.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).join(kept.withColumn("stays", F.lit(True)), "row_key", "left")
    judged = materialize(counted.where("stays IS NULL OR n > 1").select("row_key", F.coalesce("stays", F.lit(False)).alias("stays")), "judged")
    own, other, stays, maybe = free_names(docs, "key", "row_key", "stays", "maybe")
    out = maybe_in(docs.withColumn(own, key), F.col(own), judged.select("row_key"), maybe)
    judged = judged.select(F.col("row_key").alias(other), F.col("stays").alias(stays))
    met = out.where(maybe).join(judged, F.col(own) == F.col(other), "left")
    once = met.where(stays).drop(other, stays).dropDuplicates([own])
    untouched = out.where(~F.col(maybe)).unionByName(met.where(F.col(other).isNull()).drop(other, stays))
    return untouched.unionByName(once).drop(own, maybe)
