"""Suffix dedup: which bytes stand in a 50-byte string of an earlier document.

The suffixes of all texts are dealt into buckets by content: a suffix goes by
the least hashed k-gram within its first `length` bytes, so equal strings meet
in one bucket wherever they stand, and a run of neighbouring suffixes travels
as one segment instead of a record for each byte. Copies of a segment inside
a group of documents are combined before the shuffle.

First the buckets learn only the hashes of the k-grams, and tell the groups
which of them others have too; only segments with such a rival travel. They
also tell which k-grams are hot, that is stand among too many different
neighbours for one bucket: their segments are taken apart into suffixes, each
dealt by a hash of its whole string. A bucket is then sorted by itself. Equal
segments are settled first. The suffixes of what is left are put in order one
suffix bucket at a time: by their first 15 bytes, and longer ties by
the ranks of a difference-cover sample (cover {0, 1, 3, 9} modulo 13), which
is sorted beforehand: for any two places some offset below 13 leads both to
sample places, where one comparison of ranks decides. The order yields the
classes of equal strings, and each the smallest document that holds it.

The groups take these answers and cut their own texts. Memory is bounded by
the size of a group or bucket, both parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
GRAM = 24
#: Bytes of text in a group of documents, about, and of raw segments in a bucket.
GROUP_BYTES = 16_000_000
#: Smaller inputs are cut finer, down to so many bytes, until every core has work.
LEAST_GROUP_BYTES = 1_000_000
#: Different segments, about, from which a k-gram is hot.
HOT_GRAM = 10_000
#: Suffixes that are sorted together.
SUFFIX_BUCKET = 1 << 20

#: A perfect difference cover (fixed values).
PERIOD = 13
COVER = (0, 1, 3, 9)

_CHUNK = 1 << 18
_LAST = np.iinfo(np.int64).max
_U = np.uint64
_MUL = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _byte_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _MUL[0]
    x ^= x >> _U(31)
    return x * _MUL[1]


_BYTES = _byte_table()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _MUL[2]
    x ^= x >> _U(29)
    return x


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place, out of those of 1, 2, 4 ... bytes."""
    x, have, out, done = _BYTES[data], 1, None, 0
    while True:
        if k & have:
            out = x if out is None else out[: len(data) - k + 1 + (k - done - have)] * _MUL[2] + x[done : done + len(data) - k + 1 + (k - done - have)]
            done += have
        if done == k:
            return _mix(out[: len(data) - k + 1])
        x = x[:-have] * _MUL[have.bit_length() % 5] + x[have:]
        have *= 2


def _windows_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n, have = len(x) - w + 1, 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])


class Shape:
    """Sizes that follow from the string length."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.choices = length - gram + 1  # k-grams of a string
        self.most = length + self.choices - 1  # bytes of a segment, at most
        self.width = -(-(self.most) // 8) * 8


def segments(data: np.ndarray, bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, suffixes, key) of each segment of the texts data[bounds[i]:bounds[i + 1]].

    A segment is a longest run of suffixes, `choices` at most, with one least k-gram.
    """
    out: list[tuple] = []
    n_docs, first = len(bounds) - 1, 0
    while first < n_docs:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _CHUNK, "right")) - 1)
        lo, hi = int(bounds[first]), int(bounds[last])
        for at in range(lo, hi, 4 * _CHUNK):  # a longer text goes in pieces that share length - 1 bytes
            end = min(hi, at + 4 * _CHUNK + shape.length - 1)
            if end - at >= shape.length:
                out.append(_piece(data, bounds, first, last, at, end, shape))
        first = last
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _piece(data: np.ndarray, bounds: np.ndarray, first: int, last: int, lo: int, hi: int, shape: Shape) -> tuple:
    key = _windows_min(_gram_hashes(data[lo:hi], shape.gram), shape.choices)
    n = len(key)
    starts = bounds[first : last + 1] - lo
    cut = np.zeros(n + 1, bool)
    np.not_equal(key[1:], key[:-1], out=cut[1:n])
    inner = starts[(starts >= 0) & (starts <= n)]
    cut[inner] = True
    dead_from = starts[1:] - shape.length + 1  # suffixes that would cross the end of a text
    for_each = (dead_from > 0) & (dead_from <= n)
    cut[dead_from[for_each]] = True
    cut[0] = True
    cut[n] = True
    places = np.flatnonzero(cut)
    begin, stop = places[:-1], places[1:]
    doc = np.searchsorted(starts, begin, "right") - 1
    ok = (doc >= 0) & (doc < last - first)
    ok[ok] &= begin[ok] + shape.length <= starts[doc[ok] + 1]
    begin, stop, doc = begin[ok], stop[ok], doc[ok]
    count = stop - begin
    if len(count) and count.max() > shape.choices:  # a repeated k-gram can hold longer
        parts = -(-count // shape.choices)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        doc, count = np.repeat(doc, parts), np.repeat(count, parts)
        begin = np.repeat(begin, parts) + step * shape.choices
        count = np.minimum(shape.choices, count - step * shape.choices)
    return doc + first, begin + lo, count, key[begin]


def rows_of(data: np.ndarray, start: np.ndarray, count: np.ndarray, shape: Shape) -> np.ndarray:
    """Bytes of segments as rows of one width, zeros behind their ends. data must go on for a width behind the last text."""
    rows = np.lib.stride_tricks.sliding_window_view(data, shape.width)[start]
    tail = np.arange(shape.length, shape.width)
    rows[:, shape.length :][tail >= (count + shape.length - 1)[:, None]] = 0
    return rows


def _row_hash(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    x = np.zeros(len(rows), np.uint64)
    for column in [*rows.view("<u8").T, *(m.astype(np.uint64) for m in more)]:
        x = (x ^ column) * _MUL[0]
        x ^= x >> _U(32)
    return x


def equal_classes(rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class, class of each row) of equal rows; classes in order of their first rows."""
    n = len(rows)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, inverse = np.unique(_row_hash(rows, count), return_index=True, return_inverse=True)
    head = first[inverse]
    other = np.flatnonzero(head != np.arange(n))
    same = (rows[other].view("<u8") == rows[head[other]].view("<u8")).all(1) & (count[other] == count[head[other]])
    head[other[~same]] = other[~same]  # a clash of hashes: a class of its own; the bucket compares bytes again
    first = np.flatnonzero(head == np.arange(n))
    place = np.zeros(n, np.int64)
    place[first] = np.arange(len(first))
    return first, place[head]


# ---- one bucket ---------------------------------------------------------------------------------------------------


#: Bytes that a step of the sort looks at: they and the number of a group fit in one integer.
STEP = 5


def _refine(word, steps: int, n: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort n places by their words, word(k, places) for step k; only ties go on to the next step.

    Returns the order, the group of each place (equal for equal words), and
    the bytes that each place in order shares with the one before, to `depth`.
    """
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # by position in order: where its group starts
    shared = np.full(n, depth, np.int64)
    if n:
        shared[0] = 0
    active, number = np.arange(n), np.zeros(n, np.uint64)  # positions in order whose groups are open, and their groups from 0
    for k in range(steps):
        if not len(active):
            break
        value = word(k, order[active]) | number << _U(8 * STEP)
        by = np.argsort(value)
        order[active], value = order[active][by], value[by]
        differ = value[1:] ^ value[:-1]
        new = np.ones(len(active), bool)
        new[1:] = differ != 0
        split = np.flatnonzero(new[1:] & (differ >> _U(8 * STEP) == 0)) + 1
        lead = np.zeros(len(split), np.int64)
        for b in range(1, STEP):
            lead += differ[split - 1] >> _U(8 * b) == 0
        shared[active[split]] = STEP * k + lead
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(active)))
        group[active] = np.repeat(active[starts], sizes)
        keep = np.repeat(sizes > 1, sizes)
        active, number = active[keep], (np.cumsum(new) - 1)[keep].astype(np.uint64)
    place_group = np.zeros(n, np.int64)
    place_group[order] = group
    return order, place_group, shared


def read_step(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """STEP bytes from each place as a number, first byte highest."""
    return read_words(text, at) >> _U(64 - 8 * STEP)


class Cover:
    """Ranks of the difference-cover sample of a text, to a depth of `length` bytes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, length: int):
        """wanted: places (ascending) that a comparison may lead to."""
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        self.length = length
        sample = wanted[in_cover[wanted % PERIOD]]
        order, _, shared = _refine(lambda k, i: read_step(text, sample[i] + STEP * k), length // STEP, len(sample), length)
        self.rank_at = np.zeros(len(text), np.int32)
        self.rank_at[sample[order]] = np.arange(len(sample))
        self.classes = np.array([np.cumsum(shared < length - d) for d in range(PERIOD)], np.int32)
        self.lead = np.array([[min(d for d in range(PERIOD) if in_cover[(i + d) % PERIOD] and in_cover[(j + d) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)])

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for the strings of `length` bytes at a and b, which must share their first PERIOD - 1 bytes."""
        d = self.lead[a % PERIOD, b % PERIOD]
        ra, rb = self.rank_at[a + d], self.rank_at[b + d]
        return np.where(self.classes[d, ra] == self.classes[d, rb], 0, np.sign(ra - rb))


def read_words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number, first byte highest."""
    return np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))[at].astype(np.uint64)


def suffix_classes(text: np.ndarray, places: np.ndarray, cover: Cover) -> np.ndarray:
    """A number for each place, equal exactly where the strings of `length` bytes from there are."""
    steps = -(-(PERIOD - 1) // STEP)
    _, group, _ = _refine(lambda k, i: read_step(text, places[i] + STEP * k), steps, len(places), STEP * steps)
    out = np.arange(len(places))
    order = np.argsort(group, kind="stable")
    group = group[order]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    keep = np.repeat(sizes > 1, sizes)
    at, group = order[keep], group[keep]
    while len(at):  # longer ties: three-way partition of every group around one of its members
        new = np.ones(len(at), bool)
        new[1:] = group[1:] != group[:-1]
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(at)))
        pivot = np.repeat(at[head + sizes // 2], sizes)
        side = cover.compare(places[at], places[pivot])
        equal = side == 0
        out[at[equal]] = pivot[equal]
        at, side, index = at[~equal], side[~equal], np.repeat(np.arange(len(head)), sizes)[~equal]
        group = 2 * index + (side > 0)
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = group[1:] != group[:-1]
            sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
            keep = np.repeat(sizes > 1, sizes)
            at, group = at[keep], group[keep]
    return out


def first_documents(rows: np.ndarray, count: np.ndarray, doc: np.ndarray, shape: Shape, suffix_bucket: int = SUFFIX_BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """(row of each suffix, smallest document of its string) over the suffixes of different rows, row by row."""
    text = np.concatenate([rows.ravel(), np.zeros(shape.width + 8, np.uint8)])
    row = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    places = row * shape.width + offset
    reach = count + PERIOD - 1
    wanted = np.repeat(np.arange(len(rows)) * shape.width - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
    cover = Cover(text, wanted, shape.length)
    least = np.zeros(len(places), np.int64)
    buckets = -(-len(places) // suffix_bucket)
    lead = read_words(text, places) if buckets > 1 else None
    cuts = np.quantile(lead[:: max(1, len(lead) // 4096)], np.arange(1, buckets) / buckets, method="nearest") if buckets > 1 else []
    which = np.searchsorted(cuts, lead, "right") if buckets > 1 else np.zeros(len(places), np.int64)
    for b in range(buckets):
        own = np.flatnonzero(which == b)
        if len(own):
            kind = suffix_classes(text, places[own], cover)
            smallest = np.full(len(own), _LAST)
            np.minimum.at(smallest, kind, doc[row[own]])
            least[own] = smallest[kind]
    return row, least


def settle_bucket(rows: np.ndarray, count: np.ndarray, key: np.ndarray, doc: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What documents before a segment's own hold of it: runs (segment, first suffix, end, smallest document)."""
    n = len(rows)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not n:
        return none
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    rivals = np.sort(order[np.repeat(sizes > 1, sizes)])
    if not len(rivals):
        return none
    own_rows, own_count, own_doc = rows[rivals], count[rivals], doc[rivals]
    first, kind = equal_classes(own_rows, own_count)
    smallest = np.full(len(first), _LAST)
    np.minimum.at(smallest, kind, own_doc)
    whole = smallest[kind] < own_doc
    seg, lo, hi, least = [rivals[whole]], [np.zeros(whole.sum(), np.int64)], [own_count[whole]], [smallest[kind][whole]]
    # keys that still have several contents
    _, name = np.unique(key[rivals[first]], return_inverse=True)
    open_ = np.flatnonzero(np.bincount(name)[name] > 1)
    if len(open_):
        row, low = first_documents(own_rows[first[open_]], own_count[first[open_]], smallest[open_], shape)
        better = low < smallest[open_][row]
        edge = np.ones(len(row) + 1, bool)
        edge[1:-1] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
        starts, ends = np.flatnonzero(edge)[:-1], np.flatnonzero(edge)[1:]
        held = better[starts]
        starts, ends = starts[held], ends[held]
        base = np.concatenate([[0], np.cumsum(own_count[first[open_]])])
        run_row = row[starts]
        runs_kind, run_lo, run_hi, run_low = open_[run_row], starts - base[run_row], ends - base[run_row], low[starts]
        # to every segment of the class
        by_kind = np.argsort(kind, kind="stable")
        begin = np.searchsorted(kind[by_kind], runs_kind)
        many = np.searchsorted(kind[by_kind], runs_kind, "right") - begin
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        member = by_kind[np.repeat(begin, many) + step]
        seg.append(rivals[member])
        lo.append(np.repeat(run_lo, many))
        hi.append(np.repeat(run_hi, many))
        least.append(np.repeat(run_low, many))
    return tuple(np.concatenate(x) for x in (seg, lo, hi, least))


# ---- the job ------------------------------------------------------------------------------------------------------


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the keys."""
    return ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


class _Group:
    """Segments of the documents of one group, the same whenever they are made."""

    def __init__(self, table: pa.Table, buckets: int, shape: Shape):
        self.shape, self.buckets = shape, buckets
        table = table.append_column("without_id", pc.is_null(table["doc_id"]))
        table = table.set_column(table.schema.get_field_index("doc_id"), "doc_id", pc.fill_null(table["doc_id"].combine_chunks(), _LAST))
        table = table.sort_by([("doc_id", "ascending"), ("body", "ascending")])
        body = table["body"].cast(pa.large_binary()).combine_chunks()
        if isinstance(body, pa.ChunkedArray):
            body = pa.concat_arrays(body.chunks)
        self.doc_id, self.without_id = table["doc_id"].to_numpy(), table["without_id"].to_numpy()
        bounds = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, body.offset * 8)
        raw = np.frombuffer(body.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.data = np.concatenate([raw, np.zeros(shape.width, np.uint8)])
        self.doc, self.start, self.count, key = segments(self.data, self.bounds, shape)
        self.keys, self.key_of, self.times = np.unique(_mix(key * _MUL[3]), return_inverse=True, return_counts=True)
        # keys in order are dealt to buckets in order
        self.key_at = np.searchsorted(bucket_of(self.keys, buckets), np.arange(buckets + 1))

    def row_hashes(self, start: np.ndarray, count: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """A hash of the content of each segment."""
        out = np.zeros(len(start), np.uint64)
        for i in range(0, len(start), step):
            out[i : i + step] = _row_hash(rows_of(self.data, start[i : i + step], count[i : i + step], self.shape), count[i : i + step])
        return out

    def contents(self) -> np.ndarray:
        """For each key how many different segments it has here; exact from 16 segments on, else their number."""
        out = self.times.copy()
        many = np.flatnonzero(self.times[self.key_of] >= 16)
        if len(many):
            _, first = np.unique(self.row_hashes(self.start[many], self.count[many]), return_index=True)
            held = np.bincount(self.key_of[many[first]], minlength=len(out))
            out[held > 0] = held[held > 0]
        return out

    def keep_rivals(self, answers: pa.Table) -> None:
        """Go on with the segments whose key other segments have, here or in other groups; number their contents.

        Segments of hot keys go on as single suffixes, each with a hash of its string as its key.
        """
        shape, rival, hot = self.shape, self.times > 1, np.zeros(len(self.times), bool)
        for b, blob in zip(answers["bucket"].to_pylist(), answers["blob"]):
            lo, hi = self.key_at[b], self.key_at[b + 1]
            bits = np.frombuffer(blob.as_py(), np.uint8).reshape(2, -1)
            rival[lo:hi] |= np.unpackbits(bits[0], count=hi - lo).astype(bool)
            hot[lo:hi] |= np.unpackbits(bits[1], count=hi - lo).astype(bool)
        single, own = np.flatnonzero(hot[self.key_of]), rival[self.key_of] & ~hot[self.key_of]
        doc, start, count, self.key = self.doc[own], self.start[own], self.count[own], self.keys[self.key_of[own]]
        if len(single):
            times = self.count[single]
            offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            apart = np.repeat(self.start[single], times) + offset
            ones = np.ones(len(apart), np.int64)
            doc, start, count = np.concatenate([doc, np.repeat(self.doc[single], times)]), np.concatenate([start, apart]), np.concatenate([count, ones])
            self.key = np.concatenate([self.key, _mix(self.row_hashes(apart, ones) * _MUL[4])])
            order = np.argsort(start, kind="stable")  # by document again
            doc, start, count, self.key = doc[order], start[order], count[order], self.key[order]
        self.doc, self.start, self.count = doc, start, count
        n, step = len(self.doc), 1 << 17
        hashes = self.row_hashes(start, count)
        # copies within the group: equal hashes, then equal bytes
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        head = first[inverse]
        other = np.flatnonzero(head != np.arange(n))
        for i in range(0, len(other), step):
            o = other[i : i + step]
            a = rows_of(self.data, self.start[o], self.count[o], shape)
            b = rows_of(self.data, self.start[head[o]], self.count[head[o]], shape)
            apart = o[(a != b).any(1) | (self.count[o] != self.count[head[o]])]
            head[apart] = apart
        self.first = np.flatnonzero(head == np.arange(n))
        place = np.zeros(n, np.int64)
        place[self.first] = np.arange(len(self.first))
        self.kind = place[head]
        bucket = bucket_of(self.key[self.first], self.buckets)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.bucket_at = np.searchsorted(bucket[self.by_bucket], np.arange(self.buckets + 1))

    def members(self, bucket: int) -> np.ndarray:
        """Contents of the bucket, in order of their first places."""
        return self.by_bucket[self.bucket_at[bucket] : self.bucket_at[bucket + 1]]


def _pack(*arrays: np.ndarray) -> bytes:
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes) -> bytes:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(blob)


def _blobs(out: list[tuple], **key: int) -> pa.Table:
    """Rows (bucket or grp, n, blob) as a table, with the other of the two as a constant column."""
    name, value = next(iter(key.items()))
    other = "grp" if name == "bucket" else "bucket"
    at, n, blob = zip(*out) if out else ((), (), ())
    columns = {name: pa.array([value] * len(out), pa.int32()), other: pa.array(at, pa.int32())}
    columns |= {"n": pa.array(n, pa.int32()), "blob": pa.array(blob, pa.binary())}
    return pa.table({c: columns[c] for c in ("bucket", "grp", "n", "blob")})


_BLOBS = "bucket int, grp int, n int, blob binary"
#: Bytes of a key that travel; a clash only makes a segment travel without need.
_KEY_BYTES = 5
#: Steps in which a byte tells a doubling of a number of segments.
_SIZE_STEPS = 8


def _ask(buckets: int, shape: Shape):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = _Group(table, buckets, shape)
        low = group.keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
        size = np.round(_SIZE_STEPS * np.log2(group.contents())).astype(np.uint8)  # a power of two in one byte
        at = group.key_at.tolist()
        return _blobs([(b, n - m, low[m:n].tobytes() + size[m:n].tobytes()) for b, m, n in zip(range(buckets), at, at[1:]) if m < n], grp=key[0].as_py())

    return ask


def _meet(hot_gram: int):
    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """For each group two bits for each of its keys of the bucket: does another group have it, and is it hot?"""
        sizes = table["n"].to_numpy().astype(np.int64)
        total = int(sizes.sum())
        wide, held = np.zeros((total, 8), np.uint8), np.zeros(total)
        base = np.concatenate([[0], np.cumsum(sizes)])
        for i, blob in enumerate(table["blob"]):
            raw = np.frombuffer(blob.as_py(), np.uint8)
            wide[base[i] : base[i + 1], :_KEY_BYTES] = raw[: _KEY_BYTES * sizes[i]].reshape(-1, _KEY_BYTES)
            held[base[i] : base[i + 1]] = 2.0 ** (raw[_KEY_BYTES * sizes[i] :] / _SIZE_STEPS)
        keys = wide.view("<u8").ravel()
        order = np.argsort(keys)
        new = np.ones(total, bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        first, name = np.flatnonzero(new), np.cumsum(new) - 1
        met, hot = np.zeros(total, bool), np.zeros(total, bool)
        met[order] = (np.diff(np.append(first, total)) > 1)[name]
        hot[order] = (np.add.reduceat(held[order], first) > hot_gram)[name]
        out = []
        for g, a, b in zip(table["grp"].to_pylist(), base.tolist(), base[1:].tolist()):
            if met[a:b].any() or hot[a:b].any():
                out.append((g, b - a, np.packbits(met[a:b]).tobytes() + np.packbits(hot[a:b]).tobytes()))
        return _blobs(out, bucket=key[0].as_py())

    return meet


def _deal(buckets: int, shape: Shape):
    def deal(key: tuple[pa.Scalar, ...], table: pa.Table, rivals: pa.Table) -> pa.Table:
        group = _Group(table, buckets, shape)
        group.keep_rivals(rivals)
        out: list[tuple] = []
        for b in range(buckets):
            own = group.members(b)
            if len(own):
                at = group.first[own]
                rows = rows_of(group.data, group.start[at], group.count[at], shape)
                docs = group.doc_id[group.doc[at]]
                out.append((b, len(own), _pack(np.diff(docs, prepend=0), group.key[at], group.count[at].astype(np.uint8), rows)))
        return _blobs(out, grp=key[0].as_py())

    return deal


def _settle(shape: Shape):
    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        groups = table["grp"].to_pylist()
        sizes = table["n"].to_numpy().astype(np.int64)
        total = int(sizes.sum())
        rows = np.zeros((total, shape.width), np.uint8)
        count, doc, keys = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.uint64)
        at = 0
        for n, blob in zip(sizes.tolist(), table["blob"]):
            raw = _unpack(blob.as_py())
            doc[at : at + n] = np.cumsum(np.frombuffer(raw, np.int64, n))
            keys[at : at + n] = np.frombuffer(raw, np.uint64, n, 8 * n)
            count[at : at + n] = np.frombuffer(raw, np.uint8, n, 16 * n)
            rows[at : at + n] = np.frombuffer(raw, np.uint8, n * shape.width, 17 * n).reshape(n, shape.width)
            at += n
        seg, lo, hi, least = settle_bucket(rows, count, keys, doc, shape)
        order = np.lexsort((lo, seg))
        seg, lo, hi, least = seg[order], lo[order], hi[order], least[order]
        base = np.concatenate([[0], np.cumsum(sizes)])
        cut = np.searchsorted(seg, base)
        out = []
        for i, g in enumerate(groups):
            a, b = cut[i], cut[i + 1]
            if a < b:
                packed = _pack(least[a:b], (seg[a:b] - base[i]).astype(np.int32), lo[a:b].astype(np.uint8), hi[a:b].astype(np.uint8))
                out.append((g, int(b - a), packed))
        return _blobs(out, bucket=key[0].as_py())

    return settle


def _cut(buckets: int, shape: Shape):
    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        group = _Group(table, buckets, shape)
        kinds = answers["rivals"].to_numpy(zero_copy_only=False)
        group.keep_rivals(answers.filter(pa.array(kinds)))
        answers = answers.filter(pa.array(~kinds))
        own_doc = group.doc_id[group.doc]
        first_doc = own_doc[group.first]
        change = np.zeros(len(group.data) + 1, np.int32)
        later = np.flatnonzero(own_doc > first_doc[group.kind])  # an earlier document of the group has it all
        np.add.at(change, group.start[later], 1)
        np.add.at(change, group.start[later] + group.count[later] + shape.length - 1, -1)
        by_kind = np.argsort(group.kind, kind="stable")
        for bucket, n, blob in zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["blob"]):
            raw = _unpack(blob.as_py())
            least = np.frombuffer(raw, np.int64, n)
            kind = group.members(bucket)[np.frombuffer(raw, np.int32, n, 8 * n)]
            lo, hi = np.frombuffer(raw, np.uint8, n, 12 * n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 13 * n).astype(np.int64)
            begin = np.searchsorted(group.kind, kind, sorter=by_kind)
            many = np.searchsorted(group.kind, kind, "right", sorter=by_kind) - begin
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            member = by_kind[np.repeat(begin, many) + step]
            hit = np.repeat(least, many) < own_doc[member]
            member, a, b = member[hit], np.repeat(lo, many)[hit], np.repeat(hi, many)[hit]
            np.add.at(change, group.start[member] + a, 1)
            np.add.at(change, group.start[member] + b + shape.length - 1, -1)
        bounds = group.bounds
        gone = np.cumsum(change[: bounds[-1]], dtype=np.int32) > 0
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        begin, stop = edges[::2], edges[1::2]
        # a run goes on into the next texts where they touch: one span in each
        into, out_of = np.searchsorted(bounds, begin, "right") - 1, np.searchsorted(bounds, stop, "left") - 1
        many = out_of - into + 1
        text = np.repeat(into, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        held = np.minimum(np.repeat(stop, many), bounds[text + 1]) - np.maximum(np.repeat(begin, many), bounds[text])
        removed = np.bincount(text, held, len(bounds) - 1).astype(np.int64)
        spans = np.bincount(text[held > 0], minlength=len(bounds) - 1).astype(np.int64)
        kept = group.data[: bounds[-1]][~gone]
        left = bounds - np.concatenate([[0], np.cumsum(removed)])
        view = memoryview(np.ascontiguousarray(kept))
        shas = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
        ids = pa.array(group.doc_id, pa.int64(), mask=group.without_id)
        return pa.table({
            "doc_id": ids,
            "n_bytes": pa.array(np.diff(bounds), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(shas, pa.string()),
        })

    return cut


def suffix_dedup(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES, hot_gram: int = HOT_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    A byte goes if a string of `length` bytes over it also starts in a row
    with a smaller doc_id; strings are those of the input. Null texts count as
    empty; a null doc_id counts as the largest long there is. Rows that repeat
    an id take nothing from one another and give a row each. An empty table
    gives an empty result; columns besides doc_id and text are not read.
    """
    shape = Shape(length)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    size = base.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-size // group_bytes), min(4 * cores, size // LEAST_GROUP_BYTES))
    buckets = 3 * groups
    base = base.withColumn("grp", F.pmod(F.xxhash64("doc_id", "body"), F.lit(groups)).cast("int"))
    asked = base.groupBy("grp").applyInArrow(_ask(buckets, shape), _BLOBS)
    rivals = asked.groupBy("bucket").applyInArrow(_meet(hot_gram), _BLOBS)
    segs = base.groupBy("grp").cogroup(rivals.groupBy("grp")).applyInArrow(_deal(buckets, shape), _BLOBS)
    settled = segs.groupBy("bucket").applyInArrow(_settle(shape), _BLOBS)
    answers = rivals.withColumn("rivals", F.lit(True)).unionByName(settled.withColumn("rivals", F.lit(False)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return base.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_cut(buckets, shape), schema)
