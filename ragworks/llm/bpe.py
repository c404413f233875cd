"""Byte-level BPE encoding and decoding over a pair occurrence index.

For each run of texts in a partition the words not met before are laid out in
one row of symbols. An index maps each pair of neighbouring symbols to all its
positions; the ranks in use are applied in ascending order, each merging at
all positions of its pair at once, and the lists of the pairs to the left and
right are updated. Pairs with many positions are merged as arrays, those with
few one by one. Words met before come from a bounded store.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragworks.llm.common import bound_batches

#: How texts split into words before the merges (fixed value of this kind of vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids, and the longest of them in characters.
CACHE_WORDS = 200_000
CACHE_CHARS = 64
#: Positions from which a pair is merged as an array.
MANY = 48
#: Characters of text whose new words share one index, about.
RUN_CHARS = 1 << 22

_SHIFT = 24


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files: itself, or the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file, a few MB; read on the driver.

    Only files of byte-level BPE that split by PATTERN are taken; others raise ValueError.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    added = spec.get("added_tokens", [])
    whole = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
    if spec.get("normalizer") or not (plain and level and whole):
        raise ValueError(f"{path} is no plain byte-level BPE")
    of_char = {c: b for b, c in enumerate(byte_chars())}
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    table: dict[int, bytes] = {i: bytes(of_char[c] for c in t) for t, i in vocab.items() if all(c in of_char for c in t)}
    table |= {t["id"]: t["content"].encode() for t in added}
    return {
        "bytes": [vocab[c] for c in byte_chars()],
        "merges": {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)},
        "table": table,
        "added": {t["content"]: t["id"] for t in added},
    }


@cache
def _splitters() -> tuple:
    """PATTERN for texts of characters below U+10000, with its classes written out for the quicker module, and for all others."""
    import regex

    plane = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))

    def members(kind: str) -> str:
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(rf"{kind}+", plane))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    narrow = rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile("[\U00010000-\U0010ffff]").search, re.compile(narrow).findall, regex.compile(PATTERN).findall


def split_words(text: str) -> list[str]:
    """The words of a text in order; together they are the text."""
    beyond, narrow, wide = _splitters()
    return narrow(text) if text.isascii() or not beyond(text) else wide(text)


class Merges:
    """The merges as one key a pair, in arrays for a look at many pairs and in a dict for single ones."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        by_rank = sorted((rank, a, b, made) for (a, b), (rank, made) in merges.items())
        self.left, self.right, self.made = ([x[k] for x in by_rank] for k in (1, 2, 3))
        self.rank_of = {a << _SHIFT | b: i for i, (_, a, b, _) in enumerate(by_rank)}
        keys = np.fromiter(self.rank_of, np.int64, len(self.rank_of))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def found(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, at) of the pairs that are merges, by rank."""
        if not len(self.keys):
            return at[:0], at[:0]
        key = left.astype(np.int64) << _SHIFT | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[place] == key) & (left >= 0) & (right >= 0))
        ranks = self.order[place[hit]]
        by = np.argsort(ranks, kind="stable")
        return ranks[by], at[hit[by]]


def merge_words(words: list[bytes], byte_ids: np.ndarray, merges: Merges, many: int = MANY) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all words one after the other, number of each word's), all merged together."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if not lengths.sum():
        return np.zeros(0, np.int32), lengths
    ends = np.cumsum(lengths + 1) - 1  # behind each word a sign that no pair crosses
    n = int(ends[-1]) + 1
    symbols = np.full(n, -1, np.int32)
    body = np.ones(n, bool)
    body[ends] = False
    symbols[body] = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    # the index: rank of a pair -> all its positions, in arrays and in a list
    arrays: dict[int, list[np.ndarray]] = {}
    lists: dict[int, list[int]] = {}
    active: list[int] = []

    def enlist(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> None:
        ranks, at = merges.found(left, right, at)
        if len(at):
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(at)]):
                if r not in arrays:
                    arrays[r] = []
                    if r not in lists:
                        heapq.heappush(active, r)
                arrays[r].append(at[a:b])

    def enlist_one(rank: int | None, at: int) -> None:
        if rank is not None:
            if rank not in lists:
                lists[rank] = []
                if rank not in arrays:
                    heapq.heappush(active, rank)
            lists[rank].append(at)

    enlist(symbols[:-1], symbols[1:], np.arange(n - 1, dtype=np.int32))
    symbol, next_, last = memoryview(symbols), memoryview(after), memoryview(before)
    rank_of = merges.rank_of.get
    while active:
        rank = heapq.heappop(active)
        left, right, made = merges.left[rank], merges.right[rank], merges.made[rank]
        parts, places = arrays.pop(rank, []), lists.pop(rank, [])
        if left != right and len(places) + sum(map(len, parts)) >= many:
            i = np.concatenate([*parts, np.array(places, np.int32)])
            i = i[symbols[i] == left]  # the others were merged away since they were listed
            i = i[symbols[after[i]] == right]
            j = after[i]
            k = after[j]
            symbols[i], symbols[j] = made, -2
            after[i], before[k] = k, i
            h = before[i]  # before the first symbol stands the last sign
            new = symbols[i]
            enlist(np.concatenate([new, symbols[h]]), np.concatenate([symbols[k], new]), np.concatenate([i, h]))
            continue
        for part in parts:
            places.extend(part.tolist())
        if left == right:  # only then do occurrences overlap: the first one counts
            places.sort()
        for i in places:
            if symbol[i] != left:
                continue
            j = next_[i]
            if symbol[j] != right:
                continue
            k = next_[j]
            symbol[i], symbol[j] = made, -2
            next_[i], last[k] = k, i
            if symbol[k] >= 0:
                enlist_one(rank_of(made << _SHIFT | symbol[k]), i)
            h = last[i]
            if symbol[h] >= 0:
                enlist_one(rank_of(symbol[h] << _SHIFT | made), h)
    live = symbols >= 0
    upto = np.concatenate([[0], np.cumsum(live)])
    return symbols[live], upto[ends] - upto[ends - lengths]


class Rows:
    """Arrays of different lengths one behind the other, to be looked up by number."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows of these numbers one behind the other, where each ends)."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)], ends


def _texts_of(rows: dict[int, bytes]) -> Rows:
    """Rows of bytes by number; numbers without any have none."""
    named = [rows.get(i, b"") for i in range(max(rows, default=-1) + 1)]
    return Rows(np.frombuffer(b"".join(named), np.uint8), np.fromiter(map(len, named), np.int64, len(named)))


class _Known(dict):
    """word -> its number; a new word gets the next one and is noted in fresh."""

    def __init__(self):
        self.fresh: list[str] = []
        self.size = 0

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = at = self.size
        self.size = at + 1
        return at


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: dict):
        self.vocabulary = vocabulary
        self.table = _texts_of(vocabulary["table"])
        self.names = _texts_of({i: f"{i},".encode() for i in vocabulary["table"]})
        self.byte_ids, self.merges = np.array(vocabulary["bytes"], np.int32), Merges(vocabulary["merges"])
        self.added = vocabulary["added"]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None
        self._forget()

    def _forget(self) -> None:
        """Start with no word but the added tokens."""
        self.known = _Known()
        for token in self.added:
            self.known[token]
        self.known.fresh.clear()
        self.ids = Rows(np.array(list(self.added.values()), np.int32), np.ones(len(self.added), np.int64))
        self.hits = np.zeros(len(self.added), np.int64)

    def _keep_common(self) -> None:
        """Keep the half of the store that was met most; hits fade."""
        words = list(self.known)
        number = np.fromiter(self.known.values(), np.int64, len(words))
        common = np.argsort(-self.hits[number], kind="stable")[: CACHE_WORDS // 2]
        common = common[~np.isin(number[common], np.arange(len(self.added)))]
        ids, hits = self.ids, self.hits
        self._forget()
        for at in common.tolist():
            self.known[words[at]]
        self.known.fresh.clear()
        flat, ends = ids.gather(number[common])
        self.ids = Rows(np.concatenate([self.ids.flat, flat]), np.concatenate([self.ids.lengths, np.diff(ends, prepend=0)]))
        self.hits = np.concatenate([self.hits, hits[number[common]] // 2])

    def _words(self, text: str) -> list[str]:
        if self.split_added is None or not any(t in text for t in self.added):
            return split_words(text)
        return [w for piece in self.split_added(text) for w in ([piece] if piece in self.added else split_words(piece))]

    def encode_run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts one after the other, where each text's end)."""
        if len(self.known) > CACHE_WORDS:
            self._keep_common()
        number = self.known.__getitem__
        numbers = [np.fromiter(map(number, words), np.int32, len(words)) for words in map(self._words, texts)]
        fresh = self.known.fresh
        if fresh:
            flat, lengths = merge_words([w.encode("utf-8", "replace") for w in fresh], self.byte_ids, self.merges)
            self.ids = Rows(np.concatenate([self.ids.flat, flat]), np.concatenate([self.ids.lengths, lengths]))
            self.hits = np.concatenate([self.hits, np.zeros(len(fresh), np.int64)])
            for w in fresh:
                if len(w) > CACHE_CHARS:
                    del self.known[w]
            fresh.clear()
        at = np.concatenate([np.zeros(0, np.int32), *numbers])
        self.hits += np.bincount(at, minlength=len(self.hits))
        flat, word_ends = self.ids.gather(at)
        text_ends = np.cumsum([len(x) for x in numbers])
        return flat, np.concatenate([[0], word_ends])[text_ends]

    def decode_run(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids up to its end; bytes that are no UTF-8 become U+FFFD."""
        return [x.decode("utf-8", "replace") for x in _cut(*self._bytes(self.table, ids), ends)]

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, str, str]]:
        """(number of ids, digest of the ids in decimal, digest of the text decoded from them) of each text."""
        named = _cut(*self._bytes(self.names, ids), ends)
        for n, name, text in zip(np.diff(ends, prepend=0).tolist(), named, self.decode_run(ids, ends)):
            yield n, hashlib.sha256(name[:-1]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    def _bytes(self, rows: Rows, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(rows.lengths)):
            raise ValueError("an id that the vocabulary does not have")
        flat, id_ends = rows.gather(ids)
        return flat.tobytes(), np.concatenate([[0], id_ends])


def _cut(flat: bytes, upto: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The pieces of flat up to each end; upto: bytes before each id."""
    stops = upto[ends].tolist()
    return [flat[a:b] for a, b in zip([0, *stops], stops)]


_codecs: dict[int, Codec] = {}


def _codec(vocabulary) -> Codec:
    """The codec of a broadcast vocabulary: a worker keeps it, with its words, from task to task."""
    key = id(vocabulary.value)  # the codec holds it, so no other vocabulary gets this id meanwhile
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary.value)
    return _codecs[key]


def _runs(texts: list[str], chars: int = RUN_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, so that the index of one run is bounded."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def vocabulary_broadcast(spark: SparkSession, path: str):
    """The vocabulary for encode(), decode() and round_trip(); Arrow batches get bounded, as each text brings its ids."""
    bound_batches(spark)
    return spark.sparkContext.broadcast(load_vocabulary(path))


def _pieces(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, ends[:-1])


def encode(text: Column, vocabulary) -> Column:
    """array<int> of token ids of a text column; a null text has none. vocabulary: see vocabulary_broadcast."""

    @F.pandas_udf("array<int>")
    def bpe_encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(vocabulary)
        for batch in texts:
            yield pd.Series([x for run in _runs([t or "" for t in batch]) for x in _pieces(*codec.encode_run(run))], dtype=object)

    return bpe_encode(text)


def decode(ids: Column, vocabulary) -> Column:
    """Text of a column of token ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text; an id that is no token's fails."""

    @F.pandas_udf("string")
    def bpe_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(vocabulary)
        for batch in batches:
            rows = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in batch]
            yield pd.Series(codec.decode_run(np.concatenate([np.zeros(0, np.int64), *rows]), np.cumsum([len(x) for x in rows], dtype=np.int64)), dtype=object)

    return bpe_decode(ids)


def round_trip(text: Column, vocabulary) -> Column:
    """struct(n_tokens, ids, ids_sha256, decoded_sha256) of a text column, all made in one pass; null counts as empty."""

    @F.pandas_udf("n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    def bpe_round_trip(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(vocabulary)
        for batch in texts:
            rows = []
            for run in _runs([t or "" for t in batch]):
                coded = codec.encode_run(run)
                rows += [(n, ids, a, b) for ids, (n, a, b) in zip(_pieces(*coded), codec.digests(*coded))]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return bpe_round_trip(text)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs: encoded, then decoded from the ids.

    Ids and text of a document stay in the task that made them. A null text
    counts as empty (0 tokens). Repeated rows give repeated rows, an empty
    table an empty result; columns besides doc_id and text are not read.
    """
    vocabulary = vocabulary_broadcast(docs.sparkSession, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def bpe_digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(vocabulary)
        for batch in texts:
            rows = [row for run in _runs([t or "" for t in batch]) for row in codec.digests(*codec.encode_run(run))]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    got = docs.select("doc_id", bpe_digests(F.col("text")).alias("__got"))
    return got.select("doc_id", "__got.n_tokens", "__got.ids_sha256", "__got.decoded_sha256")
