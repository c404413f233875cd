import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ragworks.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from ragworks.llm.common import maybe_in
from ragworks.llm.components import connected_components

SCHEMA = "doc_id long, text string, h string, name string, sha string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "h", "n", "s") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " "), (4, "a" * 50_000), (5, "a" * 50_000), (6, "b"), (6, "b"), (None, "c"), (None, None), (7, "a" * 49_999 + "b"), (8, "é漢🙂" * 30), (None, "a" * 50_000), (None, "a" * 50_000), (4, "a" * 50_000)]


# ---- exact --------------------------------------------------------------------------------------------------------


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [600, 16_384])
def test_exact_odd_rows(spark, block):
    got = exact_dedup.exact_dedup(docs(spark, ODD), block)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_exact(ODD)
    assert exact_dedup.exact_dedup(docs(spark, ODD).where("false"), block).count() == 0


def test_names_are_the_same_at_any_partitioning(spark):
    rows = [(i, "".join(random.Random(i % 20).choices("ab", k=i % 20))) for i in range(60)] + [(None, "abab"), (None, None)]
    got = [exact_dedup.document_identities(docs(spark, rows).repartition(n), 3).select("doc_id", "n", "name").collect() for n in (1, 8)]
    assert sorted(map(tuple, got[0]), key=repr) == sorted(map(tuple, got[1]), key=repr)


def test_blocks_that_share_a_hash_get_different_names(spark, monkeypatch):
    real = exact_dedup._blocks

    def clash(rows, size):
        return real(rows, size).withColumn("h", F.lit(1).cast("long"))

    monkeypatch.setattr(exact_dedup, "_blocks", clash)
    rows = [(i, t) for i, t in enumerate(["x", "y", "x", "xyxy" * 9, "yxyx" * 9, "xyxy" * 9, ""])]
    got = exact_dedup.exact_dedup(docs(spark, rows), 3)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_exact(rows)


# ---- lines --------------------------------------------------------------------------------------------------------


def test_line_dedup_rules(spark):
    rows = [(i, "s", "Menu\nown %d\n\n\tMenu \r" % i) for i in range(9)] + [(9, "s", None), (10, "s", ""), (11, None, "Menu\nx"), (12, "t", "Menu")]
    table = spark.createDataFrame([(i, h, t, 1, 2, 3, 4, 5) for i, h, t in rows], "doc_id long, source string, text string, n_lines int, __keys int, keys int, site int, __lines int")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table).collect()}
    assert got[0]["text"] == "own 0\n" and got[0]["__n_dropped"] == 2 and got[0]["__n_lines"] == 4
    assert got[9]["text"] is None and got[9]["__n_lines"] == 0
    assert got[10]["text"] == "" and got[10]["__n_lines"] == 1
    assert got[11]["text"] == "Menu\nx" and got[12]["text"] == "Menu"  # other sites have too few pages
    assert tuple(got[0][c] for c in ("n_lines", "__keys", "keys", "site", "__lines")) == (1, 2, 3, 4, 5)  # whatever its name, a column passes through
    assert line_dedup.line_dedup(table.where("false")).count() == 0


def test_line_on_few_pages_stays(spark):
    rows = [(i, "s", "rare" if i < 3 else f"own {i}") for i in range(30)] + [(40 + i, "u", "all") for i in range(2)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"] for r in line_dedup.line_dedup(table).where("__n_dropped > 0").collect()} == {40, 41}


# ---- simhash ------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs, bits):
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if i < j and (a ^ b).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs}


def test_simhash_on_the_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_near_dedup(table).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    roots = plain_components(prints, 2)
    assert got == {i: (f"{p:016x}", roots[i]) for i, p in prints}


def test_simhash_odd_rows(spark):
    got = simhash.simhash_near_dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    zero = {r["doc_id"]: r for r in got if r["fingerprint"] == "0" * 16}
    assert set(zero) == {1, 2, 3, None} and {r["component_id"] for r in zero.values()} == {1}
    assert simhash.simhash_near_dedup(docs(spark, ODD).where("false")).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_equal_brute_force(spark, hot):
    rng = random.Random(3)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = connected_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, hot_bucket=hot))
    roots = {r["node"]: r["root"] for r in found.collect()}
    want = plain_components([(v, v & ((1 << 64) - 1)) for v in signed], 2)
    assert {v: roots.get(v, v) for v in signed} == want


def test_gray_rank_inverts_the_gray_code():
    x = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1001, 1300))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_one_of_each_group_stays(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, families = [], 12
    for f in range(families):
        words = [word() for _ in range(400)]
        for copy in range(5):
            mine = list(words)
            for _ in range(copy):  # copy 0 and the next are exact or differ in some words
                mine[rng.randrange(400)] = word()
            rows.append((100 * f + copy, " ".join(mine)))
    rows += [(9000 + i, " ".join(word() for _ in range(300))) for i in range(25)] + [(9100, None), (9101, ""), (9102, " "), (9000, rows[0][1]), (9200, "one"), (9200, "one")]
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, wide string, key int, __key int")
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted([100 * f for f in range(families)] + [9000 + i for i in range(25)] + [9100, 9200])
    assert simhash.drop_near_duplicates(table.where("false")).count() == 0


def test_dense_group_is_one_class():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    wide = np.repeat(base[None], 3000, 0)
    flips = rng.integers(0, 64, 3000).astype(np.uint64)
    wide[np.arange(3000), rng.integers(0, 6, 3000)] ^= np.uint64(1) << flips
    points = wide[:, 0]
    order = np.argsort(simhash.gray_rank(points), kind="stable")
    label = simhash.near_labels(points[order], wide[order], np.uint64(0), 2, 10)
    assert (label == 0).all()


def test_filter_loses_no_key(spark):
    rows = spark.range(5000).select("id", F.col("id").alias("filter_word"), F.lit(1).alias("filter_bits"))
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    got = {r["id"]: r["maybe"] for r in maybe_in(rows, F.col("id"), keys, "maybe").collect()}
    assert all(got[i] for i in range(0, 5000, 7)) and sum(got.values()) < 800 and len(got) == 5000
    assert not any(r["maybe"] for r in maybe_in(rows, F.col("id"), keys.where("false"), "maybe").collect())


def plain_near_kept(rows, similarity=0.8):
    """Ids that stay, by comparing the shingle sets of every two rows."""
    sets = {}
    for i, t in rows:
        ws = t.lower().split()
        sets[i] = {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in sets if find(i) == i)


def near_pairs(rng, shares, words=300):
    """Rows in twos: a text, and one with its last words replaced so that the two sets have about such a similarity."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for n, share in enumerate(shares):
        own = [word() for _ in range(words)]
        stay = round((words - 4) * 2 * share / (1 + share)) + 4
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(own[:stay] + [word() for _ in range(words - stay)]))]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_pairs(random.Random(11), [0.6 + 0.3 * k / 149 for k in range(150)])
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = plain_near_kept(rows)
    assert 220 < len(want) < 280
    assert sorted(r["doc_id"] for r in kept.collect()) == want


@pytest.mark.parametrize("block_chars", [4_000_000, 3_000])
def test_groups_are_compared_whole_at_any_block_size(spark, block_chars):
    """Chains with rejected pairs in one candidate group: what is similar stays joined, whatever links the search proposed."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, own = [], [word() for _ in range(200)]
    for i in range(40):
        rows.append((i, " ".join(own)))
        n = rng.choice([8, 14, 25, 40])
        at = rng.randrange(200 - n)
        own = own[:at] + [word() for _ in range(n)] + own[at + n :]
    texts = spark.createDataFrame([(0, i, t) for i, t in rows], "root long, content long, text string")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.confirmed_links(texts, 0.8, block_chars)).collect()}
    want = plain_near_kept(rows)
    assert 2 < len(want) < 38
    assert sorted(i for i, _ in rows if roots.get(i, i) == i) == want


def test_repeats_inside_a_text_do_not_count(spark):
    """A passage that stands often in one text hides neither its plain copy nor makes other texts alike."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for n in range(15):
        own, other, passage = ([word() for _ in range(k)] for k in (300, 300, 60))
        rows += [(4 * n, " ".join(own + passage)), (4 * n + 1, " ".join(own + passage * 10)), (4 * n + 2, " ".join(other + passage * 10))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = plain_near_kept(rows)
    assert want == sorted(i for i, _ in rows if i % 4 != 1)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


# ---- suffixes -----------------------------------------------------------------------------------------------------


def plain_suffix(rows, n=50):
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    best = {}
    for i, t in texts:
        for k in range(len(t) - n + 1):
            s = t[k : k + n]
            best[s] = min(i, best.get(s, i))
    out = []
    for (i, t), (doc, _) in zip(texts, rows):
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if best[t[k : k + n]] < i:
                gone[k : k + n] = b"\x01" * n
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_odd_rows(spark):
    rows = [(i, t[:3000] if t else t) for i, t in ODD] + [(20, "é漢🙂" * 31), (21, "x" + "a" * 60 + "y"), (None, "a" * 70), (2**63 - 1, "b" * 70), (2**63 - 2, "b" * 60)]
    got = suffix_dedup.suffix_dedup(docs(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_suffix(rows)
    assert suffix_dedup.suffix_dedup(docs(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize(("group_bytes", "hot"), [(16_000_000, 10_000), (9_000, 10_000), (9_000, 3), (16_000_000, 0)])
def test_suffix_on_random_texts(spark, group_bytes, hot):
    rng = random.Random(group_bytes)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for _ in range(120):
        t = " ".join(rng.choice([text(rng.randint(1, 50)), rng.choice(passages)]) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.2 and rows:
            t = rng.choice(rows)[1]
        if rng.random() < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((rng.randint(0, 90), t))
    got = suffix_dedup.suffix_dedup(docs(spark, rows), group_bytes=group_bytes, hot_gram=hot)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_suffix(rows)


def test_hot_gram_is_taken_apart(spark, monkeypatch):
    """A line that stands among ever different neighbours: no bucket holds all its segments, and nothing is lost."""
    line = "the same line on every page of every site, longer than fifty bytes"
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, f"{word(60)}\n{line}\n{word(60)}") for i in range(200)]
    got = suffix_dedup.suffix_dedup(docs(spark, rows), group_bytes=3_000, hot_gram=20)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_suffix(rows)
    shape = suffix_dedup.Shape()
    table = suffix_dedup.pa.table({"doc_id": [i for i, _ in rows], "body": [t.encode() for _, t in rows]})
    group = suffix_dedup._Group(table, 30, shape)
    at = group.key_at.tolist()
    hot = group.contents() > 20
    assert hot.any()
    bits = [(b, suffix_dedup.np.packbits(~hot[m:n]).tobytes() + suffix_dedup.np.packbits(hot[m:n]).tobytes()) for b, m, n in zip(range(30), at, at[1:]) if m < n]
    group.keep_rivals(suffix_dedup.pa.table({"bucket": [b for b, _ in bits], "blob": [x for _, x in bits]}))
    _, of_key = np.unique(group.key[group.first], return_counts=True)
    assert of_key.max() <= 20


def test_suffix_order_in_many_buckets():
    rng = random.Random(8)
    shape = suffix_dedup.Shape()
    base = bytes(rng.choice(b"ab") for _ in range(400))
    rows, count = np.zeros((80, shape.width), np.uint8), np.zeros(80, np.int64)
    for i in range(80):
        n = rng.randint(shape.length, shape.most)
        k = rng.randrange(len(base) - n)
        rows[i, :n] = np.frombuffer(base[k : k + n], np.uint8)
        count[i] = n - shape.length + 1
    doc = np.arange(80)[::-1].copy()
    want = {}
    for i in range(80):
        for k in range(count[i]):
            s = rows[i, k : k + shape.length].tobytes()
            want[s] = min(want.get(s, 99), doc[i])
    for bucket in (1 << 20, 37):
        row, least = suffix_dedup.first_documents(rows, count, doc, shape, bucket)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        assert [want[rows[r, k : k + shape.length].tobytes()] for r, k in zip(row, offset)] == least.tolist()


# ---- recall of the near-duplicate stage ---------------------------------------------------------------------------


def test_pairs_at_the_least_similarity_are_found_at_every_length(spark):
    r, rows, pairs = random.Random(8), [], []
    vocabulary = [f"w{i}" for i in range(60_000)]
    for words, more in ((8, 1), (9, 1), (12, 2), (16, 3), (24, 5), (50, 11), (300, 74)):
        for _ in range(60):
            text = r.sample(vocabulary, words + more)
            pairs.append((words, len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(text[:words])), (len(rows) + 1, " ".join(text))]
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {}
    for words, a, b in pairs:
        shared, total = max(0, words - 4), len(rows[b][1].split()) - 4
        assert shared / total >= 0.8 - 1e-9 and a in kept
        found.setdefault(words, []).append(b not in kept)
    assert all(sum(x) >= 0.95 * len(x) for x in found.values()) and all(all(found[n]) for n in (8, 9, 12, 16))


def test_texts_below_the_least_similarity_stay(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(20_000)]
    rows = []
    for words, more in ((8, 2), (9, 2), (12, 3), (50, 13), (300, 80)):
        for _ in range(20):
            text = r.sample(vocabulary, words + more)
            rows += [(len(rows), " ".join(text[:words])), (len(rows) + 1, " ".join(text))]
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


@pytest.mark.parametrize("rows", [10**5, 10**6, 10**7, 10**8, 10**9, 10**10])
def test_chance_meetings_of_a_row_are_bounded(rows):
    from math import comb

    kind = simhash.choose_prints(rows)
    ways = [comb(kind.bits, i) for i in range(kind.max_bits + 1)]
    p = simhash.bit_share(0.8)
    met = sum(w * p**i * (1 - p) ** (kind.bits - i) for i, w in enumerate(ways))
    assert rows * sum(ways) / 2**kind.bits <= simhash.STRANGERS and 1 - (1 - met) ** kind.count >= simhash.PRINT_RECALL


def test_twice_the_prints_have_about_twice_the_meetings():
    r, pairs = np.random.default_rng(3), []
    for rows in (8_000, 16_000, 32_000):
        kind = simhash.choose_prints(rows, least_rows=rows)
        points = np.sort(r.integers(0, 2**kind.bits, rows, dtype=np.uint64) << np.uint64(64 - kind.bits))
        points = points[np.argsort(simhash.gray_rank(points))]
        pairs.append(sum(len(a) for a, _ in simhash.close_pairs(points, np.uint64(0), kind.max_bits)))
    assert all(n <= simhash.STRANGERS * rows for n, rows in zip(pairs, (8_000, 16_000, 32_000)))


def test_rows_with_other_ids_and_texts_are_other_rows(spark):
    rows = [("a|=b", "c"), ("a", "b|=c"), ("a|=b", "c"), (None, None), ("1:a", "2:b")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(set(rows), key=repr)


def test_the_session_keeps_its_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7777")
    try:
        simhash.drop_near_duplicates(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
        assert spark.conf.get(key) == "7777"
    finally:
        spark.conf.set(key, before)
