import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ragworks.llm import merkle, spelling, topk

# ---- Merkle manifest ----------------------------------------------------------------------------------------------

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, steps string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """(root, per node the (left, right) of each step)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    steps = []
    for i in range(len(nodes)):
        own = []
        for level in levels[:-1]:
            low = i // 16 * 16
            own.append(("".join(level[low:i]), "".join(level[i + 1 : low + 16])))
            i //= 16
        steps.append(own)
    return levels[-1][0], steps


def plain_manifest(rows):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), r[0]) for r in rows if r[1] == s), key=lambda x: x[:3])
        inner[s] = (own, *plain_tree([x[2] for x in own]))
    root, above = plain_tree([inner[s][1] for s in sources])
    return sorted(((x[3], s, x[2], inner[s][1], root, below + up) for s, up in zip(sources, above) for x, below in zip(inner[s][0], inner[s][2])), key=repr)


def manifest(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "t", "n", "s") for r in rows], DOCS)
    got = merkle.merkle_manifest(docs, **options)
    return sorted(((r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in got.collect()), key=repr)


ODD_DOCS = [
    (1, "a", "en", 1, None), (2, "a", None, None, ""), (2, "a", None, None, ""), (None, None, None, None, None), (None, "a", "en", 3, "x"), (None, "a", "en", 3, "y"), (3, "", "é", 9, "é漢🙂"),
    (4, "é", "en", 5, "word " * 20_000), (5, "z", "en", 1, "Z"), (-7, "a", "en", 1, "A"),
]


@pytest.mark.parametrize("rows_a_partition", [3, 1_000])
def test_manifest_of_odd_rows(spark, rows_a_partition):
    assert manifest(spark, ODD_DOCS, rows_a_partition=rows_a_partition) == plain_manifest(ODD_DOCS)


@pytest.mark.parametrize("rows_a_partition", [7, 50, 100_000])
def test_a_source_may_span_partitions(spark, rows_a_partition):
    sizes = {"hot": 300, "b": 1, "c": 16, "d": 17, None: 33} | {f"s{i}": 2 for i in range(20)}
    rows = [(i, s, "en", i, f"text {i}") for s, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    assert manifest(spark, rows, rows_a_partition=rows_a_partition) == plain_manifest(rows)


def test_rows_that_repeat_are_leaves_of_their_own(spark):
    rows = [(1, "a", "en", 1, "x")] * 70 + [(2, "a", "en", 1, "y")]
    assert manifest(spark, rows, rows_a_partition=10) == plain_manifest(rows)
    assert manifest(spark, []) == []


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", i, f"T{i}") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.merkle_manifest(docs, carry={"other": F.sha2(F.col("text"), 256)})
    got = got.select(merkle.fold(F.col("leaf"), F.col("steps")).alias("right"), merkle.fold(F.col("other"), F.col("steps")).alias("wrong"), "root").collect()
    assert all(r["right"] == r["root"] != r["wrong"] for r in got) and len(got) == 100


@pytest.mark.parametrize("total", [1, 2, 16, 17, 255, 256, 257, 300])
def test_parts_of_a_tree_give_its_nodes(total):
    nodes = [sha(str(i)) for i in range(total)]
    cut = sorted(random.Random(total).sample(range(total + 1), min(3, total)) + [0, total])
    root, _ = plain_tree(nodes)
    tops = [x for a, b in zip(cut, cut[1:]) if b > a for x in merkle.families(a, total, [(n, ()) for n in nodes[a:b]])]
    assert [kid[0] for *_, kids, _ in tops for kid in kids] == nodes
    if len([1 for a, b in zip(cut, cut[1:]) if b > a]) == 1:
        assert {node for _, _, node, _, _ in tops} == {root}


# ---- spelling variants --------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts, ratio=5):
    form, rows = {}, []
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * n:
                form[w] = best
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(rows, key=repr)


def invented(seed, size):
    r = random.Random(seed)
    letters = "abcdeé"
    words = {"".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(size)}
    for w in list(words)[: size // 2]:
        at = r.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]}
    return {w: r.choice([5, 6, 30, 200, 1000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("hot_key", [1, 5, 500])
@pytest.mark.parametrize("seed", [1, 2])
def test_forms_equal_brute_force(spark, seed, hot_key):
    counts = invented(seed, 300) | {"a" * n: n for n in range(6, 90)} | {"b" * 65 + x: 7 for x in ("", "b", "c", "bc", "cc")} | {"xyzxyz" + "ab" * n: 50 for n in range(28, 40)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(map(tuple, spelling.spelling_forms(words, hot_key=hot_key).collect()), key=repr)
    assert got == plain_forms(counts)


def plain_words(rows, noise):
    counts = Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run, n in Counter(spelling.RUN.findall(low)).items():
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += n
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("noise", [0, 3, 199])
def test_words_of_odd_texts(spark, noise):
    rows = [(1, None), (2, ""), (3, "Straße STRAßE straße×÷ " * 5), (None, "letter Letter LETTER lettre " * 9), (4, "letter-letter letter's 漢字漢字漢字 " * 900), (4, "word " * 20_000), (5, "a" * 20_000 + " " + "a" * 20_000), (5, "lettér " * 6)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long")
    counts = plain_words(rows, noise)
    assert {r["word"]: r["n"] for r in spelling.count_words(docs, noise=noise).collect()} == counts
    got = sorted(map(tuple, spelling.spelling_variants(docs, noise=noise).collect()), key=repr)
    assert got == plain_forms(counts) and len(got) > 1
    assert spelling.spelling_variants(docs.where("false")).count() == 0


def test_chains_end_at_the_last_form(spark):
    counts = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 625, "abcdefghij": 3125, "abcdefghijk": 15_625}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r["root"] for r in spelling.spelling_forms(words).collect()} == {"abcdefghijk"}


# ---- exact top-k --------------------------------------------------------------------------------------------------


def plain_topk(rows, k=10):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    known = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    asked = {}
    for i, v in rows:
        if i is not None and i % 100 == 0 and whole(v) is not None:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        w = whole(v)
        most = 2**63 - 1
        scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(w, c)))), i is None, i or 0) for i, c in known if i != q)[:k]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scores)]
    return sorted(out, key=repr)


def searched(spark, rows, k=10, **options):
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, v string").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "id", "v")
    if options.pop("doubles", False):
        vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, v string")
    got = topk.exact_topk(vectors.where("vec_id % 100 = 0"), vectors, k, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def rounded(rows):
    """Numbers that a float holds, so that plain Python sees the same."""
    return [(i, None if v is None else [x if x is None or not math.isfinite(x) else round(x * 4096) / 4096 for x in v]) for i, v in rows]


@pytest.mark.parametrize("tile_values", [400, 2_000_000])
def test_topk_equals_brute_force(spark, tile_values):
    r = random.Random(5)
    hot = [r.gauss(0, 1) for _ in range(20)]
    rows = [(i, hot if i % 3 == 0 else [r.gauss(0, 1) for _ in range(20)]) for i in range(600)]
    rows = rounded(rows)
    assert searched(spark, rows, tile_values=tile_values) == plain_topk(rows)


def test_topk_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, None), (200, [nan, 1.0]), (300, [None, 1.0]), (400, []), (500, [1.0]), (500, [2.0, 0.5]), (None, [3.0, 3.0]), (None, [3.0, 3.0]), (7, [inf, 1.0]), (8, [0.0, 0.0]), (8, [0.0, 0.0]), (-100, [-0.5, -0.0001])]
    assert searched(spark, rows, doubles=True) == plain_topk(rows)
    assert searched(spark, [], doubles=True) == [] and searched(spark, [(1, [1.0])]) == []
    assert searched(spark, [(0, [1.0])]) == []


def test_topk_of_large_numbers(spark):
    rows = [(0, [1e7, -3.0, 1e6]), (100, [3e12, 1.0, -2e3]), (1, [2e7, 1e7, 5.5]), (2, [-1e15, 2.0, 1.0]), (3, [1e300, 0.0, 0.0]), (4, [1e7, -3.0, 1e6 + 0.5])]
    assert searched(spark, rows, doubles=True) == plain_topk(rows)


@pytest.mark.parametrize("seed", range(4))
def test_search_keeps_all_that_can_win(seed):
    import numpy as np

    r = np.random.default_rng(seed)
    size = [3, 1_000, 60_000, 3_000_000_000][seed]
    q, c = r.integers(-size, size, (7, 30)), r.integers(-size, size, (500, 30))
    c[100:200] = c[0]
    scores = q.astype(object) @ c.T.astype(object)
    best = topk.search(q.astype(object) if size > 2**31 else q.astype(float), c.astype(object) if size > 2**31 else c.astype(float), [np.arange(i, i + 2) for i in range(7)], 10, chunk=64)
    for i in range(7):
        want = sorted((-max(-topk.MOST, min(topk.MOST, s)), p) for p, s in enumerate(scores[i]) if not i <= p < i + 2)[:10]
        assert [(-int(s), int(p)) for s, p in zip(best.score[i], best.place[i])] == want
