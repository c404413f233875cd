import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragworks.llm import language_id, toxicity
from ragworks.llm.common import held_out
from ragworks.llm.queries import queries


def test_held_out_follows_crc32(spark):
    rows = spark.range(50).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(held_out(F.col("id"), 3, 1)).first()[0] is False


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op7_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    say = {"en": "the house is on the hill", "fr": "la maison est sur la colline", None: "das haus"}
    labelled = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(say.items())] + [(9, None, "xx")], "doc_id long, text string, lang string")
    odd = [(1, None), (2, ""), (3, "12 !? ½ ²"), (4, "the hill"), (5, "collin maiso"), (6, "漢字"), (6, "漢字"), (None, "LA MAISON"), (7, "the " * 20_000)]
    table = spark.createDataFrame([(i, t, "score") for i, t in odd], "doc_id long, text string, lang_pred string")
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in language_id.identify_language(table, labelled).collect()), key=repr)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (6, "en"), (6, "en"), (None, "fr"), (7, "en")], key=repr)
    none = language_id.identify_language(table, labelled.where("false")).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == len(odd)
    assert language_id.identify_language(table.where("false"), labelled).count() == 0


def test_unknown_words_fall_back_to_shorter_grams():
    rows = language_id.pd.DataFrame({"lang": ["a", "b"], "term": ["xyz", "pqr"], "n": [5, 5]})
    grams = language_id.pd.DataFrame({"lang": ["a"], "term": ["z"], "n": [9]})
    empty = rows[:0]
    tables = [language_id._likelihoods(x, ["a", "b"]) for x in (rows, grams, empty, empty, empty)]
    scorer = language_id.Scorer({"langs": ["a", "b"], "tables": tables})
    assert [got[0] for got in scorer.predict(["pqr", "qqz", None, "12"])] == ["b", "a", "und", "und"]
    assert scorer.predict(["mmm"]) == [("a", 0.5)]


def plain_language(texts, labelled):
    """Word by word, gram by gram: (language, score) of each text."""
    letters = re.compile(r"[^\W\d_]+")
    langs = sorted({k for _, t, k in labelled if k and t is not None})
    words = {k: Counter(w for _, t, x in labelled if x == k and t for w in letters.findall(t.lower())) for k in langs}
    cut = lambda w, n: [f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n)]
    tables = [words]
    for n in range(1, 5):
        tables.append({k: Counter() for k in langs})
        for k in langs:
            for w, times in words[k].items():
                for g in cut(w, n):
                    tables[n][k][g] += times

    def logs(table, term):
        known = set().union(*table.values())
        return [math.log((table[k][term] + 0.5) / (sum(table[k].values()) + 0.5 * len(known) + 1)) for k in langs] if term in known else None

    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(langs)
        for w in letters.findall(t.lower()):
            found = [logs(tables[0], w)]
            for n in (4, 3, 2, 1):
                if found == [None] or not found:
                    found = [x for g in cut(w, n) if (x := logs(tables[n], g))]
            for i in range(len(langs)):
                total[i] += sum(x[i] for x in found) / len(found) if found else 0
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp(x - total[best]) for x in total)))
    return out


def test_language_equals_brute_force(spark):
    rng = random.Random(9)
    sounds = {"aa": ["ka", "ti", "lo", "mu"], "bb": ["sch", "ung", "ti", "er"], "cc": ["eau", "é", "lo", "ou"]}
    say = lambda k, n: " ".join("".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    labelled = [(i, say(k, rng.randint(1, 30)), k) for i, k in enumerate("aa bb cc".split() * 15)] + [(90, None, "aa"), (91, "kati", None), (None, "kati", "bb")]
    texts = [say(rng.choice("aa bb cc".split()), rng.randint(1, 12)).title() + rng.choice(["", " 42", " xyzzy", " кот", " eauung"]) for _ in range(120)] + [None, "", "1 2", "½"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_language(table, spark.createDataFrame(labelled, "doc_id long, text string, lang string")).collect()}
    for i, (lang, score) in enumerate(plain_language(texts, [x for x in labelled if x[0] is not None])):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), texts[i]


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op5_toxicity"](spark, sf)
    assert got.count() == 1000
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean, toxic = [r for r in rows if r["toxic"] == 0], [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    above = [(t["score"] > c["score"]) + 0.5 * (t["score"] == c["score"]) for t in toxic for c in clean]
    assert sum(above) / len(above) > 0.85  # area under the curve; some labels are noise
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_pairs_that_no_single_word_tells(spark):
    """A word and another one are harmless together and alone toxic: through fit() with the settings it ships with."""
    rng = random.Random(1)
    rows = []
    for i in range(2500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["".join(rng.choice("abcdefgh") for _ in range(2)) for _ in range(12)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a != b)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(table, table, table.where("doc_id < 2000").select("doc_id", "toxic")).where("doc_id >= 2000").collect()
    assert sum((r["score"] > 0.5) == bool(rows[r["doc_id"]][2]) for r in got) > 0.9 * len(got)


def test_scores_equal_a_plain_machine(spark):
    """Every pair of terms by its own inner product."""
    rng = np.random.default_rng(3)
    words = ["idiot", "idiots", "you", "are", "kind", "people", "été", "straße"]
    hashes = sorted({h for w in words for h in toxicity.term_hashes(w)})[::2]
    model = {"bias": -0.3, "terms": {h: i for i, h in enumerate(hashes)}, "w": rng.normal(size=len(hashes)), "v": rng.normal(size=(len(hashes), 3))}
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))).title() + " unknown!" for _ in range(50)] + ["", None]
    for text in texts:
        terms = sorted({model["terms"][h] for w in (text or "").lower().replace("!", "").split() for h in toxicity.term_hashes(w) if h in model["terms"]})
        z = model["bias"] + sum(model["w"][i] for i in terms)
        z += sum(float(np.dot(model["v"][i], model["v"][j])) for i in terms for j in terms if i < j)
        assert toxicity.Scorer(model).score(text) == pytest.approx(1 / (1 + np.exp(-z)))
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["s"] for r in table.select(toxicity.toxicity_score(F.col("text"), spark.sparkContext.broadcast(model)).alias("s")).collect()]
    assert got == pytest.approx([toxicity.Scorer(model).score(t) for t in texts])


def test_joint_effects_equal_counting():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 6)) < 0.4
    y = (rng.random(3000) < np.where(x[:, 0] ^ x[:, 1], 0.8, 0.2)).astype(float)
    got = toxicity.joint_effects(y, [np.flatnonzero(r) for r in x], 6, block=4)
    for a in range(6):
        best = 0.0
        for b in range(6):
            cells = [(s, y[(x[:, a] == i) & (x[:, b] == j)]) for s, i, j in ((1, True, True), (-1, True, False), (-1, False, True), (1, False, False))]
            if min(len(c) for _, c in cells) >= toxicity.PAIR_ROWS:
                effect = sum(s * np.log((c.sum() + 0.5) / (len(c) - c.sum() + 0.5)) for s, c in cells)
                best = max(best, abs(effect) / np.sqrt(sum(1 / (c.sum() + 0.5) + 1 / (len(c) - c.sum() + 0.5) for _, c in cells)))
        assert got[a] == pytest.approx(best, rel=1e-3)
    assert got[:2].min() > toxicity.PAIR_Z > got[2:].max()


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "fine " * 30_000, 1), (3, "fine", 1), (None, "x", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, docs, labels)
    assert got.count() == 5 and all(0 <= r["score"] <= 1 for r in got.collect())
    assert toxicity.score_toxicity(docs, docs, labels.where("false")).count() == 5
    assert toxicity.score_toxicity(docs.where("false"), docs, labels).count() == 0
    assert [r["score"] for r in got.collect()] == pytest.approx([r["score"] for r in toxicity.score_toxicity(docs, docs, labels).collect()])
