import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ragworks.llm import bpe, decontamination, license_scan, pii
from ragworks.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, spans string, labels string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


# ---- decontamination ----------------------------------------------------------------------------------------------


def plain_shingles(text, n):
    ws = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}, len(ws)


def plain_contained(texts, items, share=0.8):
    out = []
    for i, t in enumerate(texts):
        for k, item in items:
            n = min(5, plain_shingles(item, 1)[1])
            want = plain_shingles(item, n)[0] if n else set()
            hit = len(want & plain_shingles(t, n)[0]) if n else 0
            if want and hit >= share * len(want) - 1e-9:
                out.append((i, k, len(want), hit))
    return sorted(out)


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_containment_equals_brute_force(spark, block):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 5, 8, 20, 45, 90]))) for k in range(30)] + [(30, None), (31, ""), (32, "..."), (33, "W1 w2"), (33, "w1, W2!")]
    texts = [None, "", "w1 w2", say(50)]
    for k in range(80):
        ws = (items[k % 30][1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            ws[rng.randrange(len(ws))] = "zz"
        cut = rng.choice([0, 0, len(ws) // 8])
        texts.append(f"{say(rng.randint(0, 3000))}, {' '.join(ws[cut:]).upper()} {say(rng.randint(0, 60))}")
    table = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = decontamination.contaminated(docs(spark, texts), table, block_chars=block)
    assert sorted((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got.collect()) == plain_contained(texts, items)
    clean = {r["doc_id"] for r in decontamination.decontaminate(docs(spark, texts), table, block_chars=block).collect()}
    assert clean == set(range(len(texts))) - {i for i, *_ in plain_contained(texts, items)}
    assert decontamination.contaminated(docs(spark, texts), table.where("false")).count() == 0
    assert decontamination.contaminated(docs(spark, texts).where("false"), table).count() == 0


# ---- PII ----------------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def plain_pii(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m[0])]


TEXTS = [
    None, "", "none", "a@b.cc", "🙂é a.b+c@x-y.co.uk, _d@e.f@g.hh", "a@b", "a@b@c.de", "x@y.zz_q@r.ss", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255", "1.2.3.99999999999999999999",
    "4111 1111 1111 1111", "4111-1111 11111111 2", "4111  1111 1111 1111", "+1 (555) 010-9999 12", "++4420 7946 0958.", "+1", "+12345678 +1234567", "call +49 30 1234567)",
    "a" * 20_000, "1" * 20_000, "+1" + " " * 20_000, "." * 20_000 + "@", "a.b." * 3_000 + "@x" + ".y" * 5_000, "m@n.oo" * 50, "%@-.-", "1.1.1.1-1.1.1.1",
]


def test_base_spans_equal_plain_regexes(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("a1@.+- ()é_%0🙂4") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    got = {r["doc_id"]: r for r in pii.pii_report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, got[i]["spans"], want)
        assert got[i]["n_email"] == sum(w.startswith("email") for w in want)
        assert [s for s in got[i]["spans"].split(",") if s.split(":")[0] in PLAIN] == want
    assert pii.pii_report(docs(spark, texts).where("false")).count() == 0


def test_added_kinds_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 BIC DEUTDEFF.", "GB82WEST12345698765431", "SSN 123-45-6789", "no 123-45-6789", "ssn: 000-12-3456", "card 4111111111111111", "4111111111111111"]
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.pii_report(docs(spark, texts)).collect()}
    assert got[0] == ("iban:5:32", "1.00") and got[1][0] == ""
    assert got[2] == ("national_id:4:15", "0.60") and got[3][0] == "" and got[4][0] == ""
    assert got[5] == ("card:5:21", "1.00") and got[6] == ("card:0:16", "0.70")


def test_many_matches_in_one_text(spark):
    """The work grows with the text, not with its square."""
    text = "mail: a@b.cc 10.0.0.1 " * 25_000
    began = time.time()
    got = pii.pii_report(docs(spark, [text])).first()
    assert (got["n_email"], got["n_ip"]) == (25_000, 25_000) and time.time() - began < 30
    assert got["spans"].endswith(f"ip:{len(text) - 9}:{len(text) - 1}") and got["scores"].startswith("1.00,1.00")
    began = time.time()
    row = license_scan.Scanner(dict.fromkeys((w for _, t in license_scan.TEMPLATES for w in license_scan.words(t)), 1)).scan("All rights reserved, cc by. " * 50_000)
    assert row[:4] == (250_000, 100_000, 0, 249_998) and row[5] == "cc-by,reserved" and time.time() - began < 20


def test_words_before_a_match_across_other_matches(spark):
    texts = ["server " + "1.1.1.1 " * k for k in range(9)] + ["é" * 39 + "ip 1.2.3.4", "ip" + " " * 38 + "1.2.3.4", "ip" + " " * 39 + "1.2.3.4"]
    got = {r["doc_id"]: r["scores"].split(",") for r in pii.pii_report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        near = [t[max(0, m.start() - 40) : m.start()] for m in re.finditer(PLAIN["ip"][0], t)]
        assert got[i] == (["0.80" if re.search(r"\bip\b|address|host|server", x) else "0.50" for x in near] or [""]), t


def test_columns_of_any_name_pass_through(spark):
    table = spark.createDataFrame([(1, "a@b.cc", 7, 8, 9, 10)], "doc_id long, text string, __spans int, __email int, value int, start int")
    got = pii.find_pii(table).first()
    assert tuple(got)[:6] == (1, "a@b.cc", 7, 8, 9, 10) and [s["kind"] for s in got["pii"]] == ["email"]


# ---- licences -----------------------------------------------------------------------------------------------------


def plain_labels(text):
    ws = [w.decode() for w in license_scan.words(text)]
    places = [i for p in license_scan.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    labels = {label for p, label in license_scan.PHRASES.items() if any(ws[i : i + len(p.split())] == p.split() for i in range(len(ws)))}
    score = 1.0 if places else 0.0
    for label, t in license_scan.TEMPLATES:
        want = [w.decode() for w in license_scan.words(t)]
        width = len(want) + len(want) // 4
        share = max((len(set(ws[i : i + width]) & set(want)) / len(set(want)) for i in range(len(ws))), default=0)
        if share >= license_scan.CONTAINMENT - 1e-9:
            labels.add(label)
            score = max(score, share)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), score


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "CC BY cc-by, cc by", "cc bye by", "General  Public\nLicense", "All rights reserved. ALL RIGHTS RESERVED"]
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(1, 4)):
            ws = rng.choice(license_scan.TEMPLATES)[1].split()
            if rng.random() < 0.3:
                rng.shuffle(ws)
            ws = [w for w in ws if rng.random() < 0.97]
            for _ in range(rng.choice([0, 0, 1, len(ws) // 5, len(ws) // 3])):
                ws.insert(rng.randrange(len(ws) + 1), rng.choice(["etc", "the", "license", "\n"]))
            lines.append(" ".join(ws) + " x" * rng.choice([0, 5, 300]))
        texts.append("\n".join(lines).title())
    mit = license_scan.TEMPLATES[3][1].split()
    texts += [" \n * ".join(mit), "all rights. Reserved", "all the rights reserved", " ".join(mit[:-4]) + " y" * 40 + " ".join(mit[-4:])]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, base, first, last, labels, score = plain_labels(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (n, base, first, last, labels), t
        assert r["score"] == pytest.approx(score)
    assert license_scan.license_scan(docs(spark, texts).where("false")).count() == 0


# ---- BPE ----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(7)
    letters = "abcXYZ '’\t\n\r\x0b\x1c\x85\xa0éñ漢字🙂٣½_-.,!<|>0123456789\x00"
    texts = [None, "", "<|endoftext|>", "a <|endoftext|> b", " " * 50 + "x", "a" * 30_000, "ab" * 999]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    got = {r["doc_id"]: r for r in bpe.digests(docs(spark, texts), tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(got[i])[1:] == want, t
    assert bpe.digests(docs(spark, texts).where("false"), tokenizer_path()).count() == 0


def test_bpe_round_trip_columns(spark):
    vocabulary = bpe.vocabulary_broadcast(spark, tokenizer_path())
    table = docs(spark, ["one two", None, "ünï 🙂"]).withColumn("ids", bpe.encode(F.col("text"), vocabulary))
    got = {r["doc_id"]: r["back"] for r in table.withColumn("back", bpe.decode(F.col("ids"), vocabulary)).collect()}
    assert got == {0: "one two", 1: "", 2: "ünï 🙂"}


def test_merges_never_lead_back_to_a_lower_rank():
    """What lets all positions of one rank merge at once."""
    made, bad = {}, 0
    for (a, b), (rank, new) in bpe.load_vocabulary(tokenizer_path())["merges"].items():
        bad += made.get(a, -1) > rank or made.get(b, -1) > rank
        made.setdefault(new, rank)
    assert not bad


def test_bpe_arrays_lists_and_a_small_store_give_the_same(monkeypatch):
    vocabulary = bpe.load_vocabulary(tokenizer_path())
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)) + " 😀" * (i % 2) for i in range(60)]
    words = [w.encode() for t in texts for w in bpe.split_words(t)]
    byte_ids, merges = bpe.np.array(vocabulary["bytes"]), bpe.Merges(vocabulary["merges"])
    one, two = (bpe.merge_words(words, byte_ids, merges, many) for many in (1, 10**9))
    assert all((a == b).all() for a, b in zip(one, two))
    want = list(bpe.Codec(vocabulary).digests(*bpe.Codec(vocabulary).encode_run(texts)))
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 4)
    codec = bpe.Codec(vocabulary)
    for _ in range(2):
        assert [row for i in range(0, 60, 7) for row in codec.digests(*codec.encode_run(texts[i : i + 7]))] == want


def test_bpe_takes_no_other_kind_of_file():
    with pytest.raises(ValueError):
        bpe.load_vocabulary(tokenizer_path("word_bpe_49k.json"))
