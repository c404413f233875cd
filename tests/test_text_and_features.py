import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ragworks.functions import features as feat
from ragworks.functions import text as tx
from ragworks.functions.helpers import find_headers, pack, split_text
from ragworks.functions.text import running_sums, strip
from ragworks.operators import tables


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("LIC_Jeevan-Arogya-Brochure_9-inch-x-8-inch_Eng-(1).pdf", "LIC_JEEVAN_AROGYA"),
        ("policy_2.pdf", "POLICY_2"),
        ("/in/Gold Plan 2020 final.PDF", "GOLD"),
        ("noext", "NOEXT"),
    ],
)
def test_policy_name(spark, name, expected):
    assert one(spark, name, tx.normalize_policy_name) == expected


@pytest.mark.parametrize(("size", "expected"), [(0, 1), (3, 1), (803, 200), (3204, 801)])
def test_token_count(spark, size, expected):
    assert one(spark, "x" * size, tx.token_count) == expected


def test_small_projections(spark):
    assert one(spark, "Eligible Borrower (FHA)", tx.slugify) == "eligible_borrower_fha"
    assert one(spark, "a\x00b\x7fc\x9fd\te\n", tx.clean_control) == "abcd\te\n"
    assert one(spark, "a\x00b\x7fc\x9f", tx.clean_export) == "ab\x7fc\x9f"
    assert one(spark, "x" * 700, tx.tail_tokens) == "x" * 600
    assert one(spark, "the  AUTHORITY\n shall", tx.obligation_party) == "Authority"
    assert one(spark, "étéLender shall", tx.obligation_party) == "General"
    assert one(spark, None, tx.clean_control) is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("3.6\nScope of Work\n", [(2, "3.6", "Scope of Work", 0)]),
        ("Section 2. Loan Terms.\nSection 3. Fees", [(1, "3", "Fees", 23)]),
        ("  SECTION TWO\n\nPART A\n", [(1, "", "SECTION TWO\n\nPART A", 0)]),
        ("1.1 Scope ........ 12", []),
        ("Chapter 4: Rates\n4.1.2 Deep title", [(1, "Ch4", "Rates", 0), (3, "4.1.2", "Deep title", 17)]),
        ("SHORT\n\nlower", []),
        ("", []),
        (None, []),
    ],
)
def test_headers(text, expected):
    assert [(h["level"], h["number"], h["title"], h["start"]) for h in find_headers(text)] == expected


def test_packing_keeps_all_paragraphs():
    text = "\n\n".join("p" * n for n in (100, 3000, 300, 5000, 10))
    parts = pack(text, 800)
    assert "\n\n".join(parts) == text
    assert [max(1, len(p) // 4) <= 800 or "\n\n" not in p for p in parts] == [True] * len(parts)
    assert pack("x" * 3203, 800) == ["x" * 3203]
    assert pack(None, 800) == [""]


def test_split_text_invariants():
    words = " ".join(f"w{i}" for i in range(900))
    text = f"{words}\n\n{'y' * 2500}\n{words}"
    chunks = split_text(text, 1000, 200)
    assert all(0 < len(c) <= 1000 for c in chunks)
    assert set(text.split()) - {"y" * 2500} <= {w for c in chunks for w in c.split()}
    assert sum(c.count("y") for c in chunks) >= 2500
    assert split_text("", 1000, 200) == [] == split_text(None, 1000, 200) == split_text("  \n\n ", 1000, 200)
    assert split_text("short", 1000, 200) == ["short"]


def test_features(spark):
    assert one(spark, "within 30 Business Days", feat.timeline) == "30 business days"
    assert one(spark, "may or should", feat.obligation) == "Recommended"
    assert one(spark, "may or shall", feat.obligation) == "Mandatory"
    assert one(spark, "approve the payment", feat.action_type) == ["pay"]
    assert one(spark, "Formal Section 4, section 5, Annex B", feat.document_referenced) == ["Form", "Section", "Annex"]
    assert one(spark, "Section Table 3", feat.document_referenced) == ["Section"]
    assert one(spark, "beta alpha beta alpha gamma", feat.keywords) == ["beta", "alpha", "gamma"]
    assert one(spark, "the of", feat.keywords) == []
    assert one(spark, "", feat.summary) == ""
    assert one(spark, "x" * 130, feat.summary) == "x" * 120 + "…"


def test_enrich_takes_nulls_and_more_columns(spark):
    rows = spark.createDataFrame(
        [("c1", None, None, None, "n"), ("sec_ch3_a", "table", "", "GENERAL NOTES", "n"), ("c", "section", "2.1", "You must pay.", "n")],
        "chunk_id string, chunk_type string, section_number string, page_content string, features_note string",
    )
    got = {r["chunk_id"]: r for r in feat.enrich(rows).collect()}
    assert got["c1"]["features"]["content_type"] == "Clause" and got["c1"]["features"]["keywords"] == []
    assert got["sec_ch3_a"]["features"]["chapter"] == "Chapter 3" and got["sec_ch3_a"]["feat_content_type"] == "Procedure"
    assert got["c"]["feat_obligation"] == "Mandatory" and got["c"]["feat_action_type"] == '["pay"]'
    export = feat.export_features(feat.enrich(rows))
    assert export.columns[:7] == ["Chunk ID", "Section Id", "Chapter", "Section Title", "Content Type", "Obligation", "Risk Level"]
    assert export.columns[-1] == "Text Content"
    flat = feat.flatten_metadata(feat.enrich(rows).select("chunk_id", "features", F.current_date().alias("d")))
    assert dict(flat.dtypes) == {"chunk_id": "string", "features": "string", "d": "string"}


@pytest.mark.parametrize(
    ("grid", "kind"),
    [
        ([["a", "b"]], "skip"),
        ([["Score", "Item"], ["1", "2"]], "scoring"),
        ([["a", "b"], ["c", "d"]], "key_value"),
        ([["a"], ["b"]], "skip"),
        ([["a", "", "", "", "", "", "", ""], ["b", "", "", "", "", "", "", ""]], "skip"),
        ([["Sub-criteria", "x", "y"], ["1", "2", "3"]], "criteria"),
        ([["x", "y"], ["first", "10 percentage"]], "scoring"),
        ([["GFR", "y", "z"], ["1", "2", "3"]], "reference"),
        ([["x", "y", "z"], ["1", "2", "3"]], "generic"),
        ([], "skip"),
        (None, "skip"),
    ],
)
def test_table_kinds(spark, grid, kind):
    rows = spark.createDataFrame([(grid,)], "g array<array<string>>")
    assert rows.select(tables.classify_table(F.col("g"))).first()[0] == kind


def test_markdown_grid(spark):
    assert one(spark, "|a|b|\n|---|:-:|\n|1||", tables.md_table_to_grid) == [["a", "b"], ["1"]]
    assert one(spark, "no table", tables.md_table_to_grid) == []


def test_running_sums_of_any_length(spark):
    rows = [(n, [(7 * i) % 11 for i in range(n)]) for n in (0, 1, 2, 3, 4, 5, 8, 9, 1000)]
    got = {r["n"]: r["s"] for r in spark.createDataFrame(rows, "n int, x array<int>").select("n", running_sums(F.coalesce("x", F.expr("CAST(array() AS array<int>)"))).alias("s")).collect()}
    assert all(got[n] == list(itertools.accumulate(x)) for n, x in rows)


def test_long_runs_of_blanks_are_read_once(spark):
    rows = [(0, " \n a" + " " * 200_000 + "b  "), (1, " " * 100_000), (2, "")]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(rows, "i int, t string").select("i", strip(F.col("t")).alias("s")).collect()}
    assert got == {0: "a" + " " * 200_000 + "b", 1: "", 2: ""}


def test_word_rules_equal_plain_regexes(spark):
    """All rules through one pass over the words give what each pattern finds by itself."""
    rng = random.Random(8)
    lists = [*feat.OBLIGATIONS.values(), *feat.PARTIES.values(), *feat.ACTIONS.values(), feat.DEFINITION, feat.PROCEDURE, feat.HIGH_RISK, feat.MEDIUM_RISK]
    pieces = [x for p in lists for part in feat._alternatives(p) for x in part] + ["means", "step", "stage", "3", ":", ";", "of", "été", "x"]
    texts = ["".join(rng.choice(pieces).upper() if rng.random() < 0.1 else rng.choice(pieces) + rng.choice([" ", " ", " ", "_", "é", "s", ",", "-", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(700)]
    hit = lambda p, t: re.search(p, t) is not None

    def plain(t):
        content = "Definition" if hit(feat.MEANS, t) or hit(feat.DEFINITION, t) else "Procedure" if hit(feat.PROCEDURE, t) or hit(feat.NUMBERED_STEP, t) else "other"
        risk = "High" if hit(feat.HIGH_RISK, t) else "Medium" if hit(feat.MEDIUM_RISK, t) else "Low"
        return (
            next((k for k, p in feat.OBLIGATIONS.items() if hit(p, t)), "Informational"), [k for k, p in feat.PARTIES.items() if hit(p, t)],
            [k for k, p in feat.ACTIONS.items() if hit(p, t)], content, risk,
        )

    x, none = F.col("x"), F.lit("")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select(
        "i", feat.obligation(x), feat.responsible_party(x), feat.action_type(x), F.regexp_replace(feat.content_type(x, none), "Clause|Heading", "other"), feat.risk_level(x, none)
    )
    for r in rows.collect():
        assert tuple(r)[1:] == plain(texts[r[0]]), texts[r[0]]


def test_keywords_of_texts_without_letters_between_others():
    import pyarrow as pa

    texts = [None, "", "loan", "loan", "ab", "the loan fee, fee", "éloané fee", "x1loan2", "zebra apple zebra apple kiwi"]
    want = [None, [], ["loan"], ["loan"], [], ["fee", "loan"], ["loan", "fee"], ["loan"], ["zebra", "apple", "kiwi"]]
    assert feat.top_words(pa.array(texts), 5).to_pylist() == want
    assert feat.top_words(pa.array(texts).slice(3, 4), 1).to_pylist() == [w[:1] for w in want[3:7]]
