from pyspark.sql import functions as F

from ragworks.operators import structure
from ragworks.schemas import PAGES


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_contract_chunks_of_one_document(spark):
    text = "Section 10. Warranties\n10.1 First part\nThe Lender shall pay.\n10.2 Promises\nA. one\nB. two\n10.3 Last part\nend"
    grid = [["Risk", "Fix"], ["late", "plan"]]
    got = structure.contract_chunks(pages(spark, [(1, 1, text, [grid, grid]), (1, 2, None, None), (2, 1, "", None)])).orderBy("chunk_type", "seq").collect()
    ids = [r["chunk_id"] for r in got]
    assert ids == ["sec_10_1", "sec_10_2_warranties_1_3", "sec_10_3", "table_p1_t0_key_value", "table_p1_t1_key_value_dup"]
    assert got[1]["obligations_of"] == "Lender" and got[1]["warranty_range"] == "1-3" and got[1]["warranty_total"] == 3
    # the overlap behind a warranty is that of the sub-section before it
    assert "[...continued from previous]\n10.1 First part\nThe Lender shall pay." in got[2]["page_content"]
    assert [r["prev_chunk_id"] for r in got[:3]] == ["", "sec_10_1", "sec_10_2_warranties_1_3"]
    assert [r["next_chunk_id"] for r in got[:3]] == ["sec_10_2_warranties_1_3", "sec_10_3", ""]
    assert got[3]["is_duplicate"] is False and got[4]["canonical_chunk_id"] == "table_p1_t0_key_value"
    assert got[3]["page_range"] == [1, 1] and got[3]["context_heading"] == "10.3 Last part"


def test_title_in_capitals_ends_with_its_page(spark):
    docs = structure.join_pages(pages(spark, [(1, 1, "Section 3. Scope\nsome text.\nA", None), (1, 2, "GENERAL CONDITIONS\n\nPART B\nmore", None), (2, 1, None, None)]))
    found = [(r["title"], r["start"]) for r in structure.headers(docs).orderBy("doc_id", "start").collect()]
    assert found == [("Scope", 0), ("GENERAL CONDITIONS\n\nPART B", 30)]
    spans = structure.section_spans(docs).orderBy("start").collect()
    assert [(r["title"], r["start"], r["end"], r["page_range"]) for r in spans] == [("Scope", 0, 30, [1, 1]), ("GENERAL CONDITIONS\n\nPART B", 30, 61, [2, 2])]


def test_oversized_section_is_packed(spark):
    body = "\n\n".join(f"Paragraph {i} " + "x" * 1000 for i in range(8))
    docs = structure.join_pages(pages(spark, [(1, 1, f"Section 3. Long one\n\n{body}", None)]))
    got = structure.section_chunks(docs).orderBy("seq").collect()
    assert [r["chunk_id"] for r in got] == [f"sec_3_main_part{i + 1}" for i in range(len(got))] and len(got) > 1
    assert all(r["token_count"] <= 800 for r in got)


def test_warranty_group_sizes(spark):
    rows = spark.range(1, 60).select(F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: i.cast("string")).alias("items"))
    for r in rows.select(F.size("items").alias("n"), structure.warranty_groups(F.col("items")).alias("g")).collect():
        sizes = [g["last"] - g["first"] + 1 for g in r["g"]]
        assert sum(sizes) == r["n"] and all(s == 9 for s in sizes[:-1]) and (len(sizes) == 1 or 5 <= sizes[-1] <= 13)
    known = {37: [9, 9, 9, 10], 13: [13], 14: [9, 5], 4: [4]}
    got = {r["n"]: [g["last"] - g["first"] + 1 for g in r["g"]] for r in rows.select(F.size("items").alias("n"), structure.warranty_groups(F.col("items")).alias("g")).collect()}
    assert {k: got[k] for k in known} == known
    empty = spark.sql("SELECT CAST(array() AS array<string>) AS items").select(structure.warranty_groups(F.col("items")).alias("g"))
    assert empty.first()["g"] == []


def test_repeated_ids(spark):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate("aaba")], "doc_id long, seq int, base_id string")
    got = structure.link_chunks(structure.dedupe_chunk_ids(rows)).orderBy("seq").collect()
    assert [r["chunk_id"] for r in got] == ["a", "a_dup1", "b", "a_dup2"]
    assert [r["prev_chunk_id"] for r in got[1:]] == [r["chunk_id"] for r in got[:-1]]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], PAGES)
    assert structure.contract_chunks(empty).count() == 0
    assert structure.policy_chunks(empty.drop("tables")).count() == 0


def test_same_result_with_other_partitions(spark, data):
    from ragworks.jobs.queries import QUERIES

    def rows():
        return sorted(map(tuple, QUERIES["s_section_chunks"](spark, data).collect()), key=repr)

    wide = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows() == wide
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pieces_overlap_by_so_much_at_most_and_lose_nothing(spark):
    text = " ".join(f"word{i}" for i in range(2000))
    pieces = [r["page_content"] for r in structure.policy_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("piece").collect()]
    at = 0
    for a, b in zip(pieces, pieces[1:]):
        shared = next(n for n in range(min(len(a), len(b)), -1, -1) if a.endswith(b[:n]))
        assert 0 < shared <= 200 and len(a) <= 1000
        assert text[at : at + len(a)] == a
        at += len(a) - shared
    assert text.endswith(pieces[-1]) and at + len(pieces[-1]) == len(text)


def test_pages_of_many_spans():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 50, 400)
    page_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    numbers = np.arange(1, 401) * 2
    starts = np.sort(rng.integers(0, sizes.sum() + 100, 300))
    ends = starts + rng.integers(0, 500, 300)
    got = structure.span_pages(starts, ends, numbers, page_starts, sizes)
    for s, e, (low, high) in zip(starts, ends, got):
        first = [p for p in range(400) if page_starts[p] + sizes[p] > s]
        last = [p for p in first if page_starts[p] < e]
        assert (low, high) == ((1, 1) if not first else (numbers[first[0]], numbers[(last or first[:1])[-1]]))
    assert structure.span_pages(starts, ends, *[np.zeros(0, int)] * 3).tolist() == [[1, 1]] * 300
    many = np.arange(20_000) * 10
    assert (structure.span_pages(many, many + 10, np.arange(20_000), many, np.full(20_000, 10))[:, 0] == np.arange(20_000)).all()


def test_terms_of_each_document_alone(spark):
    chunks = spark.createDataFrame([(1, "The Bond and the Lender's Bonds"), (1, None), (2, "The Bond, a Fee"), (3, "Bond"), (None, "Bond")], "doc_id long, page_content string")
    definitions = spark.createDataFrame([(1, "Bond"), (1, "Bonds"), (1, "ender"), (1, "Fee"), (2, "Fee"), (2, "Fee")], "doc_id long, term string")
    got = structure.defined_terms_present(chunks, definitions).collect()
    assert sorted((r["doc_id"] or 0, r["def_terms_present"]) for r in got) == [(0, []), (1, []), (1, ["Bond", "Bonds", "ender"]), (2, ["Fee"]), (3, [])]


def test_thousands_of_terms_in_one_document(spark):
    import time

    definitions = spark.range(2_000).selectExpr("1L AS doc_id", "concat('Term ', id, '.') AS term")
    chunks = spark.range(3_000).selectExpr("1L AS doc_id", "concat(repeat('some words ', 50), 'Term ', id % 2500, '. more') AS page_content").coalesce(1)
    began = time.time()
    got = structure.defined_terms_present(chunks, definitions).selectExpr("sum(size(def_terms_present)) AS n").first()["n"]
    assert got == 2_500 and time.time() - began < 60


def test_counts_of_all_layers_come_from_one_scan_of_the_pages(spark, data):
    from ragworks.jobs.queries import QUERIES

    plan = QUERIES["s_all_layers_counts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 6  # 11 where two aggregations each make the chunks
