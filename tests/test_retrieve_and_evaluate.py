import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragworks.operators import evaluate, index, registry, retrieve, term_index


def test_rank_fusion(spark):
    schema = "query_id long, chunk_key string, rank int"
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], schema)
    sparse = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (2, "b", 1)], schema)
    got = retrieve.rrf_merge(dense, sparse).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_key"]) for r in got] == [(1, "a"), (1, "c"), (1, "b"), (2, "a"), (2, "b")]
    assert got[0]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and max(r["rrf_score"] for r in got) <= 2 / 61


def test_dense_in_blocks_is_the_same(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    vectors = spark.createDataFrame(rows, "chunk_key long, embedding array<float>")
    queries = vectors.where("chunk_key < 7").select(F.col("chunk_key").alias("query_id"), "embedding")
    whole = sorted(map(tuple, retrieve.dense_topk(queries, vectors, 5).collect()))
    assert whole == sorted(map(tuple, retrieve.dense_topk(queries, vectors, 5, tile_values=40).collect()))
    m = np.array([v for _, v in rows[:61]], np.float32).astype(float)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in range(7):
        want = sorted(range(61), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:5]
        assert [r[1] for r in sorted((r for r in whole if r[0] == q), key=lambda r: r[3])] == want
    assert retrieve.dense_topk(queries.where("false"), vectors, 5).count() == 0


def test_dense_with_filters_ties_and_bounded_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)], i % 4 if i % 11 else None) for i in range(200)]
    vectors = spark.createDataFrame(rows, "chunk_key long, embedding array<float>, manual_id long").repartition(3)
    lists = [None, [], [1, 3], [9], [2]]
    queries = spark.createDataFrame([(q, [1.0, float(q), 0.5], x) for q, x in enumerate(lists)], "query_id long, embedding array<float>, manual_ids array<long>")
    m = np.array([v for _, v, _ in rows])
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for bound in (2_000_000, 60):
        got = retrieve.dense_topk(queries, vectors, 7, tile_values=bound).collect()
        for q, allowed in enumerate(lists):
            v = np.array([1.0, q, 0.5])
            open_ = [i for i in range(200) if not allowed or rows[i][2] in allowed]
            want = sorted(open_, key=lambda i: (-round(float(unit[i] @ v / np.linalg.norm(v)), 9), i))[:7]
            assert [r["chunk_key"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_best_places_in_steps(monkeypatch):
    monkeypatch.setattr(retrieve, "STEP", 7)
    rng = np.random.default_rng(4)
    q, v = rng.integers(-2, 3, (40, 4)).astype(float), rng.integers(-2, 3, (300, 4)).astype(float)
    kinds = rng.integers(-1, 3, 40), rng.integers(0, 4, 300)
    for own in (None, kinds):
        place, score = retrieve.best_places(q, v, 12, 100, own)
        for i in range(40):
            open_ = [j for j in range(300) if own is None or own[0][i] < 0 or own[0][i] == own[1][j]]
            want = sorted(open_, key=lambda j: (-float(q[i] @ v[j]), j))[:12]
            assert place[i].tolist() == want + [-1] * (12 - len(want)) and score[i][: len(want)].tolist() == [float(q[i] @ v[j]) for j in want]


def test_files_of_other_manuals_are_not_read(spark, tmp_path):
    rows = [(i, [1.0, i / 40], i % 8) for i in range(40)]
    stored = retrieve.write_vectors(spark.createDataFrame(rows, "chunk_key long, embedding array<float>, manual_id long"), str(tmp_path / "vectors"))
    queries = spark.createDataFrame([(1, [1.0, 0.0], [2, 2, 5]), (2, [1.0, 1.0], [5])], "query_id long, embedding array<float>, manual_ids array<long>")
    _, routed = retrieve._routes(queries, stored, "chunk_key")
    routed.select("route", "embedding").write.format("noop").mode("overwrite").save()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", routed._jdf.queryExecution().executedPlan().toString())[1]
    assert re.search(r"manual_id#\d+L? IN \((2,5|5,2)\)", filters)
    got = retrieve.dense_topk(queries, stored, 3).collect()
    assert sorted((r["query_id"], r["chunk_key"]) for r in got if r["rank"] == 1) == [(1, 2), (2, 37)]


def test_policy_search_fills_its_list_from_the_allowed_manuals(spark):
    rows = [(i, f"word{i % 5} text", i % 3, [1.0, i / 40]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_key long, page_content string, manual_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "word1 text", [1.0, 0.1], [2]), (2, "word1", [1.0, 0.9], None)], "query_id long, query string, embedding array<float>, manual_ids array<long>")
    hits = retrieve.policy_retrieve(queries, chunks.select("chunk_key", "embedding", "manual_id"), term_index.build_term_index(chunks), chunks.drop("embedding"), 12).collect()
    assert [sum(r["query_id"] == q for r in hits) for q in (1, 2)] == [12, 12]
    assert {r["manual_id"] for r in hits if r["query_id"] == 1} == {2}


def test_encoder_equals_a_plain_one(spark, data):
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(30).collect()] + ["", None, "a A b"]
    got = index.embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, page_content string")).collect()
    for r in got:
        want = [0.0] * 64
        for word in (texts[r["i"]] or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            want[h % 64] += 1 if h >= 1 << 63 else -1
        length = math.sqrt(sum(x * x for x in want)) or 1
        assert r["embedding"] == pytest.approx([x / length for x in want], abs=1e-6)


def test_rerank_with_a_scorer(spark):
    rows = spark.createDataFrame([(1, "a", 1, "q", "x"), (1, "b", 2, "q", "xxx"), (1, "c", 3, "q", None)], "query_id long, chunk_key string, rank int, query string, page_content string")
    got = retrieve.rerank(rows, 3, lambda queries, texts: [len(t) / 10 if t else float("nan") for t in texts]).orderBy("rank").collect()
    assert [(r["chunk_key"], r["score"]) for r in got] == [("c", 0.998), ("b", 0.3), ("a", 0.1)]


def test_status_of_manuals_without_an_event_stays(spark):
    manuals = spark.createDataFrame([(1, "failed", "old"), (2, "failed", "old"), (3, "indexing", None)], "id long, status string, error string")
    events = spark.createDataFrame([(2, "failed", "new", 1, 1), (2, "active", None, 2, 2), (3, "failed", "bad", 1, 3)], "id long, status string, error string, ts long, event_id long")
    got = {r["id"]: (r["status"], r["error"]) for r in registry.apply_status(manuals, events).collect()}
    assert got == {1: ("failed", "old"), 2: ("active", None), 3: ("failed", "bad")}
    assert registry.apply_status(manuals.drop("error"), events).where("id = 1").first()["error"] is None


def test_padding_and_ties(spark):
    chunks = spark.createDataFrame([(1, "red"), (2, "blue sky"), (3, "blue sky"), (4, None), (5, "green")], "chunk_key long, page_content string")
    made = term_index.build_term_index(chunks)
    queries = spark.createDataFrame([(1, "blue"), (2, "none"), (3, None)], "query_id long, query string")
    got = retrieve.bm25_topk(queries, made, 4).orderBy("query_id", "rank").collect()
    assert [r["chunk_key"] for r in got] == [2, 3, 1, 4, 1, 2, 3, 4, 1, 2, 3, 4]
    assert retrieve.bm25_topk(queries, made, 4, pad=False).count() == 2
    assert index.index_count(chunks).first()["n"] == 5
    empty = term_index.build_term_index(chunks.where("false"))
    assert retrieve.bm25_topk(queries, empty, 4).count() == 0


def test_encoder_waits_then_fails(spark):
    texts = spark.createDataFrame([("a b",), (None,)], "page_content string")
    got = index.embed(texts).collect()
    assert np.linalg.norm(got[0]["embedding"]) == pytest.approx(1, abs=1e-6) and not any(got[1]["embedding"])

    def limited():
        calls = []

        def encode(batch):
            calls.append(1)
            if len(calls) < 3:
                raise index.RateLimited
            return [[1.0] for _ in batch]

        return encode

    assert index.embed(texts.coalesce(1), limited, wait_s=0.0).count() == 2
    with pytest.raises(Exception, match="RateLimited"):
        index.embed(texts.coalesce(1), limited, attempts=1, wait_s=0.0).collect()


def test_recall_rules(spark):
    run = spark.createDataFrame([(1, "x", 1), (2, "e", 4), (3, None, None), (5, "x", 1)], "query_id long, chunk_id string, rank int")
    expected = spark.createDataFrame([(1, None), (2, "e"), (3, None), (4, None), (5, "e")], "query_id long, expected_chunk_id string")
    recall = {r[0]: r[1] for r in evaluate.retrieval_recall(run, expected).collect()}
    rank = {r[0]: r[1] for r in evaluate.reciprocal_rank(run, expected).collect()}
    assert recall == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert rank == {1: 1.0, 2: 0.25, 3: 1.0, 4: 0.0, 5: 0.0}


def test_recall_grows_with_k(spark, data):
    from ragworks.jobs.queries import QUERIES

    rows = QUERIES["v_limit_sweep"](spark, data).collect()
    for limit in evaluate.LIMITS:
        curve = [r["recall"] for r in sorted((r for r in rows if r["limit"] == limit), key=lambda r: r["k"])]
        assert curve == sorted(curve) and len(curve) == len(evaluate.CUTS)


def test_grades(spark):
    rows = spark.createDataFrame([("correctness", '{"correct": "TRUE"}'), ("correctness", '{"correct": "yes"}'), ("relevance", "junk"), ("groundedness", None)], "kind string, verdict string")
    assert [r["grade"] for r in evaluate.parse_grades(rows).collect()] == [True, False, False, False]


def test_registry(spark):
    incoming = spark.createDataFrame([(1, "h1", "a.pdf"), (2, "h1", "b.pdf"), (3, "h2", "c.PDF"), (4, None, "d.pdf"), (5, None, None)], "upload_id long, file_hash string, filename string")
    manuals = spark.createDataFrame([("h2",)], "file_hash string")
    accepted, rejected = registry.admit_uploads(incoming, manuals, contract=True)
    assert sorted(r["upload_id"] for r in accepted.collect()) == [1, 4]
    assert {r["upload_id"]: r["reason"] for r in rejected.collect()} == {2: "already indexed", 3: "already indexed", 5: "not a pdf"}
    logs = spark.createDataFrame([(1, None), (2, 1)], "id long, feedback int")
    votes = spark.createDataFrame([(1, 1, 10, 1), (1, -1, 10, 2), (9, 1, 1, 3)], "log_id long, value int, ts long, event_id long")
    updated, unknown = registry.apply_feedback(logs, votes)
    assert {r["id"]: r["feedback"] for r in updated.collect()} == {1: -1, 2: 1}
    assert [r["log_id"] for r in unknown.collect()] == [9]
    uploads = spark.createDataFrame([], "doc_id string, filename string, status string, error string")
    assert registry.list_documents(uploads, logs).first()["n_chunks"] == 2
    assert registry.list_documents(uploads, logs.where("false")).count() == 0
    newest = registry.list_manuals(spark.createDataFrame([(1, "2020-01-01"), (2, "2021-01-01"), (3, "2021-01-01")], "id long, created_at string"))
    assert [r["id"] for r in newest.collect()] == [2, 3, 1]


def test_hybrid_finds_the_text_itself(spark, data):
    from ragworks.jobs.queries import QUERIES

    hits = QUERIES["r_hybrid"](spark, data).collect()
    per_query = {}
    for r in hits:
        per_query.setdefault(r["query_id"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and 10 <= len(v) <= 20 for v in per_query.values())


def test_hybrid_search_does_not_shuffle_texts(spark, data, shuffled):
    from ragworks.jobs.queries import _hybrid_tables
    from ragworks.jobs.registered import Tables

    t = Tables(spark, data)
    before, size = shuffled(), t.documents.selectExpr("sum(octet_length(text))").first()[0]
    queries, chunks, made = _hybrid_tables(t)
    assert shuffled() - before < size  # vectors and counts of terms
    assert chunks.count() == made["doc_stats"].count() == t.documents.count() and queries.count() == t.benchmark.count()


def test_sweep_by_label_makes_no_pairs(spark):
    docs = spark.range(2_000).selectExpr("id AS doc_id", "CASE WHEN id % 50 < 49 THEN id % 5 END AS label")
    queries = docs.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")
    best = queries.selectExpr("query_id", "explode(sequence(1, 60)) AS rank").selectExpr("query_id", "(query_id * 3 + rank * 11) % 2000 AS doc_id", "rank")
    run = best.selectExpr("explode(array(10, 50)) AS `limit`", "*").where("rank <= `limit`")
    pairs = queries.join(docs, "label").select("query_id", "doc_id")
    got, wanted = evaluate.label_sweep(run, queries, docs), evaluate.limit_sweep(run, pairs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_few_hits_go_to_the_texts(spark, tmp_path):
    from ragworks.jobs.queries import _described

    spark.range(3_000).selectExpr("id AS doc_id", "repeat(sha2(CAST(id AS STRING), 256), 4) AS text").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    hits = spark.createDataFrame(spark.sparkContext.parallelize([(1, 5, 1), (1, 7, 2)]), "query_id long, doc_id long, rank int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan(hits.join(docs, "doc_id"))  # all texts are dealt out
        assert "SortMergeJoin" not in plan(_described(hits, docs)) and _described(hits, docs).count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
