import json

import pytest
from pyspark.sql import functions as F

from ragworks.jobs.ingest import ingest_contracts
from ragworks.operators import index, registry
from ragworks.schemas import EVAL_ANSWERS, EVAL_PAGES, PAGES
from ragworks.sources import io
from ragworks.streaming.ingest import NO_TEXT, PAGE_FILES, current_chunks, current_uploads, ingest_batch, ingest_stream


def test_raw_files_and_cache(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.bin").write_bytes(b"one")
    (tmp_path / "raw/b.bin").write_bytes(b"two")
    files = io.read_raw_files(spark, str(tmp_path / "raw"))
    known = files.where(F.col("path").endswith("a.bin")).first()["file_hash"]
    (tmp_path / "cache").mkdir()
    (tmp_path / f"cache/{known}.json").write_text(json.dumps([{"page_number": 1, "text": "t", "tables": [[["c", None]]]}]))
    (tmp_path / "cache/broken.json").write_text("{not json")
    cache = io.read_pages_cache(spark, str(tmp_path / "cache"))
    assert [(r["file_hash"], r["page_number"], r["tables"]) for r in cache.collect()] == [(known, 1, [[["c", None]]])]
    assert [r["path"][-5:] for r in io.needs_parse(files, cache).collect()] == ["b.bin"]


def test_eval_sets_and_csv(spark, tmp_path):
    io.write_eval_set(spark.createDataFrame([("q", "a")], EVAL_ANSWERS), str(tmp_path / "a"))
    assert io.read_eval_set(spark, str(tmp_path / "a"), EVAL_ANSWERS).collect() == [("q", "a")]
    io.write_eval_set(spark.createDataFrame([("q", ["2", "3"])], EVAL_PAGES), str(tmp_path / "b"))
    assert io.read_eval_set(spark, str(tmp_path / "b"), EVAL_PAGES).first()["sources"] == ["2", "3"]
    io.write_feature_csv(spark.createDataFrame([("x", 'say "a", b')], "`Chunk ID` string, t string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect() == [("x", 'say "a", b')]


def test_delete_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", "old"), (None, "b", "old")], "doc_id long, chunk_id string, v string")
    new = spark.createDataFrame([(1, "a", "new"), (2, "c", "new"), (2, "c", "new")], "doc_id long, chunk_id string, v string")
    got = index.upsert_chunks(index.upsert_chunks(old, new), new)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, [*new.distinct().collect(), old.collect()[1]]))
    gone = spark.createDataFrame([(1,)], "manual_id long")
    assert index.delete_document(got.withColumnRenamed("doc_id", "manual_id"), gone).count() == 2


def test_stream_takes_each_file_once(spark, tmp_path):
    source, tables = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()

    def put(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run(encoder=index.hashing_encoder):
        ingest_stream(spark, str(source), tables, str(tmp_path / "check"), encoder).awaitTermination()
        uploads = {r["id"]: (r["file_hash"], r["status"], r["error"]) for r in current_uploads(spark, tables).collect()}
        return sorted((r["doc_id"], r["piece"]) for r in current_chunks(spark, tables).collect()), uploads

    page = {"doc_id": 1, "file_hash": "h1", "filename": "a.pdf", "page_number": 1, "text": "word " * 300}
    put("1.json", [page, {**page, "page_number": 2, "text": None}, {**page, "doc_id": 7, "file_hash": "h7", "text": " "}])
    first = run()
    assert first == ([(1, 0), (1, 1)], {1: ("h1", "active", None), 7: ("h7", "failed", NO_TEXT)})
    assert run() == first
    # known content, new content of a known upload, a failed one again, no hash
    put("2.json", [{**page, "doc_id": 2}, {**page, "file_hash": "h3", "text": "short"}, {**page, "doc_id": 7, "file_hash": "h7", "text": "now"}, {**page, "doc_id": 8, "file_hash": None, "text": "x"}])
    second = run()
    assert second == ([(1, 0), (7, 0), (8, 0)], {1: ("h3", "active", None), 7: ("h7", "active", None), 8: (None, "active", None)})
    rejected = spark.read.parquet(f"{tables}/uploads").where("reason IS NOT NULL").collect()
    assert [(r["upload_id"], r["reason"]) for r in rejected] == [(2, "already indexed")]
    ingest_batch(spark.read.schema(PAGE_FILES).json(str(source / "2.json")), 1, tables)  # the batch runs again
    assert (sorted((r["doc_id"], r["piece"]) for r in current_chunks(spark, tables).collect()), run()[1]) == second

    def broken():
        def encode(texts):
            raise RuntimeError("no encoder today")

        return encode

    put("3.json", [{**page, "doc_id": 9, "file_hash": "h9", "text": "lost"}])
    chunks, uploads = run(broken)
    assert chunks == second[0] and uploads[9][1] == "failed" and "no encoder today" in uploads[9][2]


def test_contracts_taken_in_again_replace_their_chunks(spark, tmp_path):
    def pages(n, text):
        return spark.createDataFrame([(n, 1, f"Section 1. Scope\n1.1 First\nThe Lender shall {text}.", None)], PAGES)

    path = str(tmp_path / "tables")
    for _ in range(2):
        ingest_contracts(pages(1, "pay"), path, bucket_rows=2)
    assert ingest_contracts(pages(2, "wait"), path, bucket_rows=2)["chunks"].count() == 2
    made = ingest_contracts(pages(1, "run"), path, bucket_rows=2)
    rows = made["chunks"].collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2] and all(len(r["embedding"]) == 64 and r["features"]["obligation"] == "Mandatory" for r in rows)
    terms = {r["term"]: r["df"] for r in made["term_stats"].collect()}
    assert terms["shall"] == 2 and "pay." not in terms and terms["run."] == 1


def test_shared_folder_is_asked_for():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        io.new_folder(Session)


def test_admission_takes_the_first_upload_of_a_content(spark):
    rows = [(3, "h", "a.pdf"), (2, "h", "b.pdf"), (2, "h", "b.pdf"), (9, "h", "c.txt"), (4, None, "d.pdf"), (5, None, "d.pdf"), (6, "k", None), (7, "k", "e.pdf"), (8, "old", "f.pdf")]
    incoming = spark.createDataFrame(rows, "upload_id long, file_hash string, filename string")
    manuals = spark.createDataFrame([("old",), (None,)], "file_hash string")
    accepted, rejected = registry.admit_uploads(incoming, manuals, contract=True)
    assert sorted(r["upload_id"] for r in accepted.collect()) == [2, 4, 5, 7]
    assert sorted((r["upload_id"], r["reason"]) for r in rejected.collect()) == [(2, "already indexed"), (3, "already indexed"), (6, "not a pdf"), (8, "already indexed"), (9, "not a pdf")]


def test_an_upload_with_two_contents_in_a_batch_has_the_last(spark, tmp_path):
    from ragworks.streaming.ingest import ingest_batch

    schema = "doc_id long, file_hash string, filename string, page_number int, text string, file_time timestamp, file_name string"
    rows = [(1, "h2", "b.pdf", 1, "first", None, "1.json"), (1, "h1", "a.pdf", 1, "second", None, "2.json"), (1, "h1", "a.pdf", 2, "third", None, "2.json")]
    tables = str(tmp_path / "tables")
    ingest_batch(spark.createDataFrame(rows, schema), 0, tables)
    assert [(r["id"], r["file_hash"], r["filename"]) for r in current_uploads(spark, tables).collect()] == [(1, "h1", "a.pdf")]
    assert sorted(r["page_content"] for r in current_chunks(spark, tables).collect()) == ["second", "third"]


def test_search_over_what_the_stream_took_in(spark, tmp_path):
    from ragworks.operators import retrieve, term_index
    from ragworks.streaming.ingest import search_tables

    schema = "doc_id long, file_hash string, filename string, page_number int, text string"
    tables = str(tmp_path / "tables")
    first = [(i, f"h{i}", f"p{i}.pdf", 1, f"cover number {i} of the policy " * 3) for i in range(6)] + [(None, None, "x.pdf", 1, "nobody knows")]
    ingest_batch(spark.createDataFrame(first, schema), 0, tables)
    for _ in range(2):  # the second batch runs again
        ingest_batch(spark.createDataFrame([(2, "n2", "p2.pdf", 1, "dental cover"), (9, "h0", "p9.pdf", 1, "known"), (3, "n3", "p3.pdf", 1, " ")], schema), 1, tables)
    chunks, made = search_tables(spark, tables)
    assert {r["doc_id"]: r["page_content"][:12] for r in chunks.collect()} == {i: f"cover number"[:12] for i in (0, 1, 4, 5)} | {2: "dental cover", None: "nobody knows"}
    rebuilt = term_index.build_term_index(chunks.select("chunk_key", "page_content"))
    for name in ("term_stats", "corpus_stats", "doc_stats", "postings"):
        assert sorted(map(repr, made[name].select(rebuilt[name].columns).collect())) == sorted(map(repr, rebuilt[name].collect()))
    queries = index.embed(spark.createDataFrame([(1, "dental cover", [2, 4]), (2, "policy", None)], "query_id long, page_content string, manual_ids array<long>")).withColumnRenamed("page_content", "query")
    hits = retrieve.policy_retrieve(queries, chunks.select("chunk_key", "embedding", "manual_id"), made, chunks.select("chunk_key", "manual_id", "page_content"), 3).collect()
    assert [r["manual_id"] for r in sorted(hits, key=lambda r: r["rank"]) if r["query_id"] == 1] == [2, 4]
    assert sum(r["query_id"] == 2 for r in hits) == 3


def test_a_file_for_each_key_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FILES_PER_TASK", 10)
    rows = spark.range(45).selectExpr("id AS k", "concat('text ', id) AS text").coalesce(1)
    io.write_each(rows, "k", f"file://{tmp_path}/each", "text")
    names = [p.name for p in (tmp_path / "each").glob("*/*.txt")]
    assert len(names) == 45 and len({n.split("-")[1] for n in names}) > 1
    got = io.read_raw_files(spark, f"file://{tmp_path}/each", "*.txt")
    assert sorted(bytes(r["content"]).decode() for r in got.collect()) == sorted(f"text {i}\n" for i in range(45))
