import math
import random

import pytest
from pyspark.sql import functions as F

from ragworks.jobs.ingest import delete_contracts, ingest_contracts, read_contracts
from ragworks.operators import bm25, retrieve, term_index
from ragworks.schemas import PAGES
from ragworks.sources import buckets

TABLES = ("doc_stats", "postings", "term_stats", "corpus_stats")
CHUNK = "chunk_key string, doc_id long, page_content string"


def content(made):
    def plain(row):
        return tuple(round(x, 9) if isinstance(x, float) else x for x in row)

    return {n: sorted((plain(r) for r in made[n].select(sorted(made[n].columns)).collect()), key=repr) for n in TABLES}


def chunks_of(docs):
    return [(f"{d}/{i}", d, t) for d, texts in sorted(docs.items()) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_ingests_and_deletes_equals_a_rebuild(spark, tmp_path, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["the"] * 12
    path, state, sizes = str(tmp_path / "index"), {}, []
    frame = lambda docs: spark.createDataFrame(chunks_of(docs), CHUNK).coalesce(2)
    for step in range(5):
        ids = r.sample(range(6), 3)
        old = {d: state[d] for d in ids if d in state}
        new = {} if step in (2, 4) else {d: [" ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(r.randint(0, 2))] for d in ids}
        made = term_index.add_documents(frame(new), path, doc="doc_id", old=frame(old) if old else None)
        state = {d: t for d, t in {**state, **new}.items() if d not in ids or d in new}
        sizes.append(len(term_index.segments(spark, path)[1]))
        assert content(made) == content(term_index.build_term_index(frame(state)))
    assert max(sizes) > 1
    queries = spark.createDataFrame([(1, "the w1 w2"), (2, "w3 w3"), (3, "none")], "query_id long, query string")
    rebuilt = term_index.build_term_index(frame(state))
    hits = lambda made: sorted(map(tuple, retrieve.bm25_topk(queries, made, 3).collect()))
    assert hits(made) == hits(rebuilt)
    term_index.merge_segments(spark, path, everything=True)
    assert len(term_index.vacuum(spark, path)) > 1 and hits(term_index.read_index(spark, path)) == hits(rebuilt)


def test_segments_merge_by_size():
    line = lambda n: term_index.Segment(0, "s", 0, 0, n, 0)
    assert [term_index.to_merge([line(n) for n in sizes]) for sizes in ([5], [100, 40, 10], [100, 20, 10], [60, 20, 10], [100, 0], [0, 0])] == [1, 1, 2, 3, 1, 2]


def plain_bm25(texts, queries, k, allowed=None):
    split = {i: (t or "").lower().split() for i, t in texts.items()}
    n, avgdl = len(split), sum(map(len, split.values())) / len(split)
    df = {}
    for ws in split.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    out = []
    for q, text in queries.items():
        scores = []
        for i, ws in split.items():
            shared = [w for w in text.lower().split() if w in ws]
            if shared and (not allowed or not allowed[q] or i % 3 in allowed[q]):
                parts = ((w, ws.count(w)) for w in shared)
                scores.append((-round(sum(idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w, tf in parts), 6), i))
        out += [(q, i, round(-s, 5), rank + 1) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed_postings", "filtered"), [(1, False), (50, False), (1, True)])
def test_bounds_leave_out_nothing(spark, monkeypatch, seed_postings, filtered):
    monkeypatch.setattr(term_index, "BLOCK_BITS", 3)
    monkeypatch.setattr(term_index, "BLOCK", 8)
    monkeypatch.setattr(bm25, "BLOCK_BITS", 3)
    monkeypatch.setattr(bm25, "BLOCK", 8)
    r = random.Random(7)
    words = ["the", "of", "and"] * 20 + [f"w{i}" for i in range(60)]
    texts = {i: " ".join(r.choices(words, k=r.randint(1, 30))) for i in range(300)} | {300: None, 301: "", 302: "rare the", 303: "rare the"}
    queries = {q: " ".join(r.choices(words, k=6)) for q in range(20)} | {20: "the of", 21: "rare the the", 22: "unknown", 23: ""}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_key long, page_content string").repartition(3)
    made = term_index.build_term_index(chunks)
    allowed = {q: [] if q % 4 == 0 else [q % 3] for q in queries} if filtered else None
    asked = spark.createDataFrame([(q, t, allowed[q] if filtered else None) for q, t in queries.items()], "query_id long, query string, manual_ids array<long>")
    owners = chunks.select("chunk_key", (F.col("chunk_key") % 3).alias("manual_id")) if filtered else None
    found = bm25.bm25_candidates(asked, made, 5, owners=owners, seed_postings=seed_postings, direct_pairs=0)
    got = retrieve._ranked(found, 5, F.desc("score"), F.asc("chunk_key")).collect()
    assert sorted((x["query_id"], x["chunk_key"], round(x["score"], 5), x["rank"]) for x in got) == plain_bm25(texts, queries, 5, allowed)


def test_postings_of_stop_words_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK_BITS", 5)
    monkeypatch.setattr(term_index, "BLOCK", 32)
    monkeypatch.setattr(bm25, "BLOCK_BITS", 5)
    monkeypatch.setattr(bm25, "BLOCK", 32)
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["the", "of", "and", "to"], k=20) + [f"rare{i % 400}"] + r.choices([f"x{j}" for j in range(900)], k=5))) for i in range(4_000)]
    made = term_index.build_term_index(spark.createDataFrame(rows, "chunk_key long, page_content string").coalesce(1))
    queries = spark.createDataFrame([(q, f"the of and to rare{q}") for q in range(8)], "query_id long, query string")
    got = bm25.postings_read(queries, made, 5).collect()
    assert len(got) == 8 and all(x["held"] > 15_000 and x["read"] < 0.02 * x["held"] for x in got)
    pairs = bm25.bm25_candidates(queries, made, 5, direct_pairs=0)
    assert pairs.count() < 200


def test_a_query_gets_its_best_of_a_block_and_no_row_a_posting(spark):
    rows = [(i, "same words here") for i in range(600)] + [(1_000 + i, f"other x{i}") for i in range(900)]
    made = term_index.build_term_index(spark.createDataFrame(rows, "chunk_key long, page_content string").repartition(2))
    queries = spark.createDataFrame([(q, "same here x7") for q in range(30)], "query_id long, query string")
    found = bm25.bm25_candidates(queries, made, 4)
    assert found.count() <= 30 * 4 * 2  # two blocks
    best = retrieve.bm25_topk(queries, made, 4, pad=False).orderBy("query_id", "rank").collect()
    assert [r["chunk_key"] for r in best] == [1_007, 0, 1, 2] * 30


@pytest.mark.parametrize("direct_pairs", [0, 10**9])
def test_chunks_of_negative_scores_are_not_padding(spark, direct_pairs):
    texts = {i: "a b" + " a" * (i % 7) for i in range(30)}  # every term stands in every chunk, so all weights are negative
    made = term_index.build_term_index(spark.createDataFrame(list(texts.items()), "chunk_key long, page_content string"))
    queries = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    found = bm25.bm25_candidates(queries, made, 3, direct_pairs=direct_pairs).collect()
    assert sorted(r["chunk_key"] for r in found) == list(texts) and all(r["score"] < 0 for r in found)


def test_teams_of_queries_find_the_same(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(r.choices(words, k=r.randint(1, 12))) for i in range(120)}
    made = term_index.build_term_index(spark.createDataFrame(list(texts.items()), "chunk_key long, page_content string"))
    queries = {q: " ".join(r.choices(words, k=3)) for q in range(25)}
    allowed = {q: [] if q % 4 == 0 else [q % 3] for q in queries}
    asked = spark.createDataFrame([(q, t, allowed[q]) for q, t in queries.items()], "query_id long, query string, manual_ids array<long>")
    owners = spark.range(120).select(F.col("id").alias("chunk_key"), (F.col("id") % 3).alias("manual_id"))
    monkeypatch.setattr(bm25, "SCORE_VALUES", 4 * bm25.BLOCK)  # seven teams
    for own in (None, owners):
        got = retrieve.bm25_topk(asked, made, 5, pad=False, owners=own).collect()
        assert sorted((x["query_id"], x["chunk_key"], round(x["score"], 5), x["rank"]) for x in got) == plain_bm25(texts, queries, 5, allowed if own is not None else None)


def test_buckets_split_and_are_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda low, high, v: spark.range(low, high).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("piece"), F.lit(v).alias("v"))
    table, _ = buckets.replace_documents(rows(0, 300, "old"), path, bucket_rows=50)
    before = {r["bucket"]: (r["folder"], r["n"]) for r in buckets.manifest(spark, path)[1].collect()}
    assert table.count() == 600 and len(before) >= 8 and sum(n for _, n in before.values()) == 600
    table, version = buckets.replace_documents(rows(0, 2, "new"), path, bucket_rows=50)
    after = {r["bucket"]: (r["folder"], r["n"]) for r in buckets.manifest(spark, path)[1].collect()}
    moved = [b for b in before if after.get(b) != before[b]]
    assert table.count() == 600 and 0 < len(moved) <= 2 and {r["doc_id"] for r in table.where("v = 'new'").collect()} == {0, 1}
    ids = spark.createDataFrame([(0,), (5,), (999,)], "doc_id long")
    assert buckets.documents_of(spark, path, ids).count() == 4
    table, _ = buckets.replace_documents(rows(0, 0, "x"), path, ids)
    assert table.count() == 596 and buckets.read_documents(spark, path, version).count() == 600
    for _ in range(2):  # rows that grow split their buckets again
        table, _ = buckets.replace_documents(rows(300, 900, "more"), path, bucket_rows=50)
    names = [r["bucket"] for r in buckets.manifest(spark, path)[1].collect()]
    assert table.count() == 596 + 1_200 and sum(2.0 ** -len(b) for b in names) == 1
    table, _ = buckets.replace_documents(rows(0, 0, "x"), path, spark.range(0, 900).select(F.col("id").alias("doc_id")))
    assert table.count() == 0 and table.columns == ["doc_id", "piece", "v"]
    assert buckets.replace_documents(rows(7, 8, "again"), path)[0].count() == 2


def pages(spark, texts):
    return spark.createDataFrame([(n, 1, f"Section 1. Scope\n1.1 First\nThe Lender shall {t}.", None) for n, t in texts.items()], PAGES)


def test_contracts_ingested_deleted_and_ingested_again(spark, tmp_path):
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    ingest_contracts(pages(spark, {n: f"pay {n}" for n in range(6)}), path, bucket_rows=4)
    made = delete_contracts(spark.createDataFrame([(0,), (3,), (77,)], "doc_id long"), path)
    assert made["chunks"].select("doc_id").distinct().count() == 4
    made = ingest_contracts(pages(spark, {3: "wait", 4: "run", 9: "sing"}), path, bucket_rows=4)
    want = ingest_contracts(pages(spark, {1: "pay 1", 2: "pay 2", 5: "pay 5", 3: "wait", 4: "run", 9: "sing"}), other)
    assert content(made) == content(want) == content(read_contracts(spark, path))
    assert sorted(map(repr, made["chunks"].collect())) == sorted(map(repr, want["chunks"].collect()))


def test_a_failed_ingest_leaves_the_tables(spark, tmp_path, monkeypatch):
    from ragworks.jobs import ingest

    path = str(tmp_path / "a")
    ingest_contracts(pages(spark, {1: "pay", 2: "wait"}), path)
    before = content(read_contracts(spark, path))

    def broken(*_, **__):
        raise RuntimeError("no index today")

    with monkeypatch.context() as m:
        m.setattr(ingest, "add_documents", broken)
        with pytest.raises(RuntimeError):
            ingest_contracts(pages(spark, {1: "run"}), path)
    assert content(read_contracts(spark, path)) == before and read_contracts(spark, path)["chunks"].where("page_content LIKE '%run%'").count() == 0
    made = ingest_contracts(pages(spark, {1: "run"}), path)
    assert content(made) == content(ingest_contracts(pages(spark, {1: "run", 2: "wait"}), str(tmp_path / "b")))


def test_postings_of_a_block_are_gathered_without_a_shuffle(spark):
    from collections import Counter

    texts = {i: " ".join(f"w{i % 7}" for i in range(i * i % 23)) for i in range(60)}
    rows = spark.createDataFrame([(i, str(i), t.split(), len(t)) for i, t in texts.items()], "key long, doc string, tokens array<string>, size int").repartition(3)
    made = term_index._gathered(rows, 100)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of repartition
    rows = made.collect()
    docs = {r["at"]: (r["key"], r["dl"]) for r in rows if r["term"] is None}
    blocks = [r for r in rows if r["term"] is not None]
    assert sorted(docs.values()) == [(i, len(t.split())) for i, t in texts.items()]
    assert len({(r["term"], r["block"]) for r in blocks}) == len(blocks) and len({r["block"] for r in blocks}) > 3
    found = {(docs[(r["block"] << term_index.BLOCK_BITS) + o][0], r["term"]): (tf, dl) for r in blocks for o, tf, dl in zip(r["offsets"], r["tfs"], r["dls"])}
    assert found == {(i, w): (n, len(t.split())) for i, t in texts.items() for w, n in Counter(t.split()).items()}
    assert all((r["n"], r["max_tf"], r["min_dl"]) == (len(r["offsets"]), max(r["tfs"]), min(r["dls"])) for r in blocks)


def test_postings_are_written_once_where_they_were_gathered(spark, tmp_path, shuffled):
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(words, k=200))) for i in range(900)]
    spark.createDataFrame(rows, "chunk_key long, page_content string").repartition(3).write.parquet(str(tmp_path / "chunks"))
    before, path = shuffled(), str(tmp_path / "index")
    made = term_index.build_term_index(spark.read.parquet(str(tmp_path / "chunks")), path)
    assert shuffled() - before < 40_000  # the counts of 300 terms, not 146,000 postings
    assert made["postings"].count() == sum(len(set(t.split())) for _, t in rows)
    folder = f"{path}/{term_index.segments(spark, path)[1][0].segment}"
    files = spark.read.parquet(f"{folder}/blocks").where("term IS NOT NULL").select("block", F.input_file_name().alias("file")).distinct().collect()
    assert len(files) == len({f["block"] for f in files}) == len({f["file"] for f in files}) > 1


def test_rows_that_stay_in_their_bucket_are_not_shuffled(spark, tmp_path, shuffled):
    r = random.Random(3)
    rows = [(i, "".join(r.choices("abcdefghijklmnop", k=1_000))) for i in range(400)]
    path = str(tmp_path / "chunks")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "rows"))
    finish = lambda rows: rows.withColumn("more", F.concat("text", F.reverse("text")))
    before = shuffled()
    table, _ = buckets.replace_documents(spark.read.parquet(str(tmp_path / "rows")), path, bucket_rows=100, finish=finish)
    assert shuffled() - before < 600_000 and table.where("length(more) = 2000").count() == 400  # what finish makes is not shuffled
    before = shuffled()
    table, _ = buckets.replace_documents(table.where("false"), path, spark.range(0, 400, 2).select(F.col("id").alias("doc_id")))
    assert shuffled() - before < 40_000
    assert sorted(map(tuple, table.select("doc_id", "text").collect())) == rows[1::2]


def test_an_ingest_that_replaces_everything_begins_anew(spark, tmp_path):
    path = str(tmp_path / "index")
    old = spark.createDataFrame([(f"{i}/0", i, " ".join(f"w{j}" for j in range(40))) for i in range(6)], CHUNK)
    new = spark.createDataFrame([(f"{i}/0", i, "short") for i in range(6)], CHUNK)
    term_index.add_documents(old, path, doc="doc_id")
    made = term_index.add_documents(new, path, doc="doc_id", old=old)
    assert content(made) == content(term_index.build_term_index(new))
    assert [s.n_gone for s in term_index.segments(spark, path)[1]] == [0]  # no dead postings are kept beside it


def test_full_blocks_are_merged_without_a_shuffle_of_their_postings(spark, tmp_path, shuffled):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(r.choices(words, k=30)) for i in range(2 * term_index.BLOCK + 40)}
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "chunk_key long, page_content string")
    one, two = rows.where(f"chunk_key < {term_index.BLOCK + 20}").coalesce(1), rows.where(f"chunk_key >= {term_index.BLOCK + 20}").coalesce(1)
    path = str(tmp_path / "index")
    for part in (one, two):
        term_index.add_documents(part, path, merge=False)
    before = shuffled()
    term_index.merge_segments(spark, path, everything=True)
    assert shuffled() - before < 400_000  # places of chunks and counts, not 220,000 postings
    made = term_index.read_index(spark, path)
    assert len(term_index.segments(spark, path)[1]) == 1 and content(made) == content(term_index.build_term_index(rows))
    assert made["docs"].select("at").distinct().count() == len(texts)
    # a block that lost a chunk is written anew
    term_index.add_documents(rows.where("false"), path, old=rows.where("chunk_key < 3"))
    term_index.merge_segments(spark, path, everything=True)
    assert content(term_index.read_index(spark, path)) == content(term_index.build_term_index(rows.where("chunk_key >= 3")))
