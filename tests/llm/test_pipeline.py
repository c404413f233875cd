import pytest

import corpus_pipeline
from ragworks.llm import decontamination
from ragworks.llm.common import documents, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_documents(spark, data):
    docs = documents(spark, data)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, data), name)
        if name != "bpe":
            assert docs.columns == COLUMNS
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        kept[name] = docs
    toxic = {r["doc_id"] for r in table(spark, data, "labels").where("toxic = 1").collect()}
    assert len(toxic & {r["doc_id"] for r in kept["toxicity"].collect()}) < len(toxic)
    assert kept["line_dedup"].count() == kept["toxicity"].count()
    texts = [r["text"] for r in kept["simhash_near_dedup"].collect()]
    assert len(texts) == len(set(texts))
    assert decontamination.contaminated(kept["decontamination"], table(spark, data, "benchmark")).count() == 0
    assert kept["bpe"].count() == kept["decontamination"].count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]


def test_run_gives_the_rows_of_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert all(len(r["ids"]) == r["n_tokens"] for r in out.collect())


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_rows(spark, data, place):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "word " * 20_000, "en", None, 5), (4, "é", None, "s", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    name, stage = corpus_pipeline.STAGES[place]
    got = stage(spark, docs, data)
    assert got.count() == (3 if name == "simhash_near_dedup" else 5)
    assert place == 4 or got.columns == docs.columns
    assert stage(spark, docs.where("false"), data).count() == 0
