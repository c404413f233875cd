import hashlib
import time
from functools import partial
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragworks.jobs.ingest import ingest_contracts
from ragworks.operators.index import RateLimited
from ragworks.operators.lanes import answer_requests_of_lane, embed_in_lanes, read_vectors


def logging_encoder(log, fail_at=None, limited=False):
    """Writes the texts of each request that it answers to a file of its own; fails at the request of one text, until a flag file is there."""

    def encode(texts):
        flag = Path(log) / "failed"
        if fail_at in texts and not flag.exists():
            flag.touch()
            raise RateLimited() if limited else RuntimeError("broken")
        name = Path(log) / f"asked-{time.time_ns()}-{abs(hash(tuple(texts)))}"
        name.write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    return encode


def asked(log):
    return sorted(t for p in Path(log).glob("asked-*") for t in p.read_text().split("\n"))


def test_nothing_is_asked_for_twice_after_a_failure(spark, tmp_path):
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(200, None), (201, ""), (202, None)]
    texts = spark.createDataFrame(rows, "i int, page_content string").repartition(5)
    log, store = tmp_path / "log", f"file://{tmp_path}/store"
    log.mkdir()
    middle = sorted({t or "" for _, t in rows}, key=lambda t: hashlib.sha256(t.encode()).hexdigest())[20]
    # one lane, as a failure ends the tasks of the others amid a request
    ask = lambda: embed_in_lanes(texts, partial(logging_encoder, str(log), middle), store, lanes=1, batch=4)
    with pytest.raises(Exception, match="broken"):
        ask()
    before = asked(log)
    assert len(before) == 20 and middle not in before
    got = {r["i"]: list(r["embedding"]) for r in ask().collect()}
    assert asked(log) == sorted({t or "" for _, t in rows})
    assert got == {i: [float(len(t or "")), 1.0] for i, t in rows}
    assert ask().count() == len(rows) and len(asked(log)) == 41  # all from the store
    assert read_vectors(spark, store).count() == 41


def test_a_lane_that_runs_again_leaves_out_what_is_answered(tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = pd.DataFrame({"hash": [f"h{i:02}" for i in range(23)], "text": [f"t{i}" for i in range(23)]})
    run = lambda step: list(answer_requests_of_lane((rows[i : i + step] for i in range(0, 23, step)), f"file://{tmp_path}/requests", partial(logging_encoder, str(log), "t13"), 5, 0.0, 1, 0.0))
    with pytest.raises(RuntimeError):
        run(7)
    assert len(asked(log)) == 10
    (again,) = run(3)  # other bounds of the batches, the same requests
    assert again.iloc[0].tolist() == [3, 2] and asked(log) == sorted(rows["text"])


def test_a_lane_keeps_its_pace_and_waits_out_a_limit(tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = pd.DataFrame({"hash": [str(i) for i in range(6)], "text": [f"t{i}" for i in range(6)]})
    start = time.monotonic()
    list(answer_requests_of_lane(iter([rows]), f"file://{tmp_path}/requests", partial(logging_encoder, str(log), "t2", True), 2, 0.2, 2, 0.01))
    assert time.monotonic() - start >= 0.4 and asked(log) == sorted(rows["text"])


def test_rounds_empty_tables_and_other_columns(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    texts = spark.createDataFrame([(i, f"x{i}", i) for i in range(30)], "hash int, page_content string, embedding int")
    make = partial(logging_encoder, str(log))
    got = embed_in_lanes(texts, make, f"file://{tmp_path}/a", lanes=2, batch=2, round_requests=4)
    assert sorted((r["hash"], r["embedding"][0]) for r in got.collect()) == [(i, float(len(f"x{i}"))) for i in range(30)]
    assert len(asked(log)) == 30 and not (tmp_path / "a" / "requests").exists()
    assert embed_in_lanes(texts.where("false"), make, f"file://{tmp_path}/b").count() == 0
    with pytest.raises(ValueError):
        embed_in_lanes(texts)


def test_contracts_with_an_encoder_in_lanes(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "Section 1. Scope\n1.1 First Rules\nOne."), (1, 2, "1.2 More Rules\nTwo.")], "doc_id long, page_number int, text string")
    pages = pages.withColumn("tables", F.lit(None).cast("array<array<array<string>>>"))
    log = tmp_path / "log"
    log.mkdir()
    lanes = partial(embed_in_lanes, store=f"file://{tmp_path}/store", lanes=2)
    for _ in range(2):  # the second time nothing is new
        made = ingest_contracts(pages, f"file://{tmp_path}/contracts", partial(logging_encoder, str(log)), embedder=lanes)
    rows = made["chunks"].collect()
    assert len(rows) == 2 and all(r["embedding"][0] == len(r["page_content"]) for r in rows)
    assert len("\n".join(asked(log)).split("[Document")) - 1 == 2
