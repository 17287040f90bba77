"""Places of rows in a source without ids, and the first rows of a stream."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stratavec.plans import queries as Q
from stratavec.plans.capture import sampled_positions
from stratavec.sources import corpus
from stratavec.streaming import live


@pytest.fixture()
def parts(tmp_path):
    """Files whose rows are in no order of any column."""
    folder = tmp_path / "parts"
    folder.mkdir()
    texts, n = [], 0
    for k, size in enumerate((700, 0, 1, 1300, 50)):
        own = [f"text {(i * 7919) % 4096} of {k}" for i in range(n, n + size)]
        table = pa.table({"text": pa.array(own, pa.string()), "note": pa.array([k] * size, pa.int64())})
        pq.write_table(table, folder / f"part-{k:02d}.parquet", row_group_size=100)
        texts, n = texts + own, n + size
    return str(folder), texts


def test_places_are_those_of_the_files(spark, parts):
    folder, texts = parts
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # several splits of a file
    try:
        rows = corpus.scan_in_order(spark, folder, keep=("note",))
        got = {r["example_id"]: r["text"] for r in rows.collect()}
        assert rows.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(texts))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    for shuffle in ("Exchange hash", "Exchange range", "Exchange Single", "Sort"):
        assert shuffle not in plan


def test_first_rows_as_they_lie(spark, parts):
    folder, texts = parts
    for limit in (1, 700, 701, 900, 5000, 0):
        rows = corpus.scan_in_order(spark, folder, limit=limit)
        assert {r["example_id"]: r["text"] for r in rows.collect()} == dict(enumerate(texts[:limit]))
    assert len(corpus.scan_in_order(spark, folder, limit=701).inputFiles()) == 2
    # such a corpus can be captured
    sampled = sampled_positions(corpus.scan_in_order(spark, folder, limit=50), Q.D.SETTINGS)
    assert sampled.filter("example_id >= 50").count() == 0


def stream_of(spark, folder, files=1):
    return corpus.corpus_stream(
        spark, folder, "text string, note bigint", id_col="note", files_per_trigger=files, places=True
    )


def taken(spark, path):
    return sorted(r["text"] for r in spark.read.schema("example_id bigint, text string").parquet(path).collect())


@pytest.mark.parametrize("limit", [1, 650, 800, 2051, 9000])
def test_rows_taken_over_micro_batches(spark, parts, tmp_path, limit):
    folder, texts = parts
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # started again with nothing new
        live.run_taken(stream_of(spark, folder), limit, path, state)
    got = taken(spark, path)
    assert len(got) == min(limit, len(texts))
    if limit <= 700 or limit >= len(texts):
        assert got == sorted(texts[:limit])


def test_rows_taken_go_on_after_a_restart(spark, parts, tmp_path):
    folder, texts = parts
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.run_taken(stream_of(spark, folder), 2060, path, state)
    assert taken(spark, path) == sorted(texts)
    more = pa.table({"text": [f"later {i}" for i in range(90)], "note": pa.array([9] * 90, pa.int64())})
    pq.write_table(more, f"{folder}/part-99.parquet")
    live.run_taken(stream_of(spark, folder), 2060, path, state)
    got = taken(spark, path)
    assert len(got) == 2060 and sum(t.startswith("later") for t in got) == 2060 - len(texts)
    # a batch that is run again replaces its own rows
    live.run_taken(stream_of(spark, folder), 2060, path, str(tmp_path / "other-state"))
    assert len(taken(spark, path)) >= 2060
