"""Streams over a table that is a folder of files, as large tables are, or empty."""

from __future__ import annotations

import shutil

import compare
import pyarrow.parquet as pq
import pytest

from stratavec.plans import queries as Q
from stratavec.plans.oracles import ORACLES
from stratavec.sources import corpus
from stratavec.streaming import live

STREAMS = (
    "corpus_stream", "corpus_stream_take", "stream_session", "stream_capture",
    "stream_sequences", "stream_bucket_counts",
)


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    own = folder / "documents.parquet"
    own.mkdir()
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 40)
    for k in range(3):
        pq.write_table(rows.slice(15 * k, 15), own / f"part-{k:04d}.parquet")
    shutil.copy("/root/testdata/sf0.001/embeddings.parquet", folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_folder_of_files(spark, parts, name):
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{parts}/documents.parquet/*.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{parts}/embeddings.parquet'")
    expected = compare.duck_rows(con, ORACLES[name])
    assert expected[1]
    assert compare.difference(compare.spark_rows(Q.QUERIES[name](spark, parts)), expected) is None


@pytest.mark.parametrize("name", STREAMS)
def test_empty_table(spark, small, tmp_path, name):
    (tmp_path / "documents.parquet").mkdir()
    shutil.copy(f"{small}/embeddings.parquet", tmp_path / "embeddings.parquet")
    assert Q.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_rows_come_after_an_empty_start(spark, parts, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    rows = corpus.corpus_stream(spark, str(source), Q.DOCUMENTS_SCHEMA, places=True)
    live.run_taken(rows, 20, out, state)
    got = spark.read.schema("example_id bigint, text string").parquet(out)
    assert got.count() == 0
    shutil.copy(f"{parts}/documents.parquet/part-0000.parquet", source)
    shutil.copy(f"{parts}/documents.parquet/part-0001.parquet", source)
    live.run_taken(rows, 20, out, state)
    assert spark.read.schema("example_id bigint, text string").parquet(out).count() == 20
