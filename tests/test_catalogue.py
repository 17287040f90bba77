"""Writing and reading captures."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratavec import defaults as D
from stratavec.operators import statistics
from stratavec.plans import queries as Q
from stratavec.plans import run
from stratavec.sources import catalogue

ROWS = (
    "layer int, head int, kind string, bucket int, example_id bigint, position int, "
    "vector array<float>, sliding_window int, token_str string"
)


def rows(spark, *keys, bucket=2, example=1):
    return spark.createDataFrame(
        [(layer, head, kind, bucket, example, 3, [1.0, 2.0], None, "t") for layer, head, kind in keys],
        ROWS,
    )


def stored(spark, path):
    return sorted(r.config for r in catalogue.read_capture(spark, path).collect())


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "root")


def test_schema_and_codec(spark, path):
    catalogue.write_capture(rows(spark, (0, 0, "q"), (100, 2, "k")), path)
    assert catalogue.read_capture(spark, path).schema == catalogue.STORED
    assert stored(spark, path) == ["l00h00q", "l100h02k"]
    files = [f for f in os.listdir(f"{path}/config=l00h00q") if f.endswith(".parquet")]
    meta = pq.ParquetFile(f"{path}/config=l00h00q/{files[0]}").metadata
    assert meta.row_group(0).column(0).compression == "ZSTD"
    listed = catalogue.list_configs(catalogue.read_capture(spark, path)).collect()
    assert {(r.layer, r.head, r.kind) for r in listed} == {(0, 0, "q"), (100, 2, "k")}


def test_overwrite_append_reset(spark, path):
    q, k = (0, 0, "q"), (0, 0, "k")
    catalogue.write_capture(rows(spark, q, k), path)
    catalogue.overwrite_configs(rows(spark, q), path)
    assert stored(spark, path) == ["l00h00k", "l00h00q"]
    catalogue.overwrite_configs(rows(spark, q).limit(0), path)  # nothing touched
    assert stored(spark, path) == ["l00h00k", "l00h00q"]
    catalogue.append_rows(rows(spark, q), path)
    assert stored(spark, path) == ["l00h00k", "l00h00q", "l00h00q"]
    catalogue.reset_root(rows(spark, (1, 0, "q")), path)
    assert stored(spark, path) == ["l01h00q"]
    with pytest.raises(ValueError, match="lack the columns"):
        catalogue.append_rows(rows(spark, q).drop("vector"), path)


def test_branches(spark, path):
    catalogue.publish_branch(rows(spark, (0, 0, "q"), (0, 0, "k"), (0, 1, "q")), path, "a")
    catalogue.publish_branch(rows(spark, (0, 0, "q")), path, "2024")
    assert catalogue.read_config_prefix(spark, path, "a", "l00h00").count() == 2
    assert catalogue.read_config(spark, path, "2024", "l00h00q").count() == 1
    catalogue.publish_branch(rows(spark, (5, 0, "q")), path, "a")
    left = {(r.branch, r.config) for r in catalogue.read_branches(spark, path).collect()}
    assert left == {("a", "l05h00q"), ("2024", "l00h00q")}


def test_token_policy(spark):
    with_tokens = rows(spark, (0, 0, "q"))
    without = with_tokens.drop("token_str")
    both = catalogue.union_with_tokens(with_tokens, without)
    assert sorted(str(r.token_str) for r in both.collect()) == ["None", "t"]
    with pytest.raises(ValueError, match="token strings"):
        catalogue.union_with_tokens(without, with_tokens)


def test_files_of_other_tools(spark, path):
    """Mixed window types and fixed-size lists, one file per config."""
    for config, window in (("l00h00q", [64, 64]), ("l01h00q", [None, None]), ("notes", [1, 1])):
        os.makedirs(f"{path}/{config}")
        vectors = pa.FixedSizeListArray.from_arrays(pa.array([1.0, 2.0, 3.0, 4.0], pa.float32()), 2)
        table = pa.table(
            {
                "bucket": pa.array([1, 2], pa.int32()),
                "example_id": pa.array([7, -8], pa.int32()),
                "position": pa.array([0, 1], pa.int32()),
                "vector": vectors,
                "sliding_window": pa.array(window),
            }
        )
        pq.write_table(table, f"{path}/{config}/data.parquet")
    got = catalogue.read_plain_files(spark, path)
    assert got.schema == catalogue.STORED
    assert {(r.config, r.example_id, r.sliding_window, tuple(r.vector)) for r in got.collect()} == {
        ("l00h00q", 7, 64, (1.0, 2.0)),
        ("l00h00q", -8, 64, (3.0, 4.0)),
        ("l01h00q", 7, None, (1.0, 2.0)),
        ("l01h00q", -8, None, (3.0, 4.0)),
    }


def test_one_model_per_branch(spark, small, path):
    kwargs = dict(root=path, branch="b", metadata={"sampling_strategy": "mine"})
    args = (Q.documents(spark, small), D.SETTINGS, Q.encoder(spark, small))
    run.run_capture(*args, model_name="one", **kwargs)
    with pytest.raises(ValueError, match="one model per branch"):
        run.run_capture(*args, model_name="two", **kwargs)
    run.run_capture(*args, model_name="one", **kwargs)  # replaced, so counted once
    manifest = run.read_manifest(spark, path)
    total = manifest.agg(F.sum("n_rows")).first()[0]
    assert total == catalogue.read_branches(spark, path).count()
    metadata = manifest.first().metadata
    assert metadata["sampling_strategy"] == "mine"
    assert metadata["sampling_bucket_size"] == "64"


def test_hot_config_is_split(spark, path, monkeypatch):
    """A config with most rows is written by several tasks under AQE."""
    monkeypatch.setattr(catalogue, "ROWS_PER_FILE", 10**9)
    saved = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        hot = spark.range(200_000).select(
            F.lit(0).alias("layer"),
            F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("head"),
            F.lit("q").alias("kind"),
            F.lit(0).alias("bucket"),
            F.col("id").alias("example_id"),
            F.lit(0).alias("position"),
            F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("vector"),
            F.lit(None).alias("sliding_window"),
        )
        catalogue.write_capture(hot, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", saved)
    count = lambda c: len([f for f in os.listdir(f"{path}/config={c}") if f.endswith(".parquet")])
    assert count("l00h00q") > 1 and count("l00h01q") == 1
    assert catalogue.read_capture(spark, path).count() == 200_000


def test_counters(spark):
    frame = rows(spark, (0, 0, "q"), (0, 1, "q"), (0, 0, "k"))
    frame = frame.withColumn("config", F.concat("layer", "head", "kind"))
    row = statistics.capture_counters(frame).first()
    assert tuple(row) == (3, 2, 3)
