"""Physical plans: what must not appear, and what must."""

from __future__ import annotations

from dataclasses import replace

import pytest

from stratavec import defaults as D
from stratavec.plans import queries as Q
from stratavec.plans.capture import sampled_positions
from stratavec.sources import catalogue

WRITING = {
    "corpus_stream", "write_capture", "overwrite_configs", "append_rows", "list_configs",
    "dataset_card_stats", "read_config", "read_config_prefix", "publish_branch", "reset_root",
    "stream_capture", "stream_bucket_counts", "capture_run", "capture_run_sampled",
    "session_rows", "session_counts", "corpus_stream_take", "stream_session", "stream_sequences",
}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - WRITING))
def test_no_cross_join_and_no_python_rows(spark, small, name):
    text = plan(Q.QUERIES[name](spark, small))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_sampling_needs_no_shuffle(spark, small):
    # more splits than cores: the scan is left as it is
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        text = plan(sampled_positions(Q.documents(spark, small), D.SETTINGS))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Exchange" not in text
    # one md5 per group, for two seeds, before positions are exploded
    assert text.count("md5(") == 2
    assert text.index("sequence(0") < text.index("md5(")


def test_text_is_split_once(spark, small):
    assert plan(Q.token_strings(spark, small)).count("split(") == 1


def test_cap_limits_groups_before_the_shuffle(spark, small):
    rows = sampled_positions(Q.documents(spark, small), replace(D.SETTINGS, max_rows=4))
    text = plan(rows)
    assert text.count("WindowGroupLimit") == 2


def test_only_needed_columns_are_read(spark, small):
    text = plan(Q.sample_uniform(spark, small))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "ReadSchema: struct<n_chars:bigint>" in plan(
        Q.long_subset(spark, small).select("length")
    )
    assert "PushedFilters: [IsNotNull(doc_id)" in plan(Q.documents(spark, small).filter("example_id > 5"))


def test_partition_pruning(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, 0, "q", 1, 1, 1, [1.0], None), (1, 0, "q", 1, 1, 1, [1.0], 64)],
        "layer int, head int, kind string, bucket int, example_id bigint, position int, "
        "vector array<float>, sliding_window int",
    )
    root = str(tmp_path)
    catalogue.publish_branch(rows, root, "a")
    catalogue.publish_branch(rows, root, "b")
    for frame in (
        catalogue.read_config(spark, root, "a", "l00h00q"),
        catalogue.read_config_prefix(spark, root, "a", "l00h00"),
    ):
        text = plan(frame)
        assert "branch" in text.split("PartitionFilters")[1] and "config" in text.split("PartitionFilters")[1]
        assert frame.count() == 1 and len(frame.inputFiles()) >= 1


def test_large_vector_table_is_not_broadcast(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        text = plan(Q.batch_encode(spark, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
