"""Sessions on a branch, and runs that prepare their corpus themselves."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stratavec import defaults as D
from stratavec.plans import queries as Q
from stratavec.plans import run, sessions
from stratavec.plans.capture import capture
from stratavec.sources import catalogue, commits, corpus

ROWS = (
    "layer int, head int, kind string, bucket int, example_id bigint, position int, "
    "vector array<float>, sliding_window int, token_str string"
)


def rows(spark, *keys, bucket=2):
    data = [(layer, head, kind, bucket, 1, 3, [1.0, 2.0], None, "t") for layer, head, kind in keys]
    return spark.createDataFrame(data, ROWS)


def counts(frame):
    return {r.bucket: r.n_rows for r in frame.filter("bucket is not null").collect()}


@pytest.fixture()
def at(tmp_path):
    return {"root": str(tmp_path / "root"), "branch": "b", "model_name": "one"}


def test_ledger_counts_what_was_written_and_manifest_what_is_stored(spark, at):
    q, k = (0, 0, "q"), (0, 0, "k")
    sessions.add_session(rows(spark, q, k), metadata={"a": 1, "c": 2}, **at)
    sessions.add_session(
        rows(spark, q, bucket=5), mode=sessions.REPLACE_CONFIGS, metadata={"c": 3}, **at
    )
    sessions.add_session(rows(spark, q, bucket=5), **at)
    manifest = sessions.read_manifest(spark, at["root"])
    assert counts(manifest) == {2: 1, 5: 2}
    assert manifest.first().metadata == {"a": "1", "c": "3"}
    assert counts(sessions.ledger_counts(spark, at["root"], "b")) == {2: 2, 5: 2}
    sessions.add_session(rows(spark, k), mode=sessions.REPLACE_ALL, **at)
    assert counts(sessions.ledger_counts(spark, at["root"], "b")) == {2: 1}
    assert sessions.read_manifest(spark, at["root"]).first().metadata == {}


def test_second_model_is_refused_in_every_mode(spark, at):
    sessions.add_session(rows(spark, (0, 0, "q")), **at)
    for mode in (sessions.APPEND, sessions.REPLACE_CONFIGS, sessions.REPLACE_ALL):
        with pytest.raises(ValueError, match="one model per branch"):
            sessions.add_session(
                rows(spark, (1, 0, "q")), mode=mode, **{**at, "model_name": "two"}
            )
    with pytest.raises(ValueError, match="unknown session mode"):
        sessions.add_session(rows(spark, (1, 0, "q")), mode="other", **at)
    assert catalogue.read_branches(spark, at["root"]).count() == 1


def test_token_policy_of_the_first_write(spark, at):
    q, k = (0, 0, "q"), (0, 0, "k")
    sessions.add_session(rows(spark, q).drop("token_str"), **at)
    with pytest.raises(ValueError, match="token strings given for l00h00q"):
        sessions.add_session(rows(spark, q, k), **at)
    sessions.add_session(rows(spark, k), **at)  # a config of its own
    sessions.add_session(rows(spark, k).drop("token_str"), **at)
    stored = catalogue.read_branches(spark, at["root"])
    assert sorted(str(r.token_str) for r in stored.collect()) == ["None", "None", "t"]


def test_empty_capture_keeps_its_record(spark, at):
    sessions.add_session(rows(spark, (0, 0, "q")).limit(0), metadata={"a": 1}, **at)
    record = sessions.read_manifest(spark, at["root"]).collect()
    assert [(r.model_name, r.metadata, r.bucket, r.n_rows) for r in record] == [
        ("one", {"a": "1"}, None, 0)
    ]
    with pytest.raises(ValueError, match="one model per branch"):
        sessions.add_session(rows(spark, (0, 0, "q")), **{**at, "model_name": "two"})


def test_stream_in_micro_batches_and_its_branch(spark, small, at, tmp_path):
    folder = str(tmp_path / "parts")
    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(folder)
    stream = corpus.corpus_stream(spark, folder, Q.DOCUMENTS_SCHEMA, files_per_trigger=1)
    encoder = Q.encoder(spark, small)
    settings = replace(D.SETTINGS, layers=(0,))
    args = {"checkpoint": str(tmp_path / "state"), **at}
    for _ in range(2):  # nothing new the second time
        sessions.add_stream_session(capture(stream, settings, encoder), **args)
    batch = capture(Q.documents(spark, small), settings, encoder)
    expected = {r.bucket: r["count"] for r in batch.groupBy("bucket").count().collect()}
    assert counts(sessions.read_manifest(spark, at["root"])) == expected
    assert counts(sessions.ledger_counts(spark, at["root"], "b")) == expected
    # micro-batches are sessions like others, and one that is run again counts once
    path = catalogue.branch_path(at["root"], "b")
    assert commits.latest(spark, path).version == 2
    with pytest.raises(sessions.AlreadyWritten):
        sessions.add_session(rows(spark, (0, 0, "q")), stream=(args["checkpoint"], 1), **at)
    sessions.add_session(rows(spark, (0, 0, "q"), bucket=10**6), **at)
    expected[10**6] = 1
    assert counts(sessions.read_manifest(spark, at["root"])) == expected
    assert sum(expected.values()) == catalogue.read_branches(spark, at["root"]).count()


def test_run_corpus(spark):
    source = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "z")], "name string, body string")
    as_rows = lambda frame: {(r.text, r.example_id) for r in frame.collect()}
    numbered = run.run_corpus(source, "name", "body", max_samples=2, ordinals=True)
    assert as_rows(numbered) == {("y", 0), ("x", 1)}
    hashed = run.run_corpus(source, "name", "body")
    assert hashed.schema["example_id"].dataType.simpleString() == "bigint"
    assert len({i for _, i in as_rows(hashed)}) == 3


def test_run_with_sampled_heads_and_rotary_step(spark, small, at):
    layout = run.layout_of_config(
        spark,
        '{"text_config": {"num_hidden_layers": 2.0, "num_attention_heads": 4, '
        '"num_key_value_heads": 2}}',
        D.LAYOUT.head_dim,
        64,
    )
    assert (layout.num_layers, layout.q_heads, layout.k_heads) == (2, 4, 2)
    run.run_capture(
        Q.documents(spark, small),
        replace(D.SETTINGS, layout=layout, heads=(3,)),
        Q.encoder(spark, small),
        head_sampling=run.HeadSampling(1),
        rotary=lambda captured: captured.withColumn("vector", F.transform("vector", lambda x: x * 0)),
        **at,
    )
    stored = catalogue.read_branches(spark, at["root"])
    configs = {r.config[3:] for r in stored.select("config").distinct().collect()}
    assert configs == {"h03q", "h01k"}
    assert stored.filter(F.exists("vector", lambda x: x != 0)).count() == 0
    metadata = sessions.read_manifest(spark, at["root"]).first().metadata
    assert metadata["head_sampling_selected_query_heads"] == "1"
    assert metadata["head_sampling_sliding_layer_count"] == "0"
