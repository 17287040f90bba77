"""Models over sequences: by block, in the row of the sequence, and on a stream."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec import defaults as D
from stratavec.operators import sampling, sequences, tokens
from stratavec.plans import queries as Q
from stratavec.plans.capture import capture, encoded_in_row, sampled_tokens, strategy_of
from stratavec.sources import corpus

KEY = ("example_id", "layer", "kind", "position")


def plain(texts: dict, rows) -> dict:
    """Vectors by calling the model on whole sequences."""
    out = {}
    for r in rows:
        words = texts[r["example_id"]].split()
        flat = Q.prefix_lengths(words, r["layer"], r["kind"], np.array([r["position"]]))[0]
        out[tuple(r[k] for k in KEY)] = [float(x) for x in flat]
    return out


def vectors_of(frame) -> dict:
    rows = frame.collect()
    got = {tuple(r[k] for k in KEY): list(r["flat"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture()
def hot(spark):
    """A third of all tokens is one example."""
    texts = {i: " ".join("w" * (1 + (i + k) % 7) for k in range(60)) for i in range(100)}
    texts[100] = " ".join("w" * (1 + k % 5) for k in range(3000))
    texts[101], texts[102] = "", "one"
    frame = spark.createDataFrame(list(texts.items()), "example_id bigint, text string").repartition(4)
    return texts, frame


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_blocks_of_a_hot_example(spark, hot, block):
    texts, frame = hot
    settings = replace(D.SETTINGS, strategy="all", layers=(0, 2))
    rows = sampled_tokens(frame, settings)
    model = Q.PrefixLengths()
    encoder = sequences.BlockEncoder(model, tokens.tokenize(frame, None), block)
    encoded = encoder.encode(rows)
    assert encoded.columns == [*rows.columns, "flat"]
    want = plain(texts, rows.collect())
    assert vectors_of(encoded) == want
    in_row = encoded_in_row(frame, settings, sequences.BlockEncoder(model, block=block))
    assert vectors_of(in_row) == want
    same = lambda f: sorted(tuple(r) for r in f.select(*rows.columns).collect())
    assert same(in_row) == same(rows) == same(encoded)


def test_no_task_holds_a_hot_example(spark, hot, monkeypatch):
    _, frame = hot
    settings = replace(D.SETTINGS, strategy="all", layers=(0,))
    block = 50
    encoder = sequences.BlockEncoder(Q.PrefixLengths(), tokens.tokenize(frame, None), block)
    encoded = encoder.encode(sampled_tokens(frame, settings))
    number = F.floor(F.col("position") / block)
    largest = encoded.groupBy("example_id", number).count().agg(F.max("count")).first()[0]
    # a group is a block of positions times layers and kinds
    assert largest <= block * 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        sizes = (
            encoder.encode(sampled_tokens(frame, settings))
            .groupBy(F.spark_partition_id()).count().collect()
        )
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    total = sum(r["count"] for r in sizes)
    assert total == 2 * (3000 + 6000 + 1) and max(r["count"] for r in sizes) < total / 8


def test_in_row_sample_is_the_sample(spark, small):
    texts = Q.documents(spark, small)
    for settings in (
        D.SETTINGS,
        replace(D.SETTINGS, strategy="log_uniform", base_rate=2.0, seed=3),
        replace(D.SETTINGS, max_rows=3, kinds=("q",)),
        replace(D.SETTINGS, strategy="all", max_length=40),
    ):
        source = sequences.SequenceEncoder(Q.prefix_lengths)
        rows = sampled_tokens(texts, settings)
        got = encoded_in_row(texts, settings, source).drop("flat")
        assert got.columns == rows.columns
        as_set = lambda f: sorted(tuple(r) for r in f.collect())
        assert as_set(got) == as_set(rows)


def test_stream_equals_batch(spark, small, tmp_path):
    folder = str(tmp_path / "parts")
    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(folder)
    stream = corpus.corpus_stream(spark, folder, Q.DOCUMENTS_SCHEMA, files_per_trigger=1)
    layout = D.Layout(1, 1, 3, (D.FULL,) * 2, 64)
    settings = replace(D.SETTINGS, layout=layout, max_rows=5)
    for encoder in (
        sequences.SequenceEncoder(Q.prefix_lengths),
        sequences.BlockEncoder(Q.PrefixLengths(), block=128),
    ):
        rows = capture(stream, settings, encoder)
        path = str(tmp_path / type(encoder).__name__)
        Q.live.run_available(rows, path, path + "-state")
        got = spark.read.schema(rows.schema).parquet(path)
        batch = capture(Q.documents(spark, small), settings, encoder)
        as_rows = lambda f: sorted(str(tuple(r)) for r in f.collect())
        assert as_rows(got) == as_rows(batch) and batch.count() > 0


def test_in_row_needs_no_shuffle(spark, small):
    rows = encoded_in_row(
        Q.table(spark, small, "documents").select(F.col("doc_id").alias("example_id"), "text"),
        D.SETTINGS,
        sequences.BlockEncoder(Q.PrefixLengths()),
    )
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_errors(spark):
    rows = spark.createDataFrame(
        [(1, 0, "q", 0), (1, 0, "q", 2)], "example_id bigint, layer int, kind string, position int"
    )
    text = lambda *items: tokens.tokenize(
        spark.createDataFrame(list(items), "example_id bigint, text string"), None
    )
    encoder = lambda frame: sequences.BlockEncoder(Q.PrefixLengths(), frame, 8)
    for frame, message in (
        (text((2, "a b c")), "without tokens"),
        (text((1, "")), "without tokens"),
        (text((1, "a b")), "beyond the 2 tokens"),
        (text((1, "a b c"), (1, "a b c")), "more than one sequence"),
    ):
        with pytest.raises(Exception, match=message):
            encoder(frame).encode(rows).collect()
        with pytest.raises(Exception, match=message):
            sequences.SequenceEncoder(Q.prefix_lengths, frame).encode(rows).collect()
    with pytest.raises(ValueError, match="were taken from"):
        sequences.BlockEncoder(Q.PrefixLengths()).encode(rows)
    few = lambda words, layer, kind, positions: np.zeros((1, 2))
    with pytest.raises(Exception, match="1 vectors for 2 positions"):
        sequences.SequenceEncoder(few, text((1, "a b c"))).encode(rows).collect()
    assert sequences.SequenceEncoder(few, text((1, "a b c"))).encode(rows.limit(0)).collect() == []


def test_cap_in_row_is_the_cap(spark):
    groups = spark.createDataFrame([(1, 200), (2, 3), (3, 0)], "example_id bigint, n_tokens int")
    strategy = strategy_of(D.SETTINGS)
    everything = sampling.sampler_by_name("all")
    for chosen in (strategy, everything):
        rows = sampling.cap_rows(
            sampling.sample_shared(sampling.sequence_groups(groups, [0, 1]), chosen, 5), 4, 5
        )
        want = sorted((r.example_id, r.layer, r.kind, r.position) for r in rows.collect())
        wanted = sampling.sampled_in_row(groups, [0, 1], D.KINDS, chosen, 5, 4)
        got = [
            (r.example_id, g.layer, g.kind, p) for r in wanted.collect() for g in r.wanted for p in g.positions
        ]
        assert sorted(got) == want
