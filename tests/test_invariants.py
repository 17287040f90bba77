"""Properties that hold for any partitioning, and brute force on small input."""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavec import defaults as D
from stratavec.functions.vectors import dot
from stratavec.operators import attention, gather, heads, runs, sampling
from stratavec.plans import queries as Q
from stratavec.plans.capture import (
    capture,
    groups_of,
    sampled_positions,
    sampled_tokens,
    strategy_of,
)
from stratavec.sources import corpus
from stratavec.streaming import live
from stratavec.session import scratch_path


def as_set(rows):
    return {tuple(r) for r in rows.collect()}


@pytest.mark.parametrize("name", ["uniform", "log_uniform"])
def test_same_sample_for_any_partitioning(spark, small, name):
    texts = spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("example_id"), "text"
    )
    settings = replace(D.SETTINGS, strategy=name, max_rows=5)
    results = [as_set(sampled_positions(texts.repartition(n), settings)) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2] and results[0]


def test_sample_is_part_of_all_and_rates_are_right(spark, small):
    documents = Q.documents(spark, small)
    sample = sampled_positions(documents, D.SETTINGS)
    every = sampled_positions(documents, replace(D.SETTINGS, strategy="all"))
    assert sample.exceptAll(every).count() == 0
    n, p = every.count(), 1 / D.SETTINGS.bucket_size
    assert abs(sample.count() - n * p) < 4 * math.sqrt(n * p * (1 - p))


def test_log_rates(spark, small):
    documents = Q.documents(spark, small)
    settings = replace(D.SETTINGS, strategy="log_uniform")
    kept = {r.bucket: r["count"] for r in sampled_positions(documents, settings).groupBy("bucket").count().collect()}
    widths = {r.bucket: r for r in Q.bucket_widths(spark, small).collect()}
    groups = len(D.KINDS) * D.LAYOUT.num_layers
    for bucket, row in widths.items():
        n, p = row.n_positions * groups, row.keep_probability
        assert abs(kept.get(bucket, 0) - n * p) < 4 * math.sqrt(n * p * (1 - p)) + 1


def test_heads_share_masks_and_kinds_do_not(spark, small):
    rows = Q.sample_shared_mask(spark, small)
    per_group = rows.groupBy("example_id", "layer", "kind", "position").count()
    wrong = per_group.filter(
        F.col("count") != F.when(F.col("kind") == "q", D.LAYOUT.q_heads).otherwise(D.LAYOUT.k_heads)
    )
    assert wrong.count() == 0
    q, k = (
        as_set(rows.filter(F.col("kind") == kind).select("example_id", "layer", "position"))
        for kind in D.KINDS
    )
    assert len(q & k) < 0.1 * len(q)


def test_draws_are_uniform(spark, small):
    rows = sampling.seeded_draw(groups_of(Q.examples(spark, small), D.SETTINGS), 0, "example_id", "layer", "kind")
    counts = [r["count"] for r in rows.groupBy(F.floor(F.col("u") * 16)).count().collect()]
    mean = sum(counts) / 16
    assert len(counts) == 16
    assert sum((c - mean) ** 2 / mean for c in counts) < 45  # 15 degrees of freedom


@pytest.mark.parametrize("name", sampling.STRATEGIES)
def test_cap_in_row_equals_window(spark, small, name):
    groups = groups_of(Q.examples(spark, small), D.SETTINGS)
    strategy = sampling.sampler_by_name(name, 1.0, 64)
    window = sampling.cap_rows(sampling.sample_shared(groups, strategy), 3)
    inside = sampling.sample_capped_in_row(groups, strategy, 3).select(*window.columns)
    assert as_set(window) == as_set(inside)


def test_mask_function_contract(spark, small):
    groups = groups_of(Q.examples(spark, small), replace(D.SETTINGS, layers=(0,)))
    strategy = strategy_of(D.SETTINGS)
    ints = sampling.sample_with_mask(groups, strategy, lambda p, b: (p < 2).astype(int))
    assert {r.position for r in ints.select("position").distinct().collect()} == {0, 1}
    with pytest.raises(Exception, match="mask of shape"):
        sampling.sample_with_mask(groups, strategy, lambda p, b: p[:-1] >= 0).count()


def test_stream_with_cap_equals_batch(spark, small):
    settings = replace(D.SETTINGS, max_rows=3)
    encoder = Q.encoder(spark, small)
    stream = corpus.corpus_stream(spark, small, Q.DOCUMENTS_SCHEMA, glob="documents.parquet")
    out, state = scratch_path(spark, "t"), scratch_path(spark, "t-state")
    live.stream_capture(capture(stream, settings, encoder), out, state)
    live.stream_capture(capture(stream, settings, encoder), out, state)  # restart: nothing new
    key = ["config", "example_id", "position"]
    batch = capture(Q.documents(spark, small), settings, encoder)
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(
        map(tuple, batch.select(*key).collect())
    )


def test_stream_over_several_files_counts_all(spark, small):
    folder = scratch_path(spark, "parts")
    spark.read.parquet(f"{small}/documents.parquet").repartition(5).write.parquet(folder)
    stream = corpus.corpus_stream(spark, folder, Q.DOCUMENTS_SCHEMA, files_per_trigger=1)
    rows = sampled_positions(stream, D.SETTINGS)
    out, state = scratch_path(spark, "t"), scratch_path(spark, "t-state")
    live.stream_bucket_counts(rows, out, state)
    batch = sampled_positions(Q.documents(spark, small), D.SETTINGS).groupBy("bucket").count()
    assert as_set(spark.read.parquet(out).select("bucket", "n_rows")) == as_set(batch)


LAYOUT = D.Layout(q_heads=2, k_heads=1, head_dim=2, layer_types=(D.FULL,))


@pytest.fixture(scope="module")
def random_capture(spark):
    """A long example, a short one, and their positions for brute force."""
    rng = random.Random(3)
    rows = []
    for example, n in ((1, 90), (2, 7)):
        for kind, n_heads in (("q", 2), ("k", 1)):
            for position in sorted(rng.sample(range(n * 2), n)):
                for head in range(n_heads):
                    vector = [rng.uniform(-1, 1), rng.uniform(-1, 1)]
                    rows.append((example, 0, head, kind, position, vector))
    frame = spark.createDataFrame(
        rows,
        "example_id bigint, layer int, head int, kind string, position int, vector array<float>",
    )
    return rows, frame


def brute(rows, near):
    q = [r for r in rows if r[3] == "q"]
    k = [r for r in rows if r[3] == "k"]
    return {
        (a[0], a[2], a[4], b[4]): float(np.dot(np.float32(a[5]), np.float32(b[5]))) / math.sqrt(2)
        for a, b in itertools.product(q, k)
        if a[0] == b[0] and near(a[4], b[4])
    }


def as_pairs(frame):
    out = [((r.example_id, r.head, r.q_position, r.k_position), r.logit) for r in frame.collect()]
    assert len(out) == len(dict(out))  # no pair twice
    return dict(out)


@pytest.mark.parametrize("tile", [1, 16, 50, 4096])
def test_causal_pairs_for_any_tile(random_capture, tile):
    rows, frame = random_capture
    got = as_pairs(
        attention.causal_pairs(
            attention.query_side(frame, LAYOUT), attention.key_side(frame), LAYOUT, tile=tile
        )
    )
    expected = brute(rows, lambda q, k: k <= q)
    assert got == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("window, both", list(itertools.product([1, 5, 64], [False, True])))
def test_window_pairs(random_capture, window, both):
    rows, frame = random_capture
    got = as_pairs(
        attention.window_pairs(
            attention.query_side(frame, LAYOUT), attention.key_side(frame), LAYOUT, window, both
        )
    )
    near = (lambda q, k: abs(q - k) < window) if both else (lambda q, k: 0 <= q - k < window)
    assert got == pytest.approx(brute(rows, near), abs=1e-6)


def test_softmax_weights_add_up(random_capture):
    _, frame = random_capture
    sides = attention.query_side(frame, LAYOUT), attention.key_side(frame)
    weights = attention.softmax_weights(*sides, LAYOUT)
    sums = weights.groupBy(*attention.QUERY_ROW).agg(
        F.sum("weight").alias("total"), F.max("weight").alias("top")
    )
    rows = {tuple(r[:4]): r for r in sums.collect()}
    assert all(r.total == pytest.approx(1.0) for r in rows.values())
    for r in attention.softmax_rows(*sides, LAYOUT).collect():
        assert r.max_weight == pytest.approx(rows[tuple(r[:4])].top)


@pytest.mark.parametrize("block", [1, 3, 10, 4096])
def test_run_groups_for_any_block(spark, block):
    rng = random.Random(block)
    rows = [(key, i, rng.random() < 0.6) for key, n in ((1, 60), (2, 1), (3, 17)) for i in range(0, n * 2, 2)]
    expected, number, previous = {}, {}, {}
    for key, i, flag in rows:
        if flag and not previous.get(key):
            number[key] = number.get(key, -1) + 1
        expected[(key, i)] = number.get(key, -1) if flag else -1
        previous[key] = flag
    frame = spark.createDataFrame(rows, "key int, i int, flag boolean").repartition(4)
    grouped = runs.run_groups(frame, "key", "i", F.col("flag"), block)
    assert {(r.key, r.i): r.run_group for r in grouped.collect()} == expected
    spans = runs.run_spans(grouped, "key", "i", block).collect()
    assert len(spans) == len(rows)
    members = {}
    for place, group in expected.items():
        members.setdefault((place[0], group), []).append(place[1])
    for r in spans:
        own = members[(r.key, r.run_group)]
        assert (r.run_start, r.run_end) == (
            (None, None) if r.run_group < 0 else (min(own), max(own))
        )


def test_gather_on_position_key(spark, small):
    """Sampled positions against a table with a vector for every position."""
    examples = Q.examples(spark, small)
    groups = groups_of(examples, replace(D.SETTINGS, layers=(0,)))
    every = heads.attach_heads(
        sampling.sample_shared(groups, sampling.sampler_by_name("all")), D.LAYOUT
    )
    table = every.select(
        "example_id", "layer", "head", "kind", "position",
        F.array(F.col("position").cast("float"), F.col("head").cast("float")).alias("vector"),
    )
    sampled = sampling.sample_shared(groups, strategy_of(D.SETTINGS)).drop("n_tokens")
    selected = spark.createDataFrame([(0, 1, "q"), (0, 0, "k")], "layer int, head int, kind string")
    rows = gather.gather_vectors(sampled, table, selected=selected)
    assert rows.count() == sampled.count()
    assert rows.filter("vector[0] != position or vector[1] != head").count() == 0


def test_dot_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 128)).astype("float32")
    frame = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<float>, b array<float>")
    got = frame.select(dot(F.col("a"), F.col("b"), 128)).first()[0]
    assert got == pytest.approx(float(a.astype("float64") @ b.astype("float64")))


def test_hot_vectors_change_nothing(spark, small):
    sampled = Q.token_strings(spark, small)
    plain = Q.encoder(spark, small)
    for limit in (1, 50):
        ids = gather.frequent_vector_ids(sampled, plain.n_vectors, limit)
        assert ids.count() == limit
        hot = gather.LookupEncoder(plain.vectors, plain.n_vectors, ids).encode(sampled)
        columns = ["example_id", "layer", "kind", "position", "vec_id", F.col("flat")[5]]
        assert as_set(hot.select(*columns)) == as_set(plain.encode(sampled).select(*columns))
        assert hot.count() == sampled.count()


def test_selection_before_encoding_equals_filter_after(spark, small):
    selected = Q.default_selection(spark)
    columns = ["example_id", "config", "position", "token_str", F.col("vector")[3]]
    early = capture(Q.documents(spark, small), D.SETTINGS, Q.encoder(spark, small), selected)
    late = heads.filter_selected_heads(Q.captured(spark, small), selected)
    assert as_set(early.select(*columns)) == as_set(late.select(*columns))
    assert early.count() == late.count() > 0


def test_python_tokenizer_runs_once_per_text(spark, small):
    """Any column function that gives tokens can replace the default."""

    @F.pandas_udf("array<string>")
    def halves(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w[i : i + 4] for w in t.split() for i in range(0, len(w), 4)])

    documents = Q.documents(spark, small)
    rows = sampled_tokens(documents, replace(D.SETTINGS, strategy="all", layers=(0,)), halves)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    texts = {r.example_id: r.text for r in documents.collect()}
    expected = sum(len(w[i : i + 4]) > 0 for t in texts.values() for w in t.split() for i in range(0, len(w), 4))
    assert rows.filter("kind = 'q'").count() == expected
    assert rows.filter("length(token_str) > 4").count() == 0


def test_mask_sees_positions_and_buckets_of_every_length(spark):
    groups = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 2, 7, 300, 300, 5000])], "g int, n_tokens int")
    for strategy in (
        sampling.sampler_by_name("uniform", 1.0, 64),
        sampling.sampler_by_name("log_uniform", 1.0, 4),
        sampling.sampler_by_name("all", 1.0, 32),
    ):
        odd = sampling.sample_with_mask(groups, strategy, lambda p, b: (p + b) % 3 == 1)
        plain = sampling.sample_where(groups, strategy, lambda p, b: (p + b) % 3 == 1)
        rows = lambda f: sorted(map(tuple, f.select("g", "position", "bucket").collect()))
        assert rows(odd) == rows(plain) and odd.count() > 0
