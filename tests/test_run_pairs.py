"""Pairs that see each other inside a run, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratavec.defaults import Layout
from stratavec.operators import attention

LAYOUT = Layout(2, 1, 2, ("full_attention",), 8)


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(3)
    rows, spans = [], []
    for example, n in ((1, 90), (2, 40), (3, 5), (4, 1)):
        at = 0
        while at < n:
            size = rnd.choice([1, 2, 30, 5])
            if rnd.random() < 0.6:
                spans.append((example, at, min(at + size, n) - 1))
            at += size + rnd.randint(1, 3)
        for p in range(n):
            for kind, heads in (("q", 2), ("k", 1)):
                if rnd.random() < 0.6:
                    rows += [
                        (example, 0, h, kind, p, [rnd.random(), rnd.random()], n) for h in range(heads)
                    ]
    frame = spark.createDataFrame(
        rows, "example_id bigint, layer int, head int, kind string, position int, vector array<float>, n_tokens int"
    )
    runs = spark.createDataFrame(spans, "example_id bigint, run_start int, run_end int")
    return rows, spans, frame, runs


def plain(rows, spans, near):
    def same(example, q, k):
        return any(e == example and a <= q <= b and a <= k <= b for e, a, b in spans)

    return sorted(
        (q[0], q[2], q[4], k[4])
        for q in rows
        if q[3] == "q"
        for k in rows
        if k[3] == "k" and k[0] == q[0] and (near(q[4], k[4]) or same(q[0], q[4], k[4]))
    )


def sides(frame, runs, lengths, tile):
    rows = frame if lengths else frame.drop("n_tokens")
    return (
        attention.with_runs(attention.query_side(rows, LAYOUT), runs, "q_position", tile),
        attention.with_runs(attention.key_side(rows), runs, "k_position", tile),
    )


def pairs_of(frame):
    return sorted((r.example_id, r.head, r.q_position, r.k_position) for r in frame.collect())


@pytest.mark.parametrize("tile, lengths", [(4, True), (7, False), (64, True), (4096, True)])
def test_causal_or_same_run(case, tile, lengths):
    rows, spans, frame, runs = case
    queries, keys = sides(frame, runs, lengths, 16)
    found = attention.causal_pairs(queries, keys, LAYOUT, tile=tile)
    assert "run_start" not in found.columns and "n_tokens" not in found.columns
    assert pairs_of(found) == plain(rows, spans, lambda q, k: k <= q)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("window, both", [(1, False), (5, False), (8, True), (200, False)])
def test_window_or_same_run(case, window, both):
    rows, spans, frame, runs = case
    queries, keys = sides(frame, runs, True, 4)
    found = attention.window_pairs(queries, keys, LAYOUT, window, both)
    near = (lambda q, k: abs(q - k) < window) if both else (lambda q, k: 0 <= q - k < window)
    assert pairs_of(found) == plain(rows, spans, near)


def test_lengths_change_no_pair(case):
    rows, spans, frame, _ = case
    whole = attention.query_side(frame, LAYOUT), attention.key_side(frame)
    bare = frame.drop("n_tokens")
    for tile in (3, 50):
        with_lengths = attention.causal_pairs(*whole, LAYOUT, tile=tile)
        without = attention.causal_pairs(
            attention.query_side(bare, LAYOUT), attention.key_side(bare), LAYOUT, tile=tile
        )
        assert pairs_of(with_lengths) == pairs_of(without) == plain(rows, [], lambda q, k: k <= q)


def test_each_row_has_one_run(case):
    _, _, frame, runs = case
    keys = attention.key_side(frame)
    found = attention.with_runs(keys, runs, "k_position", 4)
    assert found.count() == keys.count()
    inside = found.filter(F.col("run_start").isNotNull())
    assert inside.filter("k_position < run_start or k_position > run_end").count() == 0


def test_attention_reads_its_capture_twice(spark, small):
    from stratavec.plans import queries as Q

    plan = Q.attention_softmax(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("text#") and plan.count("FileScan") - plan.count("ReadSchema: struct<vec_id") <= 2


def test_runs_of_a_row_are_those_of_the_table(spark, small):
    """Runs found in the row of the sequence, and those of windows and an interval join."""
    from stratavec.operators import runs, tokens
    from stratavec.plans import queries as Q
    from stratavec.plans.capture import sampled_tokens

    flag = lambda token: ~token.contains(".")
    odd = [(-1, ""), (-2, None), (-3, "."), (-4, "a b . . c"), (-5, ". a"), (-6, "a"), (-7, " b. c d e ")]
    texts = Q.documents(spark, small).unionByName(spark.createDataFrame(odd, "example_id bigint, text string"))
    settings = Q.replace(Q.D.SETTINGS, strategy="all", layers=(0,), kinds=("q",))
    found = sampled_tokens(texts, settings, in_run=flag).select(
        "example_id", "position", "run_start", "run_end"
    )
    words = texts.select(
        "example_id", F.posexplode(tokens.whitespace_tokens(F.col("text"))).alias("position", "token")
    )
    grouped = runs.run_groups(words, "example_id", "position", flag(F.col("token")))
    spans = runs.spans_of_runs(grouped, "example_id", "position")
    expected = attention.with_runs(words.select("example_id", "position"), spans, "position")
    rows = lambda frame: sorted(map(tuple, frame.toArrow().to_pandas().fillna(-1).values.tolist()))
    assert rows(found) == rows(expected)
    assert found.filter("example_id < 0").count() == 1 + 5 + 2 + 1 + 4


@pytest.mark.parametrize("name", ["run_visible_pairs", "run_visible_window_pairs"])
def test_runs_and_vectors_are_shuffled_once(spark, small, name):
    from stratavec.plans import queries as Q

    plan = Q.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan
    # vectors: only those of the pair join
    moved = [line for line in plan.splitlines() if "Exchange hash" in line]
    assert sum("_block" in line for line in moved) == 2
    assert not any("_tile" in line for line in moved)
