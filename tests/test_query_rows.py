"""Figures of a query in one pass, against all its pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratavec.defaults import Layout
from stratavec.operators import attention, query_rows
from stratavec.operators.gather import head_vectors
from stratavec.plans import queries as Q

LAYOUT = Layout(4, 2, 3, ("full_attention",), 8)
COLUMNS = "example_id bigint, layer int, kind string, position int, n_tokens int, flat array<float>"


def sampled(spark, sizes, rate, scale=1.0):
    rnd = random.Random(5)
    rows = [
        (example, layer, kind, p, n, [scale * rnd.uniform(-1, 1) for _ in range(width)])
        for example, n in sizes
        for layer in (0, 3)
        for kind, width in (("q", 12), ("k", 6))
        for p in range(n)
        if rnd.random() < rate
    ]
    return spark.createDataFrame(rows, COLUMNS)


def by_query(rows):
    names = sorted(set(rows.columns) - set(attention.QUERY_ROW))
    out = {tuple(r[c] for c in attention.QUERY_ROW): [r[c] for c in names] for r in rows.collect()}
    assert len(out) == rows.count()
    return out


def pairs_of(encoded):
    rows = head_vectors(encoded, LAYOUT)
    return attention.query_side(rows, LAYOUT), attention.key_side(rows)


def softmax_of(pairs):
    terms = attention.softmax_terms(pairs)
    lse = F.col("shift") + F.log("total")
    return terms.select(
        *attention.QUERY_ROW,
        "n_keys",
        (1 / F.col("total")).alias("max_weight"),
        lse.alias("log_sum_exp"),
        (lse - F.col("weighted_logit") / F.col("total")).alias("entropy"),
    )


def assert_same(found, expected):
    found, expected = by_query(found), by_query(expected)
    assert found.keys() == expected.keys() and found
    for key, values in found.items():
        assert values == pytest.approx(expected[key], rel=1e-9, abs=1e-12), key


@pytest.fixture(params=[3, 10_000])
def batch(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("tile, scale", [(5, 1.0), (64, 40.0), (4096, 1.0)])
def test_figures_are_those_of_all_pairs(spark, batch, tile, scale):
    # two sequences under one id, one without an id, one of a single token
    sizes = [(1, 70), (2, 9), (2, 30), (None, 6), (3, 1), *[(i, 4) for i in range(10, 25)]]
    encoded = sampled(spark, sizes, 0.5, scale)
    pairs = attention.causal_pairs(*pairs_of(encoded), LAYOUT, tile=tile)
    assert_same(query_rows.query_figures(encoded, LAYOUT, tile=tile), attention.logit_rows(pairs))
    assert_same(
        query_rows.softmax_rows(encoded, LAYOUT, tile=tile),
        softmax_of(pairs),
    )
    capped = attention.causal_pairs(*pairs_of(encoded), LAYOUT, 2.0, tile)
    assert_same(query_rows.query_figures(encoded, LAYOUT, 2.0, tile=tile), attention.logit_rows(capped))


def test_any_number_of_pairs_at_once(spark, monkeypatch):
    encoded = sampled(spark, [(1, 40), (2, 25), (4, 3)], 0.7)
    rows = query_rows.tiles_of_rows(encoded, 8).coalesce(1).sortWithinPartitions(
        "example_id", "layer", "_tile", "_is_key", "position"
    )
    batches = rows.toArrow().combine_chunks().to_batches()
    tables = []
    for pairs in (1, 7, 1 << 15):
        monkeypatch.setattr(query_rows, "PAIRS_AT_ONCE", pairs)
        over = query_rows._over_batches(LAYOUT, None, True)
        tables.append([b.to_pylist() for b in over(iter(batches))])
    assert tables[0] == tables[1] == tables[2] and tables[0]


def test_nothing_and_wrong_vectors(spark):
    encoded = sampled(spark, [(1, 10)], 1.0)
    assert query_rows.query_figures(encoded.limit(0), LAYOUT).collect() == []
    assert query_rows.query_figures(encoded.filter("kind = 'q'"), LAYOUT).collect() == []
    short = encoded.withColumn("flat", F.slice("flat", 1, 6))
    with pytest.raises(Exception, match="12 entries expected, got 6"):
        query_rows.query_figures(short, LAYOUT).collect()
    empty = encoded.withColumn("flat", F.transform("flat", lambda x: F.when(x > 0, x)))
    with pytest.raises(Exception, match="null in a vector"):
        query_rows.query_figures(empty, LAYOUT).collect()


@pytest.mark.parametrize("name", ["attention_softmax", "attention_logits", "logit_softcap"])
def test_the_capture_is_read_once(spark, small, name):
    plan = Q.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "text#" in line]
    assert len(scans) == 1
    # rows meet their vectors, and the rows of their sequence; figures are not shuffled
    assert plan.count("Join") <= 1 and "HashAggregate" not in plan
    assert sum("hashpartitioning(example_id" in line for line in plan.splitlines()) == 1
