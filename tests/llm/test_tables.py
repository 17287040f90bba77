"""Search, chat and the whole pipeline."""

from __future__ import annotations

import random

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratavec.llm import chat, line_dedup, packing, quality_rules, simhash, topk
from stratavec.llm.queries import ORACLES, QUERIES


def plain_top(rows, k=10, step=100):
    fine = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]
        fine[i] = min(fine.get(i, whole), whole)
    out = []
    for q, v in fine.items():
        if q % step:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), i) for i, w in fine.items() if i != q
        )
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks_per_chunk", [256, 2])
def test_topk(spark, monkeypatch, blocks_per_chunk):
    monkeypatch.setattr(topk, "BLOCKS_PER_CHUNK", blocks_per_chunk)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 4)
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).round(1).tolist()) for i in range(0, 900)]
    rows += [(1000 + i, [0.5] * 6) for i in range(120)]  # ties
    rows += [(None, [1.0] * 6), (2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6)]
    rows += [(2003, [float("inf")] * 6), (2004, []), (2005, [9.0]), (5, [0.0] * 6), (7, rows[7][1])]
    rows += [(-100, [0.25] * 6)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.nearest(frame).collect())
    assert got == plain_top(rows)
    assert topk.nearest(frame.limit(0)).collect() == []


def test_scores_beyond_double_precision_are_exact():
    a = np.array([[2**30 + 1, 3]], dtype=np.int64)
    assert topk._exact(a, a)[0, 0] == (2**30 + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        topk._exact(a * 4, a * 4)


def test_chat(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", None),
        (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
        (2, 0, "user", "same"), (3, 0, "user", "same"),
        (4, 0, None, "x"), (4, 0, None, "x"), (5, 0, None, "x"),
        (6, 0, "user", "no partner"), (None, 0, "user", "y"),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, chosen string")
    got = {r["pair_id"]: r.asDict() for r in chat.preference_rows(frame).collect()}
    assert got.keys() == {0, 1, 2}
    first = got[0]
    assert first["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and first["n_common"] == 1
    span = [int(x) for x in first["chosen_mask"].split("-")]
    assert first["chosen"][span[0] : span[1]] == "yes<|im_end|>\n"
    assert first["rejected"].startswith("<|im_start|>assistant\nno")
    assert (got[1]["n_common"], got[1]["chosen"], got[1]["rejected"]) == (1, "", "")
    assert (got[2]["n_common"], got[2]["rejected"]) == (1, "")
    assert chat.preference_rows(frame.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    mine = compare.spark_rows(QUERIES[name](spark, small))
    assert compare.difference(mine, compare.duck_rows(compare.duck(small), ORACLES[name])) is None


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    counts = [n]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        docs = corpus_pipeline.stored(docs, f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[3] == counts[2] and counts[4] < counts[3]
    ids = {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == ids
    # one of every group is left
    prints = simhash.near_duplicates(docs)
    assert prints.filter("doc_id != component_id").count() == 0


def test_stages_on_empty_and_awkward_tables(spark, small, docs_of):
    awkward = docs_of([(None, None), (None, "a b"), (1, ""), (1, ""), (2, "x\n" * 5), (3, None)])
    for frame in (awkward, awkward.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, small)
            assert out.columns == frame.columns
            out.collect()
        assert len(corpus_pipeline.STAGES[-1][1](spark, frame, small).collect()) == frame.count()


def test_native_operator_has_no_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = line_dedup.shorten(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
