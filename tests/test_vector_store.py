"""A vector table that is met where it lies; keys that are there twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratavec.defaults import Layout
from stratavec.operators import gather, vector_store
from stratavec.operators.vector_store import VectorStore


def vectors(spark, n, step=1):
    return spark.range(n).select(
        (F.col("id") * step).alias("vec_id"),
        F.transform(F.array(*map(F.lit, range(4))), lambda i: (F.col("id") + i).cast("float")).alias("v"),
    )


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "vectors")
    return VectorStore.write(vectors(spark, 20_000), path, ("vec_id",), 4)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_gather(spark, store):
    sample = spark.range(0, 30_000, 7).select(F.col("id").alias("vec_id"), (F.col("id") * 2).alias("n"))
    got = {r["vec_id"]: (r["n"], r["v"]) for r in store.gather(sample).collect()}
    assert len(got) == sample.count()
    for key, (n, v) in got.items():
        assert n == 2 * key
        assert v == ([float(key + i) for i in range(4)] if key < 20_000 else None)
    assert store.gather(sample.limit(0)).collect() == []


def test_the_store_is_not_shuffled(spark, store):
    sample = spark.range(300, 900, 7).select(F.col("id").alias("vec_id"))
    frame = store.gather(sample)
    frame.collect()
    text = plan_of(frame)
    side = text[text.index("FileScan") - 2500 : text.index("FileScan")]
    # what lies between the scan of the store and the join
    steps = text[text.index("SortMergeJoin") :].split("\n")
    scan = next(i for i, line in enumerate(steps) if "FileScan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above, level = [], depth(steps[scan])
    for line in reversed(steps[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert any("BroadcastHashJoin" in line for line in above), side
    assert not any("Exchange" in line for line in above), above
    # ranges of keys reach the scan
    assert "GreaterThanOrEqual(vec_id,300)" in text and "Bucketed: true" in text


def test_ranges_leave_out_row_groups(spark, store):
    ends = spark.range(10).unionByName(spark.range(19_990, 20_000)).select(F.col("id").alias("vec_id"))
    touched = store.touched(ends)
    assert {r["vec_id"] for r in touched.collect()} >= {r["vec_id"] for r in ends.collect()}
    assert touched.count() < 100
    assert "Or(And(" in plan_of(touched)
    assert vector_store.covering_ranges([0, 1, 5], 10, 3) == [(10, 15), (25, 27)]


def test_filter_never_loses_a_key(spark):
    keys = spark.range(0, 5000, 3).select("id")
    for n_keys in (1, 1667, 200_000):
        blocks = vector_store.filter_blocks(n_keys)
        found = vector_store.key_filter(keys, ("id",), blocks)
        passed = vector_store.maybe_in(spark.range(5000), ("id",), found, blocks)
        kept = {r["id"] for r in passed.collect()}
        assert kept >= set(range(0, 5000, 3))
        if n_keys >= 1667:
            assert len(kept) < 1667 + 120  # a few false ones


def test_hot_keys_are_broadcast(spark, store):
    hot = spark.range(5000).select(F.lit(7).cast("bigint").alias("vec_id"), "id")
    cold = spark.range(3000).select((F.col("id") * 5).alias("vec_id"), "id")
    sample = hot.unionByName(cold)
    assert store.hot_keys(sample) == [7]
    frame = store.gather(sample)
    rows = frame.collect()
    assert len(rows) == 8000
    assert all(r["v"] == [float(r["vec_id"] + i) for i in range(4)] for r in rows)
    assert frame.columns == ["vec_id", "id", "v"]


def test_keys_that_are_null_or_missing(spark, store):
    empty = F.when(F.col("id") < 3, F.col("id") + 19_998)
    sample = spark.range(200).select(empty.alias("vec_id"), "id")
    assert store.hot_keys(sample) == []
    rows = {r["id"]: r["v"] for r in store.gather(sample).collect()}
    assert len(rows) == 200 and {i for i, v in rows.items() if v is not None} == {0, 1}
    assert all(r["v"] is None for r in store.gather(sample.filter("vec_id is null")).collect())


def test_the_sample_is_read_twice(spark, store):
    """For its keys and for the join, not for each figure of the keys."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    sample = spark.range(100, 400).select(F.col("id").alias("vec_id")).mapInArrow(passed, "vec_id bigint")
    assert len(store.gather(sample).collect()) == 300
    assert read.value == 600


def test_texts_are_read_for_the_sample_only(spark, small):
    from stratavec.plans import queries as Q

    plan = plan_of(Q.gather_from_store(spark, small))
    assert "text#" not in plan and "token" not in plan


def test_several_keys_and_another_session(spark, tmp_path):
    rows = spark.range(600).select(
        (F.col("id") / 3).cast("bigint").alias("example_id"),
        (F.col("id") % 3).cast("int").alias("position"),
        F.array(F.col("id").cast("float")).alias("vector"),
    )
    path = str(tmp_path / "capture")
    VectorStore.write(rows, path, ("example_id", "position"), 3)
    again = VectorStore.open(spark, path)
    assert again.keys == ("example_id", "position") and again.buckets == 3
    sample = rows.filter("example_id % 10 = 0 and position < 2").select("position", "example_id")
    got = again.gather(sample).collect()
    assert {(r["example_id"], r["position"], r["vector"][0]) for r in got} == {
        (e, p, float(3 * e + p)) for e in range(0, 200, 10) for p in range(2)
    }


def test_keys_there_twice_are_an_error(spark, tmp_path):
    twice = vectors(spark, 5).unionByName(vectors(spark, 1))
    with pytest.raises(ValueError, match="there once"):
        VectorStore.write(twice, str(tmp_path / "a"), ("vec_id",), 2)
    none = vectors(spark, 5).withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))
    with pytest.raises(ValueError, match="there once"):
        VectorStore.write(none, str(tmp_path / "b"), ("vec_id",), 2)
    source = lambda *ids: spark.createDataFrame([(i, [1.0] * 4) for i in ids], "vec_id bigint, embedding array<float>")
    layout = Layout(1, 1, 4, ("full_attention",))
    # least, largest id and number would be right
    for ids in ((0, 0, 2), (0, None, 1, 3)):
        with pytest.raises(ValueError):
            gather.LookupEncoder.over(source(*ids), layout=layout)
    assert gather.LookupEncoder.over(source(0, 1, 2), layout=layout).n_vectors == 3
    sampled = spark.createDataFrame([(1, 0, "q", 0)], "example_id bigint, layer int, kind string, position int")
    own = lambda *heads: spark.createDataFrame(
        [(1, 0, "q", 0, h, [1.0]) for h in heads],
        "example_id bigint, layer int, kind string, position int, head int, vector array<float>",
    )
    assert gather.gather_vectors(sampled, own(0, 1)).count() == 2
    with pytest.raises(ValueError, match="there once"):
        gather.gather_vectors(sampled, own(0, 0))
