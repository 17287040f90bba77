"""Commits: half-way jobs, two writers at once, counts without reading."""

from __future__ import annotations

import os
import shutil
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stratavec.plans import sessions
from stratavec.sources import catalogue, commits

ROWS = (
    "layer int, head int, kind string, bucket int, example_id bigint, position int, "
    "vector array<float>, sliding_window int, token_str string"
)


def rows(spark, *keys, bucket=2, n=1):
    data = [
        (layer, head, kind, bucket, i, 3, [1.0, 2.0], None, "t") for layer, head, kind in keys for i in range(n)
    ]
    return spark.createDataFrame(data, ROWS)


Q, K = (0, 0, "q"), (0, 0, "k")


@pytest.fixture()
def at(tmp_path):
    return {"root": str(tmp_path / "root"), "branch": "b", "model_name": "one"}


def stored(spark, at):
    return sorted((r.config, r.bucket) for r in catalogue.read_branches(spark, at["root"]).collect())


def manifest(spark, at):
    found = sessions.read_manifest(spark, at["root"]).filter("bucket is not null").collect()
    return {r.bucket: r.n_rows for r in found}


def ledger(spark, at):
    return {r.bucket: r.n_rows for r in sessions.ledger_counts(spark, at["root"], "b").collect()}


def recount(spark, at):
    found = catalogue.read_branches(spark, at["root"]).groupBy("bucket").count().collect()
    return {r.bucket: r["count"] for r in found}


def test_a_job_that_ends_half_way_leaves_the_branch(spark, at):
    sessions.add_session(rows(spark, Q, K), **at)
    wrong = F.raise_error(F.lit("lost")).cast("int")
    broken = rows(spark, Q, K, n=50).repartition(8).withColumn(
        "bucket", F.when(F.col("example_id") == 49, wrong).otherwise(F.col("bucket"))
    )
    for mode in commits.MODES:
        with pytest.raises(Exception, match="lost"):
            sessions.add_session(broken, mode=mode, **at)
        assert stored(spark, at) == [("l00h00k", 2), ("l00h00q", 2)]
        assert manifest(spark, at) == ledger(spark, at) == {2: 2}
    # all rows written, but the job ended before its entry
    path = catalogue.branch_path(at["root"], "b")
    folder, added = catalogue.write_snapshot(rows(spark, Q, bucket=7), path)
    assert added == [{"config": "l00h00q", "bucket": 7, "n_rows": 1}]
    assert stored(spark, at) == [("l00h00k", 2), ("l00h00q", 2)]
    assert commits.expire(spark, path, 3600) == []
    assert folder in commits.expire(spark, path, 0)
    assert stored(spark, at) == [("l00h00k", 2), ("l00h00q", 2)]


def at_once(n, job):
    """``job(i)`` from several threads that start together; results or errors."""
    gate = threading.Barrier(n)

    def run(i):
        gate.wait()
        try:
            return job(i)
        except Exception as error:  # noqa: BLE001
            return error

    with ThreadPoolExecutor(n) as pool:
        return list(pool.map(run, range(n)))


def test_appends_at_once_are_all_kept(spark, at):
    frames = [rows(spark, Q, bucket=i, n=i + 1) for i in range(6)]
    done = at_once(6, lambda i: sessions.add_session(frames[i], metadata={f"k{i}": i}, **at))
    assert sorted(c.version for c in done) == list(range(6))
    want = {i: i + 1 for i in range(6)}
    assert manifest(spark, at) == ledger(spark, at) == recount(spark, at) == want
    metadata = sessions.read_manifest(spark, at["root"]).first().metadata
    assert metadata == {f"k{i}": str(i) for i in range(6)}


def test_one_model_under_concurrency(spark, at):
    frames = [rows(spark, Q, bucket=i) for i in range(4)]
    done = at_once(
        4, lambda i: sessions.add_session(frames[i], **{**at, "model_name": f"m{i % 2}"})
    )
    kept = [c for c in done if isinstance(c, commits.Commit)]
    assert len({c.model_name for c in kept}) == 1 and len(kept) == 2
    assert all("one model per branch" in str(e) for e in done if e not in kept)
    assert sum(recount(spark, at).values()) == 2


@pytest.mark.parametrize("mode", [commits.REPLACE_ALL, commits.REPLACE_CONFIGS])
def test_second_replacement_is_a_conflict(spark, at, mode, monkeypatch):
    sessions.add_session(rows(spark, Q, K), **at)
    write, between = catalogue.write_snapshot, []

    def slow(capture, path):
        written = write(capture, path)
        if not between:
            between.append(1)
            sessions.add_session(rows(spark, K, bucket=5), **at)
        return written

    monkeypatch.setattr(catalogue, "write_snapshot", slow)
    with pytest.raises(commits.CommitConflict, match="was written to while"):
        sessions.add_session(rows(spark, Q, bucket=9), mode=mode, **at)
    assert manifest(spark, at) == recount(spark, at) == {2: 2, 5: 1}
    sessions.add_session(rows(spark, Q, bucket=9), mode=mode, **at)
    assert manifest(spark, at) == ({9: 1} if mode == commits.REPLACE_ALL else {2: 1, 5: 1, 9: 1})


def test_an_entry_is_created_once(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    made = at_once(8, lambda i: commits.create_once(spark, path, f"text {i}"))
    assert made.count(True) == 1 and made.count(False) == 7
    with open(path) as f:
        assert f.read() == f"text {made.index(True)}"
    assert commits.children(spark, str(tmp_path / "log")) == ["1.json"]


def test_an_append_reads_no_old_file(spark, at):
    sessions.add_session(rows(spark, Q, K, n=3), **at)
    path = catalogue.branch_path(at["root"], "b")
    first = commits.latest(spark, path).parts[0]["folder"]
    aside = f"{at['root']}-aside"
    shutil.move(f"{path}/{first}", aside)
    sessions.add_session(rows(spark, Q, bucket=4, n=2), **at)
    assert manifest(spark, at) == ledger(spark, at) == {2: 6, 4: 2}
    assert [r.config for r in catalogue.stored_configs(spark, path).orderBy("config").collect()] == [
        "l00h00k", "l00h00q"
    ]
    shutil.move(aside, f"{path}/{first}")
    assert recount(spark, at) == {2: 6, 4: 2}


def test_counts_with_and_without_the_aggregate(spark, at, monkeypatch):
    frame = rows(spark, Q, K, (3, 1, "q"), n=4).withColumn(
        "bucket", F.when(F.col("example_id") < 3, F.col("example_id").cast("int"))
    )
    path = catalogue.branch_path(at["root"], "b")
    want = catalogue.write_snapshot(frame, path)[1]
    assert {(c["config"], c["bucket"]): c["n_rows"] for c in want} == {
        (c, b): 1 for c in ("l00h00q", "l00h00k", "l03h01q") for b in (0, 1, 2, None)
    }
    monkeypatch.setattr(catalogue, "CELLS", 3)
    assert catalogue.write_snapshot(frame, path)[1] == want


def test_configs_without_opening_files(spark, at):
    catalogue.publish_branch(rows(spark, Q, K), at["root"], "b")
    catalogue.replace_branch_configs(rows(spark, Q, (100, 2, "k")), at["root"], "b")
    path = catalogue.branch_path(at["root"], "b")
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(b"no parquet")
    listed = catalogue.stored_configs(spark, path)
    assert {tuple(r) for r in listed.collect()} == {
        ("l00h00q", 0, 0, "q"), ("l00h00k", 0, 0, "k"), ("l100h02k", 100, 2, "k")
    }
    assert "FileScan" not in listed._jdf.queryExecution().executedPlan().toString()
    plain = f"{at['root']}/plain"
    catalogue.write_capture(rows(spark, Q), plain)
    assert [r.config for r in catalogue.stored_configs(spark, plain).collect()] == ["l00h00q"]


def test_mixed_root(spark, at):
    catalogue.publish_branch(rows(spark, Q), at["root"], "b")
    catalogue.write_capture(rows(spark, K), catalogue.branch_path(at["root"], "plain"))
    found = catalogue.read_branches(spark, at["root"]).collect()
    assert sorted((r.branch, r.config) for r in found) == [("b", "l00h00q"), ("plain", "l00h00k")]
    assert catalogue.read_config(spark, at["root"], "plain", "l00h00k").count() == 1
    assert catalogue.read_config(spark, at["root"], "none", "l00h00k").count() == 0


def test_no_aggregate_beside_the_writing(spark, at, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("rows are counted while they are written")

    monkeypatch.setattr(DataFrame, "observe", refused)
    path = catalogue.branch_path(at["root"], "b")
    want = [{"config": c, "bucket": 2, "n_rows": 3} for c in ("l00h00k", "l00h00q")]
    frame = rows(spark, Q, K, n=3).withColumn("bucket", F.lit(2))
    assert catalogue.write_snapshot(frame, path)[1] == want
    assert catalogue.write_snapshot(frame.limit(0), path)[1] == []


def test_names_without_a_pattern_for_each_row(spark):
    from stratavec.functions.naming import config_name

    numbers = [0, 9, 10, 99, 100, -1]
    frame = spark.createDataFrame([(a, b) for a in numbers for b in numbers], "layer int, head int")
    named = frame.withColumn("c", config_name(F.col("layer"), F.col("head"), F.lit("q")))
    for r in named.collect():
        assert r.c == "l%02dh%02dq" % (r.layer, r.head)
    assert "format_string" not in named._jdf.queryExecution().executedPlan().toString()
