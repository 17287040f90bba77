"""Sessions on a branch: add rows, replace configs, or replace everything.

Every session is one commit (see ``sources.commits``): it refuses a second model and keeps
the token policy of the first write, also if another session gets ahead of it while it
writes.  What the records say follows from the log, whose entries were counted in the files
that were written:

* the ledger: what each session added, as counts per config and bucket;
* the manifest: model name, metadata and exact counts per bucket of what is stored now.
  One row without a bucket keeps the record of an empty branch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.sources import catalogue, commits
from stratavec.sources.commits import APPEND, REPLACE_ALL, REPLACE_CONFIGS, Commit
from stratavec.streaming import live

__all__ = [
    "APPEND", "REPLACE_ALL", "REPLACE_CONFIGS", "add_session", "add_stream_session",
    "ledger_counts", "read_ledger", "read_manifest",
]


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(model_name, metadata, bucket, n_rows, branch)`` of all branches."""
    newest = commits.log_table(spark, root).groupBy("branch").agg(
        F.max_by(F.struct("model_name", "metadata"), "version").alias("record")
    )
    record = newest.select("branch", "record.model_name", "record.metadata")
    counts = (
        commits.stored_cells(spark, root)
        .groupBy("branch", "bucket")
        .agg(F.sum("n_rows").alias("n_rows"))
    )
    empty = newest.select(
        "branch", F.lit(None).cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("n_rows")
    )
    return counts.unionByName(empty).join(record, "branch").select(
        "model_name", "metadata", "bucket", "n_rows", "branch"
    )


def read_ledger(spark: SparkSession, root: str, branch: str) -> DataFrame:
    """Counts of every session since everything was last replaced."""
    log = commits.log_table(spark, root).filter(F.col("branch") == branch)
    began = log.agg(F.max("first")).scalar()
    return log.filter(F.col("version") >= began).select(
        F.explode("added").alias("cell"),
        "has_tokens",
        "branch",
        (F.col("version") - F.col("first")).cast("int").alias("session"),
    ).select("cell.*", "has_tokens", "branch", "session")


def ledger_counts(spark: SparkSession, root: str, branch: str) -> DataFrame:
    """Rows per bucket over all sessions; a config written twice counts twice."""
    return read_ledger(spark, root, branch).groupBy("bucket").agg(
        F.sum("n_rows").alias("n_rows")
    )


class AlreadyWritten(RuntimeError):
    """A micro-batch that was committed before."""


def _check(
    last: Commit | None,
    added: list[dict],
    *,
    branch: str,
    model_name: str,
    mode: str,
    has_tokens: bool,
    stream: tuple[str, int] | None,
) -> None:
    """Whether rows may be put behind an entry."""
    if last is None:
        return
    if last.model_name not in (None, model_name):
        raise ValueError(
            f"one model per branch: {branch} would hold {last.model_name} and {model_name}"
        )
    if stream is not None and last.streams.get(stream[0], -1) >= stream[1]:
        raise AlreadyWritten
    if mode == APPEND and has_tokens:
        for cell in added:
            if not last.tokens.get(cell["config"], True):
                raise ValueError(
                    f"token strings given for {cell['config']} after rows without them"
                )


def add_session(
    rows: DataFrame,
    *,
    root: str,
    branch: str,
    model_name: str,
    mode: str = APPEND,
    metadata: Mapping[str, object] | None = None,
    stream: tuple[str, int] | None = None,
) -> Commit:
    """Add captured rows to a branch, or replace its configs or all of it.

    Metadata is merged into that of earlier sessions, except where everything is
    replaced.  ``stream`` names a stream and its micro-batch, which counts only once.
    """
    has_tokens = "token_str" in rows.columns
    rules = dict(branch=branch, model_name=model_name, mode=mode, has_tokens=has_tokens, stream=stream)
    return catalogue.commit_rows(
        rows,
        root,
        branch,
        mode,
        check=lambda last, added: _check(last, added, **rules),
        model_name=model_name,
        metadata={k: str(v) for k, v in (metadata or {}).items()},
        streams=dict([stream]) if stream is not None else None,
    )


def add_stream_session(
    stream: DataFrame,
    *,
    root: str,
    branch: str,
    model_name: str,
    checkpoint: str,
    metadata: Mapping[str, object] | None = None,
) -> None:
    """Process what a captured stream holds now; every micro-batch is one commit.

    A micro-batch that is run again after a failure finds itself in the log, so its rows
    are there once.  Streams and other sessions may write to one branch.
    """
    common = dict(root=root, branch=branch, model_name=model_name, metadata=metadata)

    def sink(batch: DataFrame, number: int) -> None:
        try:
            add_session(batch, stream=(checkpoint, number), **common)
        except AlreadyWritten:
            pass

    spark = stream.sparkSession
    live.run_to_end(stream, sink, checkpoint, "append")
    if commits.latest(spark, catalogue.branch_path(root, branch)) is None:
        empty = spark.createDataFrame([], catalogue.STORED)
        add_session(empty if "token_str" in stream.columns else empty.drop("token_str"), **common)
