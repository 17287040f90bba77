"""Capture of a corpus that keeps growing.

Draws depend on keys only, never on arrival order, so a stream gives the same
rows as a batch over the same texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratavec.sources import commits
from stratavec.sources.catalogue import stored_form

# Sub-partitions per config in one micro-batch, so a large config is not one task;
# raise it with the size of a micro-batch.
CONFIG_SPLITS = 8


def run_available(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: tuple[str, ...] = (),
) -> None:
    """Process all input that is there now, append it as Parquet, and stop."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()


def stream_capture(
    capture_stream: DataFrame, path: str, checkpoint: str, splits: int = CONFIG_SPLITS
) -> None:
    """Append captured rows per config.  The file sink logs each micro-batch,
    so a batch that is retried after a failure is not written twice."""
    split = F.pmod(F.xxhash64("example_id"), F.lit(splits))
    rows = stored_form(capture_stream).repartition(F.col("config"), split)
    run_available(rows, path, checkpoint, ("config",))


def stream_bucket_counts(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Running rows per bucket; the state store holds one row per bucket.

    Each micro-batch replaces the whole small table, so a retry is harmless.
    """
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n_rows"))

    def replace(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    run_to_end(counts, replace, checkpoint, "complete")
    _something(counts, path)


def run_taken(stream: DataFrame, limit: int, path: str, checkpoint: str) -> None:
    """Writes the first ``limit`` rows of a stream that carries places, over all its
    micro-batches and restarts, to ``path``, and drops the rest.

    Files count in the order of the micro-batches and, inside one, of their paths.  A
    micro-batch counts its files, and its own total is noted beside the checkpoint, so the
    next one knows how many rows came before; each row then decides for itself.  Many
    tasks write, none counts the whole stream.  A micro-batch that is run again finds its
    note and replaces its own folder.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = commits.children(spark, f"{checkpoint}/taken")
        notes = {int(n[:20]): int(n[21:]) for n in names if not n.startswith(".")}
        before = sum(n for k, n in notes.items() if k < number)
        if before >= limit:
            return
        counts = batch.groupBy("_file").count().collect()
        offsets = []
        for file, n in sorted(tuple(r) for r in counts):
            offsets.append((file, before))
            before += n
        if number not in notes:
            own = sum(n for _, n in counts)
            commits.create_once(spark, f"{checkpoint}/taken/{number:020d}-{own}", "")
        if offsets:
            start = spark.createDataFrame(offsets, "_file string, _before bigint")
            rows = batch.join(start, "_file").filter(F.col("_before") + F.col("_row") < limit)
            target = f"{path}/batch={number}"
            rows.drop("_file", "_row", "_before").write.mode("overwrite").parquet(target)

    run_to_end(stream, take, checkpoint, "append")
    # beside the folders of later micro-batches, if any come
    _something(stream.drop("_file", "_row"), path, "/batch=-1")


def _something(rows: DataFrame, path: str, below: str = "") -> None:
    """An empty table at ``path`` where a stream had nothing to write."""
    spark = rows.sparkSession
    if not commits.exists(spark, path):
        spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(path + below)


def run_to_end(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
) -> StreamingQuery:
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
