"""The written capture: one Parquet partition per config, one folder per branch.

Layout of a branch: ``<root>/branch=<name>/snapshot=<id>/config=<lLLhHHk>/part-*.parquet``
and the log of ``commits``, which says what counts.  A single capture written to a path
of its own, and what a stream's file sink writes, is ``<path>/config=<lLLhHHk>/``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.functions.naming import CONFIG_PATTERN, config_name, config_parts
from stratavec.sources import commits

DATA_COLUMNS = ("bucket", "example_id", "position", "vector", "sliding_window", "token_str")
STORED = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("example_id", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("sliding_window", T.IntegerType()),
        T.StructField("token_str", T.StringType()),
        T.StructField("config", T.StringType()),
    ]
)
BRANCHED = T.StructType(STORED.fields + [T.StructField("branch", T.StringType())])
# A file is closed after this many rows (about 1 GB at 128 floats per vector).
ROWS_PER_FILE = 2_000_000
# counts per config and bucket that are fetched at once; more come a partition at a time
CELLS = 200_000


def stored_form(capture: DataFrame) -> DataFrame:
    """Capture rows with the columns and types of the catalogue."""
    rows = capture
    if "config" not in rows.columns:
        rows = rows.withColumn("config", config_name(F.col("layer"), F.col("head"), F.col("kind")))
    if "token_str" not in rows.columns:
        rows = rows.withColumn("token_str", F.lit(None))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED.fields])


def _arranged(capture: DataFrame) -> DataFrame:
    # Rebalance gathers each config into few files; AQE splits a config that is
    # too large for one task and merges small ones, so no config is a bottleneck.
    return (
        stored_form(capture)
        .hint("rebalance", "config")
        .sortWithinPartitions("config", "example_id", "position")
    )


def _written(rows: DataFrame, mode: str):
    return (
        rows.write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("config")
    )


def _writer(capture: DataFrame, mode: str):
    return _written(_arranged(capture), mode)


def _required_columns(capture: DataFrame) -> None:
    missing = {"bucket", "example_id", "position", "vector"} - set(capture.columns)
    if missing:
        raise ValueError(f"rows to append lack the columns {sorted(missing)}")


def write_snapshot(capture: DataFrame, path: str) -> tuple[str, list[dict]]:
    """Rows in a new folder below ``path``, which no reader knows yet: its name, and the
    counts per config and bucket.

    They are counted in the new files, of which only the bucket is read; that is far less
    work than a count beside the writing, which sees every row once more.
    """
    _required_columns(capture)
    folder = f"snapshot={uuid.uuid4().hex}"
    _written(_arranged(capture), "errorifexists").parquet(f"{path}/{folder}")
    new = capture.sparkSession.read.schema(STORED).parquet(f"{path}/{folder}")
    counted = new.groupBy("config", "bucket").count()
    added = counted.limit(CELLS + 1).collect()
    if len(added) > CELLS:
        added = counted.toLocalIterator()
    counts = [{"config": config, "bucket": bucket, "n_rows": n} for config, bucket, n in added]
    return folder, sorted(counts, key=lambda c: (c["config"], -1 if c["bucket"] is None else c["bucket"]))


def branch_path(root: str, branch: str) -> str:
    return f"{root}/branch={branch}"


def write_capture(capture: DataFrame, path: str) -> None:
    """Write into an empty or reset folder; what was there is dropped."""
    _writer(capture, "overwrite").option("partitionOverwriteMode", "static").parquet(path)


def reset_root(capture: DataFrame, path: str) -> None:
    """Start a run from an empty root: every earlier config disappears."""
    write_capture(capture, path)


def overwrite_configs(capture: DataFrame, path: str) -> None:
    """Replace only the configs that occur in ``capture``."""
    _writer(capture, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_rows(capture: DataFrame, path: str) -> None:
    """Add rows; duplicates are kept."""
    _required_columns(capture)
    _writer(capture, "append").parquet(path)


def commit_rows(
    capture: DataFrame, root: str, branch: str, mode: str, check=lambda last, added: None, **entry
) -> commits.Commit:
    """Rows written and committed on a branch.

    ``check(newest entry, counts of the rows)`` may refuse them; it is asked before
    anything is written, without counts, and again for every entry they are put behind.
    A replacement is refused if the branch has moved on since.
    """
    spark, path = capture.sparkSession, branch_path(root, branch)
    if mode not in commits.MODES:
        raise ValueError(f"unknown session mode {mode}")
    base = commits.latest(spark, path)
    check(base, [])
    folder, added = write_snapshot(capture, path)
    number = lambda last: -1 if last is None else last.version

    def build(last: commits.Commit | None) -> commits.Commit:
        check(last, added)
        if mode != commits.APPEND and number(last) != number(base):
            raise commits.CommitConflict(
                f"branch {branch} was written to while its rows were replaced"
            )
        return commits.following(
            last,
            branch=branch,
            mode=mode,
            folder=folder,
            added=added,
            has_tokens="token_str" in capture.columns,
            **entry,
        )

    return commits.add_commit(spark, path, build)


def publish_branch(capture: DataFrame, root: str, branch: str) -> None:
    """Replace the whole content of one branch; other branches are not touched.

    Readers see the old rows until all new ones are there.
    """
    commit_rows(capture, root, branch, commits.REPLACE_ALL)


def replace_branch_configs(capture: DataFrame, root: str, branch: str) -> None:
    """Replace the configs of a branch that occur in ``capture``; others stay."""
    commit_rows(capture, root, branch, commits.REPLACE_CONFIGS)


def append_to_branch(capture: DataFrame, root: str, branch: str) -> None:
    """Add rows to a branch; duplicates are kept."""
    commit_rows(capture, root, branch, commits.APPEND)


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """All configs below ``path``."""
    entry = commits.latest(spark, path)
    if entry is None:
        return spark.read.schema(STORED).parquet(path)
    return _read_folders(spark, path, _folders(spark, path, entry), STORED)


def _folders(spark: SparkSession, path: str, entry: commits.Commit) -> list[str]:
    """What an entry lists: whole folders, or their configs where some were replaced."""
    out = []
    for part in entry.parts:
        folder = f"{path}/{part['folder']}"
        if part["dropped"]:
            gone = {f"config={c}" for c in part["dropped"]}
            names = [n for n in commits.children(spark, folder) if n.startswith("config=")]
            out += [f"{folder}/{n}" for n in names if n not in gone]
        else:
            out.append(folder)
    return out


def _read_folders(
    spark: SparkSession, base: str, folders: list[str], schema: T.StructType
) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", base).parquet(*folders)
    return rows.select(*schema.fieldNames())


def read_branches(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all branches below a root."""
    names = [n for n in commits.children(spark, root) if n.startswith("branch=")]
    entries = {n: commits.latest(spark, f"{root}/{n}") for n in names}
    folders = [
        f for n, e in entries.items() if e is not None for f in _folders(spark, f"{root}/{n}", e)
    ]
    rows = _read_folders(spark, root, folders, BRANCHED)
    # branches written by other means have no log
    plain = [f"{root}/{n}" for n, e in entries.items() if e is None]
    return rows.unionByName(_read_folders(spark, root, plain, BRANCHED)) if plain else rows


def read_config(spark: SparkSession, root: str, branch: str, config: str) -> DataFrame:
    """One config of one branch; nothing else of the catalogue is listed."""
    rows = _read_below(spark, root, branch, config)
    return rows.filter((F.col("branch") == branch) & (F.col("config") == config))


def read_config_prefix(spark: SparkSession, root: str, branch: str, prefix: str) -> DataFrame:
    """Configs whose name starts with ``prefix``, e.g. ``l00h00`` for q and k."""
    rows = _read_below(spark, root, branch, f"{prefix}*")
    return rows.filter((F.col("branch") == branch) & F.col("config").startswith(prefix))


def _read_below(spark: SparkSession, root: str, branch: str, pattern: str) -> DataFrame:
    path = branch_path(root, branch)
    entry = commits.latest(spark, path)
    parts = [{"folder": "", "dropped": []}] if entry is None else entry.parts
    found = []
    for part in parts:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part['folder']}/config={pattern}")
        system = target.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.globStatus(target) or []:
            if status.getPath().getName().removeprefix("config=") not in part["dropped"]:
                found.append(status.getPath().toString())
    return _read_folders(spark, root, found, BRANCHED)


def stored_configs(spark: SparkSession, path: str) -> DataFrame:
    """``(config, layer, head, kind)`` of a capture, from names and log entries alone.

    No data file is opened.  The configs of a capture are its layers times heads.
    """
    entry = commits.latest(spark, path)
    if entry is None:
        names = {n.removeprefix("config=") for n in commits.children(spark, path) if n.startswith("config=")}
    else:
        names = {
            config
            for part in entry.parts
            for config in commits.read_commit(spark, path, part["version"]).configs()
            if config not in part["dropped"]
        }
    return list_configs(spark.createDataFrame([(n,) for n in sorted(names)], "config string"))


def read_plain_files(spark: SparkSession, root: str) -> DataFrame:
    """Captures written by other tools as ``<root>/<config>/data.parquet``.

    Their ``sliding_window`` is a 64-bit integer where set and untyped where all
    values are null; only an explicit BIGINT reads both.
    """
    fields = [f for f in STORED.fields if f.name not in ("sliding_window", "config", "example_id")]
    schema = T.StructType(
        fields
        + [
            T.StructField("example_id", T.IntegerType()),
            T.StructField("sliding_window", T.LongType()),
        ]
    )
    config = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = spark.read.schema(schema).parquet(f"{root}/*/data.parquet").withColumn("config", config)
    return stored_form(rows.filter(F.col("config").rlike(CONFIG_PATTERN)))


def list_configs(capture: DataFrame) -> DataFrame:
    """Configs present, with their layer, head and kind."""
    layer, head, kind = config_parts(F.col("config"))
    return (
        capture.select("config")
        .distinct()
        .filter(F.col("config").rlike(CONFIG_PATTERN))
        .select("config", layer.alias("layer"), head.alias("head"), kind.alias("kind"))
    )


def union_with_tokens(first: DataFrame, later: DataFrame) -> DataFrame:
    """Add rows under the token policy of the first write.

    First with tokens, later without: the later rows get null.  First without,
    later with: refused.
    """
    if "token_str" in later.columns and "token_str" not in first.columns:
        raise ValueError("token strings given after rows were written without them")
    return first.unionByName(later, allowMissingColumns=True)

