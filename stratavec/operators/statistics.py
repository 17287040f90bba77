"""Counts, guards and metadata of a capture."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: metadata keys that the dataset card shows in lines of their own
KNOWN_KEYS = (
    "source_dataset",
    "dataset_name",
    "dataset_split",
    "attention_scope",
    "sampling_strategy",
    "sampling_min_bucket_size",
    "sampling_bucket_size",
    "distributed_world_size",
)


def bucket_counts(capture: DataFrame) -> DataFrame:
    """Rows per bucket over all configs."""
    return capture.groupBy("bucket").agg(F.count("*").alias("n_rows"))


def add_to_ledger(ledger: DataFrame | None, session_counts: DataFrame) -> DataFrame:
    """Counts summed over sessions.  A config written twice is counted twice."""
    rows = session_counts.select("bucket", "n_rows")
    if ledger is not None:
        rows = ledger.select("bucket", "n_rows").unionByName(rows)
    return rows.groupBy("bucket").agg(F.sum("n_rows").alias("n_rows"))


def model_violations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Branches that would hold more than one model."""
    names = stored.select("branch", "model_name").unionByName(
        incoming.select("branch", "model_name")
    )
    return (
        names.groupBy("branch")
        .agg(
            F.min("model_name").alias("first_model"),
            F.max("model_name").alias("other_model"),
            F.count_distinct("model_name").alias("n_models"),
        )
        .filter("n_models > 1")
    )


def require_one_model(stored: DataFrame, incoming: DataFrame) -> None:
    bad = model_violations(stored, incoming).head(1)
    if bad:
        raise ValueError(
            f"one model per branch: {bad[0]['branch']} would hold "
            f"{bad[0]['first_model']} and {bad[0]['other_model']}"
        )


def bucket_line(counts: DataFrame, *by: str) -> DataFrame:
    """Text such as ``b2=1, b5=1`` and the row total, from bucket counts."""
    line = F.expr(
        "listagg(concat('b', bucket, '=', n_rows), ', ') within group (order by bucket)"
    )
    return counts.groupBy(*by).agg(line.alias("bucket_line"), F.sum("n_rows").alias("n_rows"))


def dataset_card_stats(capture: DataFrame, branch: str = "branch") -> DataFrame:
    """Figures of the dataset card, one row per branch.

    Rows are first counted per config and bucket; everything after that works
    on that small table.
    """
    cells = capture.groupBy(branch, "config", "bucket").agg(F.count("*").alias("n_rows"))
    configs = (
        cells.select(branch, "config")
        .distinct()
        .groupBy(branch)
        .agg(
            F.count("*").alias("n_configs"),
            F.expr("listagg(config, ', ') within group (order by config)").alias("config_list"),
        )
    )
    counts = cells.groupBy(branch, "bucket").agg(F.sum("n_rows").alias("n_rows"))
    return configs.join(bucket_line(counts, branch), branch)


def dataset_card(capture: DataFrame, manifest: DataFrame) -> DataFrame:
    """All fields of the dataset card, one row per branch."""
    runs = manifest.groupBy("branch").agg(
        F.first("model_name").alias("model"), F.first("metadata").alias("_m")
    )
    entry = lambda key, default=None: (
        F.coalesce(F.col("_m")[key], F.lit(default)) if default is not None else F.col("_m")[key]
    )
    size = lambda key: F.when(entry(key).isNotNull(), plain_number(entry(key)))
    return dataset_card_stats(capture).join(
        runs.select(
            "branch",
            "model",
            entry("source_dataset", "unknown").alias("source_dataset"),
            entry("dataset_name", "").alias("dataset_name"),
            entry("dataset_split", "unknown").alias("dataset_split"),
            entry("attention_scope", "unknown").alias("attention_scope"),
            entry("sampling_strategy", "unknown").alias("sampling_strategy"),
            size("sampling_min_bucket_size").alias("min_bucket_size"),
            size("sampling_bucket_size").alias("bucket_size"),
            plain_number(entry("distributed_world_size")).alias("world_size"),
        ),
        "branch",
    )


def capture_counters(capture: DataFrame) -> DataFrame:
    """Captured rows, payloads (one per example, layer and kind) and configs."""
    cells = capture.groupBy("example_id", "layer", "kind", "config").agg(F.count("*").alias("n"))
    # a distinct payload or config is counted at its first cell, without distinct counts
    payloads = cells.groupBy("example_id", "layer", "kind").agg(
        F.sum("n").alias("n"), F.collect_set("config").alias("configs")
    )
    return payloads.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("captured_rows"),
        F.count("*").alias("captured_payloads"),
        F.size(F.array_distinct(F.flatten(F.collect_set("configs")))).cast("bigint").alias(
            "captured_configs"
        ),
    )


def plain_number(value: Column) -> Column:
    """Number as text, whole floats without a fraction; missing is ``unknown``."""
    text = value.cast("string")
    return F.coalesce(
        F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text),
        F.lit("unknown"),
    )


def extra_metadata(runs: DataFrame, run: str, metadata: str = "metadata") -> DataFrame:
    """Metadata entries beyond the known keys, numbered in key order, with their
    line on the dataset card."""
    known = F.array(*[F.lit(k) for k in KNOWN_KEYS])
    extra = F.array_sort(F.array_except(F.map_keys(metadata), known))
    entries = runs.select(run, metadata, F.posexplode(extra).alias("ordinal", "key"))
    value = F.element_at(F.col(metadata), F.col("key"))
    return entries.select(
        run,
        "ordinal",
        "key",
        value.alias("value"),
        F.concat(F.lit("- `"), "key", F.lit("`: `"), value, F.lit("`")).alias("line"),
    )


def sampler_metadata(strategy: str, bucket_size: int) -> dict[str, str]:
    """Entries that the sampler adds where the run did not set them."""
    if strategy == "log_uniform":
        power = (bucket_size - 1).bit_length()
        return {"sampling_strategy": "log", "sampling_min_bucket_size": str(1 << power)}
    return {"sampling_strategy": strategy, "sampling_bucket_size": str(bucket_size)}


def run_metadata(explicit: DataFrame, defaults: Mapping[str, str], run: str) -> DataFrame:
    """Entries ``(run, key, value)``: explicit ones win over the defaults.

    Every run gets the few defaults by an explode, and the winner of a key is
    an aggregate with map-side combine, not a window.
    """
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in defaults.items()]
    )
    base = (
        explicit.select(run)
        .distinct()
        .select(run, F.explode(pairs).alias("_p"))
        .select(run, "_p.key", "_p.value", F.lit(0).alias("_rank"))
    )
    rows = explicit.select(run, "key", "value", F.lit(1).alias("_rank")).unionByName(base)
    return rows.groupBy(run, "key").agg(F.max_by("value", "_rank").alias("value"))
