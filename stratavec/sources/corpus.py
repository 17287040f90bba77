"""Reading and preparing a text corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.session import checkpointed, spread

# Up to this many ids are found with a top-k; beyond it by ordinal.
TOPK_LIMIT = 10_000
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def scan_corpus(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    fmt: str = "parquet",
    keep: tuple[str, ...] = (),
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Id and text column of a corpus, plus the columns named in ``keep``.

    ``fmt`` is any Spark file format, or ``table`` for a catalogue table.
    """
    if fmt == "table":
        source = spark.read.table(path)
    else:
        reader = spark.read.format(fmt)
        source = (reader.schema(schema) if schema is not None else reader).load(path)
    columns = [F.col(id_col).alias("example_id"), F.col(text_col).alias("text")]
    return spread(source.select(*columns, *keep))


def with_label(df: DataFrame, n_chars: str = "n_chars") -> DataFrame:
    """Length class of a text: short, medium or long."""
    size = F.col(n_chars)
    label = F.when(size >= 5000, "long").when(size >= 1500, "medium").otherwise("short")
    return df.withColumn("length", label)


def label_subset(df: DataFrame, label_col: str, value: str) -> DataFrame:
    return df.filter(F.col(label_col) == value)


def project_id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def subset_counts(df: DataFrame, condition: Column) -> DataFrame:
    """Rows before and after a filter, in one pass."""
    return df.agg(
        F.count("*").alias("rows_before"), F.count_if(condition).alias("rows_after")
    )


def with_ordinal(df: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """0-based index of every row in key order, without a one-partition window.

    Rows are range partitioned and sorted; each row then knows its partition and
    its place in it, and the sizes of the partitions before give the offset.
    The offsets are one row per partition.  Keep ``df`` narrow: it is
    checkpointed once, because partition ids must not change between the pass
    that counts and the pass that adds.
    """
    spot = F.monotonically_increasing_id()
    placed = checkpointed(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_spot", spot)
    )
    part = F.shiftright(F.col("_spot"), _ROW_BITS)
    row = F.col("_spot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # one row per partition, whatever the size of the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row)
        .drop("_spot", "_part", "_offset")
    )


def corpus_take(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in key order; ``key`` must be unique.

    Only keys are sorted; the texts are then picked by a semi join.
    """
    if limit <= TOPK_LIMIT:
        first = F.broadcast(df.select(key).orderBy(key).limit(limit))
    else:
        first = with_ordinal(df.select(key), key).filter(F.col("ordinal") < limit).select(key)
    return df.join(first, key, "left_semi")


def file_offsets(rows: DataFrame) -> list[tuple[str, int, int]]:
    """``(file, rows before it, rows in it)`` of a Parquet scan, in the order of paths.

    No column is read: the row counts are those of the footers.
    """
    counts = rows.select(F.col("_metadata.file_path").alias("file")).groupBy("file").count()
    out, before = [], 0
    for file, n in sorted(tuple(r) for r in counts.collect()):
        out.append((file, before, n))
        before += n
    return out


def scan_in_order(
    spark: SparkSession,
    path: str,
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    limit: int | None = None,
) -> DataFrame:
    """Texts of a Parquet corpus without ids: ``example_id`` is the place of a row in its
    source, counted over the files in the order of their paths.

    ``limit`` keeps the first rows as they lie; files behind them are not read.  There is
    no key, sort or shuffle: every row knows its place in its file, and the rows in the
    files before come from the footers (one number a file).
    """
    rows = spark.read.parquet(path)
    offsets = file_offsets(rows)
    if limit is not None:
        offsets = [o for o in offsets if o[1] < limit]
    if not offsets:
        return rows.select(F.lit(0).cast("bigint").alias("example_id"), F.col(text_col).alias("text"), *keep).limit(0)
    if limit is not None:
        rows = spark.read.schema(rows.schema).parquet(*[o[0] for o in offsets])
    before = spark.createDataFrame([o[:2] for o in offsets], "_file string, _before bigint")
    placed = rows.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
        F.col(text_col).alias("text"),
        *keep,
    )
    ordered = placed.join(before, "_file").select(
        (F.col("_before") + F.col("_row")).alias("example_id"), "text", *keep
    )
    return ordered if limit is None else ordered.filter(F.col("example_id") < limit)


def row_target(df: DataFrame, max_samples: int | None) -> DataFrame:
    """Expected number of rows of a run."""
    count = F.count("*")
    target = count if max_samples is None else F.least(count, F.lit(max_samples).cast("bigint"))
    return df.agg(target.alias("row_target"))


def batch_number(ordinal: Column, batch_size: int) -> Column:
    return F.floor(ordinal / F.lit(batch_size)).cast("bigint")


def batch_profile(df: DataFrame, id_col: str, text_col: str, batch_size: int) -> DataFrame:
    """Rows and text lengths of every batch of consecutive examples."""
    sizes = df.select(id_col, F.length(text_col).cast("bigint").alias("chars"))
    return (
        with_ordinal(sizes, id_col)
        .groupBy(batch_number(F.col("ordinal"), batch_size).alias("batch_no"))
        .agg(
            F.count("*").alias("n_rows"),
            F.min("chars").alias("min_chars"),
            F.avg("chars").alias("avg_chars"),
            F.max("chars").alias("max_chars"),
        )
    )


def corpus_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    id_col: str = "doc_id",
    text_col: str = "text",
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_trigger: int | None = None,
    places: bool = False,
) -> DataFrame:
    """The corpus as an endless source: new files are picked up as they arrive.

    With ``places`` rows also carry their file and their place in it, which
    ``streaming.live.run_taken`` counts by.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    own = [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    ]
    return reader.load(folder).select(
        F.col(id_col).alias("example_id"), F.col(text_col).alias("text"), *(own if places else ())
    )
