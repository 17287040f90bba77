"""Numbering of consecutive flagged rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER_BLOCK = 4096


def run_groups(
    rows: DataFrame, key: str, order: str, flag: Column, block: int = ORDER_BLOCK
) -> DataFrame:
    """Adds ``run_group``: 0, 1, .. for runs of flagged rows, -1 for the others.

    ``(key, order)`` must be unique.  A key is cut into blocks of the order
    column, so the rows of one long key are spread over many tasks.  Runs are
    numbered inside a block; one summary row per block then tells how many runs
    began before it and whether the last row before it was flagged.
    """
    cut = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn(
        "_block", F.floor(F.col(order) / F.lit(block))
    )
    inside = Window.partitionBy(key, "_block").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the first row of a block is not counted here: its predecessor is elsewhere
    begins = F.col("_flag") & ~F.lag("_flag", 1, True).over(inside)
    numbered = (
        cut.withColumn("_begins", begins.cast("int"))
        .withColumn("_inner", F.sum("_begins").over(upto))
    )
    before = Window.partitionBy(key).orderBy("_block")
    summary = (
        numbered.groupBy(key, "_block")
        .agg(
            F.min_by("_flag", order).alias("_first"),
            F.max_by("_flag", order).alias("_last"),
            F.sum("_begins").alias("_count"),
        )
        .withColumn(
            "_opens", (F.col("_first") & ~F.lag("_last", 1, False).over(before)).cast("int")
        )
        .withColumn(
            "_total",
            F.sum(F.col("_count") + F.col("_opens")).over(
                before.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(key, "_block", "_opens", F.coalesce("_total", F.lit(0)).alias("_before"))
    )
    group = F.col("_before") + F.col("_opens") + F.col("_inner") - 1
    return (
        numbered.join(summary, [key, "_block"])
        .withColumn("run_group", F.when(F.col("_flag"), group).otherwise(-1).cast("int"))
        .drop("_flag", "_block", "_begins", "_inner", "_opens", "_before")
    )


def bounds_in_row(items: Column, flag: Callable[[Column], Column]) -> Column:
    """Places of the items of an array that are not flagged, between -1 and its size."""
    kept = lambda item: F.coalesce(flag(item), F.lit(False))
    stops = F.array_compact(F.transform(items, lambda x, i: F.when(~kept(x), i)))
    return F.concat(F.array(F.lit(-1)), stops, F.array(F.size(items)))


def runs_in_row(bounds: Column) -> tuple[Column, Column]:
    """First and last place of the run of every item, null outside a run: two arrays in the
    row of the sequence, from a column of ``bounds_in_row``.

    Runs of a sequence that lies in one row need no window, join or shuffle.
    """
    n = F.size(bounds) - 1
    outside = F.array(F.lit(None).cast("int"))

    def repeated(value: Callable[[Column, Column], Column]) -> Column:
        run = lambda a, b: F.concat(F.array_repeat(value(a, b), b - a - 1), outside)
        return F.flatten(F.zip_with(F.slice(bounds, F.lit(1), n), F.slice(bounds, F.lit(2), n), run))

    return repeated(lambda a, b: a + 1), repeated(lambda a, b: b - 1)


def spans_of_runs(grouped: DataFrame, key: str, order: str) -> DataFrame:
    """First and last place of every run, ``(key, run_start, run_end)``: partial sums."""
    return (
        grouped.filter("run_group >= 0")
        .groupBy(key, "run_group")
        .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"))
        .drop("run_group")
    )


def run_spans(grouped: DataFrame, key: str, order: str, block: int = ORDER_BLOCK) -> DataFrame:
    """Rows of one run see each other both ways: per row, the span it sees.

    A run may hold most rows, and so may the rows outside any run.  The span of
    a run is repeated for the blocks it covers, so a join key matches at most
    one block of rows; rows outside a run skip the join.
    """
    flagged = grouped.filter("run_group >= 0").withColumn(
        "_block", F.floor(F.col(order) / F.lit(block))
    )
    covered = F.sequence(
        F.floor(F.col("run_start") / F.lit(block)), F.floor(F.col("run_end") / F.lit(block))
    )
    spans = (
        flagged.groupBy(key, "run_group")
        .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"))
        .withColumn("_block", F.explode(covered))
    )
    inside = flagged.join(spans, [key, "run_group", "_block"]).drop("_block")
    return inside.unionByName(grouped.filter("run_group < 0"), allowMissingColumns=True)
