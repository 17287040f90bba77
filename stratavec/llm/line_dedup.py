"""Line deduplication: repeated windows of three consecutive lines.

Each text is cut at newlines and every three consecutive lines form a window,
so windows overlap.  A window that already occurred -- in an earlier document, by
id, or further up in the same one -- is a later occurrence, and the lines of all
later occurrences are removed; overlapping ones merge into one covered stretch.
DataFrame functions only.

A window is 128 bits of hash.  Windows are grouped with partial aggregation, so
a window in a third of all documents is one row per task before the shuffle, and
the join back is one Spark may split.  Texts are shuffled once, to meet the
positions to remove.

Defined cases: a null text stays null; a text of fewer than three lines keeps
all of them; windows without any visible character do not count.  Rows equal in
id and text are one document and get the same result; rows of one id with
different texts, and rows without an id (which come first), are told apart by
their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import stored

WINDOW = 3


def _with_lines(text: Column, build: Callable[[Column], Column]) -> Column:
    """``build(lines)`` with the text split once: inside a lambda function an
    expression is worked out again for every element, a variable is not."""
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), build), 0)


def _windows(lines: Column) -> Column:
    """Array of (position, two hashes) of the windows of a text."""
    last = F.size(lines) - WINDOW

    def window(i: Column) -> Column:
        part = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*part).alias("h1"),
            F.xxhash64(F.lit(1), *part).alias("h2"),
            F.length(F.trim(F.concat(*part))).alias("visible"),
        )

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window))


def window_table(docs: DataFrame) -> DataFrame:
    """One row per window: document, position and hashes."""
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("copy"),
        F.explode(_with_lines(F.col("text"), _windows)).alias("w"),
    )
    return rows.filter("w.visible > 0").select("doc_id", "copy", "w.pos", "w.h1", "w.h2")


def later_windows(windows: DataFrame) -> DataFrame:
    """Windows that are not the first with their content."""
    place = F.struct("doc_id", "copy", "pos")
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last")))
        .select("h1", "h2", "first")
    )
    return (
        windows.join(repeated, ["h1", "h2"])
        .filter(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "copy", "pos")
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``(row, text, n_lines, n_removed)``: every row of ``docs`` and its new text."""
    windows = stored(window_table(docs), "line-windows")
    covered = (
        later_windows(windows)
        .groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        .agg(F.collect_set("pos").alias("_pos"))
    )
    # the row travels as a struct, so none of its columns can clash with ours
    whole = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("_hash")
    )
    joined = whole.join(
        covered,
        (F.col("_hash") == F.col("_copy")) & F.col("doc_id").eqNullSafe(F.col("_id")),
        "left",
    )
    removed = F.flatten(
        F.transform("_pos", lambda p: F.transform(F.array(*map(F.lit, range(WINDOW))), lambda k: p + k))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), removed)
    shortened = _with_lines(
        F.col("text"),
        lambda lines: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"),
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    n_removed = F.when(F.col("_pos").isNull(), 0).otherwise(F.size(F.array_distinct(removed)))
    return joined.withColumn("n_lines", n_lines).select(
        "row",
        F.when(F.col("_pos").isNull(), F.col("text")).otherwise(shortened).alias("text"),
        "n_lines",
        n_removed.alias("n_removed"),
    )


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """Text of every document after the removal, with the counts."""
    return without_repeated_lines(docs.select("doc_id", "text")).select(
        "row.doc_id",
        "text",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
    )


def shorten(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their shortened texts and lengths."""
    out = without_repeated_lines(docs)
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(columns["n_chars"])
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


ORACLE = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, p - 1 AS pos, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM lines WHERE len(l) >= 3)
  WHERE length(trim(l[p] || l[p + 1] || l[p + 2], ' ')) > 0
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows
), covered AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM ranked WHERE k > 1
), numbered AS (
  SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM lines
), kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS text, count(*) AS n
  FROM numbered n ANTI JOIN covered c ON n.doc_id = c.doc_id AND n.pos = c.pos
  GROUP BY n.doc_id
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(len(d.l), 0)::BIGINT AS n_lines,
       (coalesce(len(d.l), 0) - CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(k.n, 0) END)::BIGINT
         AS n_removed
FROM lines d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
