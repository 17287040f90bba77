"""Preference formatting: one shared prompt, two completions with loss masks.

The turns that a chosen and a rejected conversation have in common from the start
are rendered once, as the prompt; what follows in each is its completion.  Masks
are half-open spans of characters of a completion: the text of its assistant
turns with their end marks.  DataFrame functions only; a conversation is one row
after one shuffle, and each pair is one join row.

Defined cases: turns are ordered by number, then role, then text, so repeated
rows are repeated turns; null numbers come first; a null role or text renders as
empty, and null turns are equal to each other; a conversation whose partner is
missing forms no example; rows without a conversation id take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, ROLE_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def gathered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order."""
    turn = F.struct("turn", "role", "text")
    return (
        conversations.filter(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn), _order).alias("turns"))
    )


def _order(a: Column, b: Column) -> Column:
    """By number, role and text, nulls first."""
    out = F.lit(0)
    for field in ("text", "role", "turn"):
        x, y = a[field], b[field]
        out = (
            F.when(x.eqNullSafe(y), out)
            .when(x.isNull(), -1)
            .when(y.isNull(), 1)
            .when(x < y, -1)
            .otherwise(1)
        )
    return out


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations: 2n is the chosen one, 2n + 1 the rejected one."""
    rows = gathered(conversations).withColumn("pair_id", F.floor(F.col("conv_id") / 2))
    side = lambda rest, name: rows.filter(F.pmod(F.col("conv_id"), F.lit(2)) == rest).select(
        "pair_id", F.col("turns").alias(name)
    )
    return side(0, "chosen").join(side(1, "rejected"), "pair_id")


def _rendered(turn: Column) -> Column:
    empty = lambda field: F.coalesce(turn[field], F.lit(""))
    return F.concat(
        F.lit(TURN_START), empty("role"), F.lit(ROLE_END), empty("text"), F.lit(TURN_END)
    )


def _common(a: Column, b: Column) -> Column:
    """Number of turns that are equal from the start."""
    shared = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(
        F.slice(a, F.lit(1), shared),
        F.slice(b, F.lit(1), shared),
        lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]),
    )
    first = F.array_position(pairs, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(shared)


def _spans(turns: Column) -> Column:
    """Trained spans of the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast(_SPANS).alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        size = F.length(_rendered(turn))
        head = F.lit(len(TURN_START) + len(ROLE_END)) + F.length(
            F.coalesce(turn["role"], F.lit(""))
        )
        span = F.struct((state["at"] + head).alias("start"), (state["at"] + size).alias("end"))
        spans = F.when(
            turn["role"] == TRAINED_ROLE, F.concat(state["spans"], F.array(span))
        ).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda state: state["spans"])


_SPANS = "array<struct<start:int,end:int>>"


def preference_examples(pairs: DataFrame) -> DataFrame:
    """Rendered examples of ``pairs(pair_id, chosen, rejected)``."""
    rows = pairs.withColumn("n_common", _common(F.col("chosen"), F.col("rejected")))
    text = lambda turns: F.array_join(F.transform(turns, _rendered), "")
    rest = lambda side: F.filter(side, lambda t, i: i >= F.col("n_common"))
    head = F.slice("chosen", F.lit(1), F.col("n_common"))
    rows = rows.withColumn("_c", rest("chosen")).withColumn("_r", rest("rejected"))
    return rows.select(
        "pair_id",
        "n_common",
        text(head).alias("prompt"),
        text(F.col("_c")).alias("chosen"),
        _spans(F.col("_c")).alias("chosen_mask"),
        text(F.col("_r")).alias("rejected"),
        _spans(F.col("_r")).alias("rejected_mask"),
    )


def preference_rows(conversations: DataFrame) -> DataFrame:
    """The examples of all neighbouring conversations, masks as ``start-end`` lists."""
    shown = lambda mask: F.array_join(
        F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
    rows = preference_examples(neighbours(conversations))
    return rows.withColumn("chosen_mask", shown("chosen_mask")).withColumn(
        "rejected_mask", shown("rejected_mask")
    )


ORACLE = """
WITH turns AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>'
           || chr(10) AS shown
  FROM conversations WHERE conv_id IS NOT NULL
), paired AS (
  SELECT pair_id FROM turns GROUP BY pair_id HAVING count(DISTINCT side) = 2
), matched AS (
  SELECT a.pair_id, a.k, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text
           AS same
  FROM turns a JOIN turns b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side = 0 AND b.side = 1
), common AS (
  SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS n
  FROM matched GROUP BY pair_id
), rest AS (
  SELECT t.*, sum(length(shown)) OVER (PARTITION BY t.pair_id, side ORDER BY k) AS until
  FROM turns t JOIN common c ON t.pair_id = c.pair_id WHERE t.k > c.n
), sides AS (
  SELECT pair_id, side, string_agg(shown, '' ORDER BY k) AS text,
         string_agg((until - length(shown) + 13 + length(role))::BIGINT || '-' || until::BIGINT, ','
           ORDER BY k) FILTER (role = 'assistant') AS mask
  FROM rest GROUP BY pair_id, side
), prompts AS (
  SELECT t.pair_id, string_agg(shown, '' ORDER BY k) AS prompt
  FROM turns t JOIN common c ON t.pair_id = c.pair_id WHERE side = 0 AND k <= n GROUP BY t.pair_id
)
SELECT b.pair_id, c.n::INTEGER AS n_common, coalesce(p.prompt, '') AS prompt,
       coalesce(x.text, '') AS chosen, coalesce(x.mask, '') AS chosen_mask,
       coalesce(y.text, '') AS rejected, coalesce(y.mask, '') AS rejected_mask
FROM paired b JOIN common c USING (pair_id)
LEFT JOIN prompts p USING (pair_id)
LEFT JOIN sides x ON x.pair_id = b.pair_id AND x.side = 0
LEFT JOIN sides y ON y.pair_id = b.pair_id AND y.side = 1
"""
