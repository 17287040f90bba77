"""Texts to tokens, tokens to positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.sources.corpus import batch_number, with_ordinal

Tokenizer = Callable[[Column], Column]


def whitespace_tokens(text: Column) -> Column:
    """Default tokenizer.  Any ``Column -> array<string>`` can replace it, for
    example a pandas UDF around a subword tokenizer."""
    return F.array_remove(F.split(text, r"\s+"), "")


def tokenize(
    corpus: DataFrame, max_length: int | None, tokenizer: Tokenizer = whitespace_tokens
) -> DataFrame:
    """Adds ``tokens``, cut at ``max_length`` if one is given, and ``n_tokens``;
    drops the text."""
    tokens = tokenizer(F.col("text"))
    if max_length is not None:
        tokens = F.slice(tokens, 1, max_length)
    return (
        corpus.withColumn("tokens", tokens)
        .drop("text")
        .withColumn("n_tokens", F.size("tokens"))
    )


def token_counts(
    corpus: DataFrame, max_length: int | None, tokenizer: Tokenizer = whitespace_tokens
) -> DataFrame:
    """``n_tokens``; the default tokenizer's are counted without building them."""
    if tokenizer is whitespace_tokens:
        count = F.regexp_count("text", F.lit(r"\S+"))
    else:
        count = F.size(tokenizer(F.col("text")))
    if max_length is not None:
        count = F.least(count, F.lit(max_length))
    return corpus.withColumn("n_tokens", count).drop("text")


def valid_lengths(
    corpus: DataFrame, max_length: int | None, tokenizer: Tokenizer = whitespace_tokens
) -> DataFrame:
    """Valid length of every example that has at least one token."""
    return token_counts(corpus, max_length, tokenizer).filter(F.col("n_tokens") > 0)


def valid_length_profile(
    corpus: DataFrame,
    max_length: int | None,
    batch_size: int,
    tokenizer: Tokenizer = whitespace_tokens,
) -> DataFrame:
    """Smallest and largest valid length of every batch."""
    lengths = token_counts(corpus, max_length, tokenizer).select("example_id", "n_tokens")
    return (
        with_ordinal(lengths, "example_id")
        .groupBy(batch_number(F.col("ordinal"), batch_size).alias("batch_no"))
        .agg(F.min("n_tokens").alias("min_tokens"), F.max("n_tokens").alias("max_tokens"))
    )


def position_range() -> Column:
    """0 .. n_tokens - 1, null for an empty sequence.

    A filter on ``n_tokens`` would be pushed to the scan and split every text a
    second time; exploding a null gives no rows as well.
    """
    return F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0), F.col("n_tokens") - 1))


def explode_positions(examples: DataFrame) -> DataFrame:
    """One row per token, position 0 .. n_tokens - 1."""
    return examples.withColumn("position", F.explode(position_range()))


def fit_positions(start: Column, length: Column) -> Column:
    """Start positions extended by steps of one, or cut, to ``length`` entries."""
    last = F.element_at(start, -1)
    missing = length - F.size(start)
    steps = F.sequence(F.lit(1), F.greatest(missing, F.lit(1)))
    padded = F.concat(start, F.transform(steps, lambda i: last + i))
    return F.slice(F.when(missing > 0, padded).otherwise(start), F.lit(1), length)


def offset_positions(
    examples: DataFrame,
    offsets: DataFrame | None = None,
    ordinal: str = "ordinal",
) -> DataFrame:
    """Array of positions per example, from given start positions.

    ``offsets(row_ordinal, start_positions)`` is numbered from 0 without gaps.
    Examples beyond its last row use that row.  They may be most of the corpus,
    so they are not joined on it: the one row is a scalar subquery.
    """
    plain = F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens").cast("bigint") - 1)
    usable = examples.filter(F.col("n_tokens") > 0)
    if offsets is None:
        return usable.withColumn("positions", plain)
    last = offsets.agg(
        F.max_by(F.col("start_positions").cast("array<bigint>"), "row_ordinal").alias("_rest")
    ).scalar()
    start = F.col("_start")
    fitted = F.when(start.isNotNull(), fit_positions(start, F.col("n_tokens"))).otherwise(plain)
    return (
        usable.join(
            offsets.select(
                F.col("row_ordinal").cast("bigint").alias(ordinal),
                F.col("start_positions").cast("array<bigint>").alias("start_positions"),
            ),
            ordinal,
            "left",
        )
        .withColumn("_start", F.coalesce(F.col("start_positions"), last))
        .withColumn("positions", fitted)
        .drop("start_positions", "_start")
    )


def token_at(tokens: Column, position: Column) -> Column:
    """Token text at a position; a token list that is too short is an error."""
    short = F.raise_error(F.concat(F.lit("token list shorter than sequence at "), position))
    return F.when(F.size(tokens) > position, F.get(tokens, position)).otherwise(short)
