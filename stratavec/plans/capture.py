"""The capture as one lazy plan: corpus in, rows of vectors out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.defaults import SLIDING, CaptureSettings
from stratavec.functions.naming import config_name
from stratavec.operators.gather import head_vectors, window_of_layer
from stratavec.operators.heads import filter_layers_heads
from stratavec.operators.runs import bounds_in_row, runs_in_row
from stratavec.operators.sampling import (
    Strategy,
    cap_rows,
    sample_capped_in_row,
    sample_shared,
    sampled_in_row,
    sampler_by_name,
    sequence_groups,
)
from stratavec.operators.tokens import (
    Tokenizer,
    token_at,
    token_counts,
    tokenize,
    whitespace_tokens,
)


class Encoder(Protocol):
    def encode(self, rows: DataFrame) -> DataFrame: ...


class InRowEncoder(Protocol):
    def encode_in_row(self, sampled: DataFrame) -> DataFrame: ...


def strategy_of(settings: CaptureSettings) -> Strategy:
    return sampler_by_name(settings.strategy, settings.base_rate, settings.bucket_size)


def captured_layers(settings: CaptureSettings) -> list[int]:
    """Layers that are captured at all; others are never exploded."""
    layout = settings.layout
    wanted = range(layout.num_layers) if settings.layers is None else sorted(settings.layers)
    invalid = [x for x in wanted if not 0 <= x < layout.num_layers]
    if invalid:
        raise ValueError(f"no layers {invalid}, the model has {layout.num_layers}")
    if settings.full_attention_only:
        wanted = [x for x in wanted if layout.layer_types[x] != SLIDING]
    return list(wanted)


def groups_of(examples: DataFrame, settings: CaptureSettings) -> DataFrame:
    return sequence_groups(examples, captured_layers(settings), settings.kinds)


def sampled_positions(
    corpus: DataFrame, settings: CaptureSettings, tokenizer: Tokenizer = whitespace_tokens
) -> DataFrame:
    """Sampled positions without token texts; only lengths leave the scan."""
    examples = token_counts(corpus.select("example_id", "text"), settings.max_length, tokenizer)
    rows = sample_shared(groups_of(examples, settings), strategy_of(settings), settings.seed)
    return cap_rows(rows, settings.max_rows, settings.seed).drop("n_tokens")


def sampled_tokens(
    corpus: DataFrame,
    settings: CaptureSettings,
    tokenizer: Tokenizer = whitespace_tokens,
    lengths: bool = False,
    in_run: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Sampled positions with token text and window, and ``n_tokens`` if wanted.

    The token is picked in the task that sampled it, so the text is read once
    and is neither joined back nor shuffled.  So is the run of tokens that it lies in,
    ``run_start`` and ``run_end``, if ``in_run`` says which tokens are in runs.
    """
    examples = tokenize(corpus.select("example_id", "text"), settings.max_length, tokenizer)
    if in_run is not None:
        starts, ends = runs_in_row(F.col("_bounds"))
        examples = (
            examples.withColumn("_bounds", bounds_in_row(F.col("tokens"), in_run))
            .withColumns({"_starts": starts, "_ends": ends})
            .drop("_bounds")
        )
    groups, strategy = groups_of(examples, settings), strategy_of(settings)
    # a window cannot run on a stream, so there the cap is applied inside the row
    in_row = bool(settings.max_rows) and corpus.isStreaming
    if in_row:
        rows = sample_capped_in_row(groups, strategy, settings.max_rows, settings.seed)
    else:
        rows = sample_shared(groups, strategy, settings.seed)
    rows = rows.select(
        "example_id",
        "layer",
        "kind",
        "position",
        "bucket",
        token_at(F.col("tokens"), F.col("position")).alias("token_str"),
        window_of_layer(settings.layout).alias("sliding_window"),
        *(["n_tokens"] if lengths else []),
        *([] if in_run is None else [
            F.get("_starts", F.col("position")).alias("run_start"),
            F.get("_ends", F.col("position")).alias("run_end"),
        ]),
    )
    return rows if in_row else cap_rows(rows, settings.max_rows, settings.seed)


def sequences_with_sample(
    corpus: DataFrame, settings: CaptureSettings, tokenizer: Tokenizer = whitespace_tokens
) -> DataFrame:
    """``(example_id, tokens, wanted)``: every sequence with its sample in its row."""
    examples = tokenize(corpus.select("example_id", "text"), settings.max_length, tokenizer)
    return sampled_in_row(
        examples,
        captured_layers(settings),
        settings.kinds,
        strategy_of(settings),
        settings.seed,
        settings.max_rows,
    ).select("example_id", "tokens", "wanted")


def encoded_in_row(
    corpus: DataFrame,
    settings: CaptureSettings,
    encoder: InRowEncoder,
    tokenizer: Tokenizer = whitespace_tokens,
) -> DataFrame:
    """The sample with its vectors, worked out where the sequence is.

    Nothing is grouped, joined or shuffled, so batch and stream have the same plan.
    """
    rows = encoder.encode_in_row(sequences_with_sample(corpus, settings, tokenizer))
    return rows.select(
        "example_id",
        "layer",
        "kind",
        "position",
        strategy_of(settings).bucket(F.col("position")).alias("bucket"),
        "token_str",
        window_of_layer(settings.layout).alias("sliding_window"),
        "flat",
    )


def encoded_sample(
    corpus: DataFrame,
    settings: CaptureSettings,
    encoder: Encoder | InRowEncoder,
    selected: DataFrame | None = None,
    tokenizer: Tokenizer = whitespace_tokens,
    keep: tuple[str, ...] = (),
    in_run: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The sample with its vectors, all heads of a position in one row (see ``capture``)."""
    if hasattr(encoder, "encode_in_row") and encoder.examples is None:
        if in_run is not None:
            raise ValueError("an encoder in the row of the sequence tells no runs")
        return encoded_in_row(corpus, settings, encoder, tokenizer)
    sampled = sampled_tokens(corpus, settings, tokenizer, "n_tokens" in keep, in_run)
    if selected is not None:
        sampled = sampled.join(selected.select("layer", "kind"), ["layer", "kind"], "left_semi")
    return encoder.encode(sampled)


def capture(
    corpus: DataFrame,
    settings: CaptureSettings,
    encoder: Encoder | InRowEncoder,
    selected: DataFrame | None = None,
    tokenizer: Tokenizer = whitespace_tokens,
    before_heads: Callable[[DataFrame], DataFrame] | None = None,
    keep: tuple[str, ...] = (),
    in_run: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Scan, tokenise, sample, encode, split into heads.

    Vectors are joined after sampling, so the join has the size of the sample.
    With ``selected(layer, head, kind)``, layers and kinds without a selected
    head are dropped before they are encoded.  An encoder over sequences that was
    given none of its own takes them from the corpus, row by row.

    ``before_heads`` may add columns to the sampled rows, where they are worked out once
    for all heads.  ``keep`` names columns to carry along, its own or ``n_tokens``, with
    ``in_run`` (see ``sampled_tokens``) also ``run_start`` and ``run_end``.
    """
    encoded = encoded_sample(corpus, settings, encoder, selected, tokenizer, keep, in_run)
    if before_heads is not None:
        encoded = before_heads(encoded)
    rows = head_vectors(encoded, settings.layout, selected)
    rows = filter_layers_heads(rows, settings.layout, None, settings.heads, settings.kinds)
    return rows.select(
        "example_id",
        "layer",
        "head",
        "kind",
        config_name(F.col("layer"), F.col("head"), F.col("kind")).alias("config"),
        "position",
        "bucket",
        "sliding_window",
        "token_str",
        "vector",
        *keep,
    )
