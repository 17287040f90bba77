"""One capture run from corpus to published branch, with its manifest."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.defaults import CaptureSettings, Layout
from stratavec.functions.ids import normalize_example_id
from stratavec.operators import heads
from stratavec.operators.statistics import sampler_metadata
from stratavec.operators.tokens import Tokenizer, whitespace_tokens
from stratavec.plans.capture import Encoder, capture
from stratavec.plans.sessions import REPLACE_ALL, add_session, read_manifest
from stratavec.sources.corpus import corpus_take, with_ordinal

__all__ = [
    "HeadSampling", "layout_of_config", "read_manifest", "run_capture", "run_corpus", "run_metadata"
]


@dataclass(frozen=True)
class HeadSampling:
    """How many query heads to draw; their key heads come with them."""

    count: int
    seed: int = 0


def run_corpus(
    source: DataFrame,
    id_col: str = "example_id",
    text_col: str = "text",
    max_samples: int | None = None,
    ordinals: bool = False,
) -> DataFrame:
    """``(example_id, text)`` of a run, from an id column of any type.

    Ids become 64-bit integers; with ``ordinals`` the place in the order of
    ``id_col``, which must be unique, is used instead.  ``max_samples`` keeps the
    first rows in that order.
    """
    rows = source.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    if max_samples is not None:
        rows = corpus_take(rows, "_id", max_samples)
    if ordinals:
        numbers = with_ordinal(rows.select("_id"), "_id", name="example_id")
        return rows.join(numbers, "_id").select("example_id", "text")
    example_id = normalize_example_id(F.col("_id"), rows.schema["_id"].dataType)
    return rows.select(example_id.alias("example_id"), "text")


def layout_of_config(
    spark: SparkSession, config: str, head_dim: int, sliding_window: int
) -> Layout:
    """Layout of one model from its JSON config."""
    one = spark.range(1).select(F.lit(config).alias("config"))
    row = heads.head_layout(one).first()
    types = tuple(row["layer_types"])[: row["num_layers"]]
    full = ("full_attention",) * row["num_layers"]
    return Layout(row["q_heads"], row["k_heads"], head_dim, types or full, sliding_window)


def run_metadata(settings: CaptureSettings, explicit: Mapping[str, object]) -> dict[str, str]:
    """Metadata of a run: what the caller gives wins over what the sampler adds."""
    scope = "full_only" if settings.full_attention_only else "all_attention"
    base = {"attention_scope": scope, **sampler_metadata(settings.strategy, settings.bucket_size)}
    return {**base, **{k: str(v) for k, v in explicit.items()}}


def sampled_selection(
    spark: SparkSession, settings: CaptureSettings, sampling: HeadSampling
) -> tuple[DataFrame, dict[str, object]]:
    """Selected heads of the run's model, and the metadata that tells of them."""
    model = heads.with_candidates(
        heads.layout_frame(spark, settings.layout),
        settings.layers,
        settings.heads,
        settings.full_attention_only,
    )
    chosen = heads.with_sampled_heads(model, sampling.count, sampling.seed)
    figures = heads.head_sampling_summary(chosen, sampling.count).first()
    # fixed values: metadata keys of the head sampling
    metadata = {
        "head_sampling_strategy": "random_query",
        "head_sampling_seed": sampling.seed,
        "head_sampling_requested_query_heads": figures["requested_q"],
        "head_sampling_selected_query_heads": figures["selected_q"],
        "head_sampling_selected_key_heads": figures["selected_k"],
        "head_sampling_num_layers": figures["num_layers"],
        "head_sampling_num_query_heads": figures["q_heads"],
        "head_sampling_num_key_heads": figures["k_heads"],
        "head_sampling_full_attention_only": int(settings.full_attention_only),
        "head_sampling_sliding_layer_count": figures["sliding_layers"],
        "head_sampling_full_layer_count": figures["full_layers"],
        "head_sampling_sliding_candidates_excluded": figures["excluded_sliding"],
    }
    return heads.selected_heads(chosen), metadata


def run_capture(
    corpus: DataFrame,
    settings: CaptureSettings,
    encoder: Encoder,
    *,
    root: str,
    branch: str,
    model_name: str,
    metadata: Mapping[str, object] | None = None,
    selected: DataFrame | None = None,
    head_sampling: HeadSampling | None = None,
    rotary: Callable[[DataFrame], DataFrame] | None = None,
    tokenizer: Tokenizer = whitespace_tokens,
    mode: str = REPLACE_ALL,
) -> None:
    """Capture a corpus and publish it on one branch.

    By default the run replaces the branch; other modes add to it or replace the
    configs it captures.  A branch holds one model: a run of another model under
    the same name is refused before anything is written.  Heads are given, or
    drawn by ``head_sampling``.  Without ``rotary`` the vectors are those before
    the rotary step; with it they are turned as it says, for example by
    ``rotate_capture``.
    """
    spark = corpus.sparkSession
    drawn: dict[str, object] = {}
    if head_sampling is not None:
        if selected is not None:
            raise ValueError("heads are either given or sampled")
        selected, drawn = sampled_selection(spark, settings, head_sampling)
        # explicit heads were the candidates; key heads follow from the choice
        settings = CaptureSettings(**{**settings.__dict__, "heads": None})
    rows = capture(corpus, settings, encoder, selected, tokenizer)
    if rotary is not None:
        rows = rotary(rows)
    add_session(
        rows,
        root=root,
        branch=branch,
        model_name=model_name,
        mode=mode,
        metadata=run_metadata(settings, {**drawn, **(metadata or {})}),
    )
