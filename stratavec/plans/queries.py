"""The registered queries: every operator over whole test tables.

Each function takes ``(spark, folder)`` and returns a DataFrame.  Captures use
the settings of ``defaults``; texts are not cut, except in the two queries that
show the cut itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec import defaults as D
from stratavec.functions import buckets, ids, vectors
from stratavec.functions.naming import config_name
from stratavec.operators import (
    attention,
    gather,
    heads,
    query_rows,
    rotary,
    runs,
    sampling,
    sequences,
    statistics,
    tokens,
    vector_store,
)
from stratavec.plans import run, sessions
from stratavec.plans.capture import (
    capture,
    encoded_in_row,
    encoded_sample,
    groups_of,
    sampled_positions,
    sampled_tokens,
    strategy_of,
)
from stratavec.session import scratch_path, spread, stored
from stratavec.sources import catalogue, corpus
from stratavec.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOG_SETTINGS = replace(D.SETTINGS, strategy="log_uniform")
FULL_ONLY = replace(D.SETTINGS, full_attention_only=True)
DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STORE_BUCKETS = 16
RMS_WEIGHTS = [0.5 + i / 16 for i in range(D.LAYOUT.head_dim)]


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return corpus.scan_corpus(spark, f"{folder}/documents.parquet", keep=keep)


def encoder(spark: SparkSession, folder: str) -> gather.LookupEncoder:
    return gather.LookupEncoder.over(table(spark, folder, "embeddings"))


def captured(
    spark: SparkSession, folder: str, settings: D.CaptureSettings = D.SETTINGS
) -> DataFrame:
    return capture(documents(spark, folder), settings, encoder(spark, folder))


def examples(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder), None)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.explode_positions(examples(spark, folder))


def r4(value: Column) -> Column:
    return F.round(value, 4)


def digest(vector: str, dim: int | None = D.LAYOUT.head_dim) -> list[Column]:
    """Three numbers that change if an entry of the vector changes or moves.

    Without ``dim`` the last value is that of a vector of any width.
    """
    item = lambda i: F.element_at(vector, i + 1).cast("double")
    terms = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    weighted = F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)
    return [
        r4(item(0)).alias("first_value"),
        r4(item(-2 if dim is None else dim - 1)).alias("last_value"),
        r4(weighted).alias("weighted_sum"),
    ]


VECTOR_KEY = ("example_id", "layer", "head", "kind", "position")


# --- sources and corpus -------------------------------------------------------


@register
def corpus_scan(spark, folder):
    rows = documents(spark, folder)
    return rows.select(
        "example_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest")
    )


@register
def corpus_take(spark, folder):
    rows = corpus.corpus_take(documents(spark, folder), "example_id", D.MAX_SAMPLES)
    return rows.select("example_id", F.md5("text").alias("digest"))


@register
def source_ordinal(spark, folder):
    """Every text with its place in the source, where there is no id."""
    rows = corpus.scan_in_order(spark, f"{folder}/documents.parquet")
    return rows.select("example_id", F.md5("text").alias("digest"))


@register
def source_take(spark, folder):
    """The first texts as they lie."""
    rows = corpus.scan_in_order(spark, f"{folder}/documents.parquet", limit=D.MAX_SAMPLES)
    return rows.select("example_id", F.md5("text").alias("digest"))


def _labelled(spark, folder):
    return corpus.with_label(documents(spark, folder, "n_chars"))


@register
def long_subset(spark, folder):
    return corpus.label_subset(_labelled(spark, folder), "length", "long").select(
        "example_id", "length", "n_chars"
    )


@register
def project_id_text(spark, folder):
    rows = corpus.label_subset(_labelled(spark, folder), "length", "long")
    return corpus.project_id_text(rows, "example_id", "text")


@register
def subset_counts(spark, folder):
    return corpus.subset_counts(_labelled(spark, folder), F.col("length") == "long")


@register
def ordinal_example_id(spark, folder):
    sizes = documents(spark, folder, "n_chars").select("example_id", "n_chars")
    by_size = sizes.select(F.col("example_id").alias("doc_id"), "n_chars")
    return corpus.with_ordinal(by_size, "n_chars", "doc_id", name="example_id")


def _typed_ids(spark, folder, hashed):
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.col("n_chars").alias("as_long"),
        F.concat(F.lit("id-"), "doc_id").alias("as_string"),
        F.col("doc_id").cast("string").alias("as_digits"),
        (F.col("n_chars") / 4.0).alias("as_double"),
        (F.col("lang") == "en").alias("as_boolean"),
    )
    named = ["as_long", "as_string", "as_digits", "as_double", "as_boolean"]
    return rows.select(
        "doc_id",
        *[
            ids.normalize_example_id(F.col(n), rows.schema[n].dataType, hashed).alias(n)
            for n in named
        ],
    )


@register
def normalize_example_id(spark, folder):
    return _typed_ids(spark, folder, ids.md5_id)


@register
def normalize_example_id_blake2b(spark, folder):
    return _typed_ids(spark, folder, ids.blake2b_id)


@register
def example_id_int32(spark, folder):
    rows = table(spark, folder, "documents")
    hashed = ids.md5_id(F.concat(F.lit("id-"), "doc_id"))
    return rows.select(
        "doc_id", hashed.alias("id64"), ids.wrap_int32(hashed).alias("id32"),
        ids.wrap_int32(-hashed).alias("id32_negative"),
    )


@register
def row_target(spark, folder):
    return corpus.row_target(table(spark, folder, "documents"), D.MAX_SAMPLES)


@register
def batch_profile(spark, folder):
    return corpus.batch_profile(documents(spark, folder), "example_id", "text", D.BATCH_SIZE)


def _stream(spark, folder, places=False):
    # a pattern, which may be one file or a folder of files; the source takes no single file
    path = f"{folder}/documents.parque[t]"
    return corpus.corpus_stream(spark, path, DOCUMENTS_SCHEMA, places=places)


@register
def corpus_stream(spark, folder):
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    rows = _stream(spark, folder).select(
        "example_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest")
    )
    live.run_available(rows, out, state)
    return spark.read.schema(rows.schema).parquet(out)


# --- tokens and positions -------------------------------------------------------


@register
def tokenize_truncate(spark, folder):
    rows = tokens.tokenize(documents(spark, folder), D.SHORT_LENGTH)
    return rows.select(
        "example_id", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("digest")
    )


@register
def valid_lengths(spark, folder):
    return tokens.valid_lengths(documents(spark, folder), D.SHORT_LENGTH)


@register
def valid_length_profile(spark, folder):
    return tokens.valid_length_profile(documents(spark, folder), None, D.BATCH_SIZE)


@register
def explode_positions(spark, folder):
    return positions(spark, folder).groupBy("example_id").agg(
        F.count("*").alias("n_rows"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
        F.sum("position").alias("position_sum"),
    )


@register
def offset_positions(spark, folder):
    starts = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("row_ordinal"),
        F.sequence(
            F.col("item_id") * 10, F.col("item_id") * 10 + F.length("text") % F.lit(700)
        ).cast("array<bigint>").alias("start_positions"),
    )
    numbered = corpus.with_ordinal(examples(spark, folder), "example_id")
    placed = tokens.offset_positions(numbered, starts)
    return placed.select("example_id", F.explode_outer("positions").alias("position")).groupBy(
        "example_id"
    ).agg(
        F.count("*").alias("n_rows"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
        F.sum("position").alias("position_sum"),
    )


@register
def token_strings(spark, folder):
    return sampled_tokens(documents(spark, folder), D.SETTINGS).select(
        "example_id", "layer", "kind", "position", "token_str"
    )


# --- buckets --------------------------------------------------------------------


def _bucket_spans(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.groupBy("example_id", bucket.alias("bucket")).agg(
        F.count("*").alias("n_rows"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    )


@register
def bucket_log(spark, folder):
    bucket = buckets.log_bucket(F.col("position"), D.SETTINGS.bucket_size)
    return _bucket_spans(positions(spark, folder), bucket)


@register
def bucket_uniform(spark, folder):
    bucket = buckets.uniform_bucket(F.col("position"), D.SETTINGS.bucket_size)
    return _bucket_spans(positions(spark, folder), bucket)


@register
def bucket_all(spark, folder):
    strategy = sampling.sampler_by_name("all", bucket_size=D.SETTINGS.bucket_size)
    return _bucket_spans(positions(spark, folder), strategy.bucket(F.col("position")))


@register
def effective_min_bucket(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("requested"))
    return rows.select(
        "doc_id", "requested", buckets.effective_bucket_size(F.col("requested")).alias("effective")
    )


@register
def bucket_widths(spark, folder):
    bucket = buckets.log_bucket(F.col("position"), D.SETTINGS.bucket_size)
    return (
        positions(spark, folder)
        .groupBy(bucket.alias("bucket"))
        .agg(F.count("*").alias("n_positions"))
        .select(
            "bucket",
            buckets.bucket_width(F.col("bucket")).alias("width"),
            buckets.log_keep_probability(F.col("bucket"), 1.0).alias("keep_probability"),
            "n_positions",
        )
    )


# --- sampling -------------------------------------------------------------------


@register
def sample_log_uniform(spark, folder):
    return sampled_positions(documents(spark, folder), LOG_SETTINGS)


@register
def sample_uniform(spark, folder):
    return sampled_positions(documents(spark, folder), D.SETTINGS)


@register
def sample_all(spark, folder):
    rows = sampled_positions(documents(spark, folder), replace(D.SETTINGS, strategy="all"))
    return rows.groupBy("example_id", "layer", "kind", "bucket").agg(
        F.count("*").alias("n_rows"), F.sum("position").alias("position_sum")
    )


@register
def seeded_draw(spark, folder):
    groups = groups_of(examples(spark, folder), D.SETTINGS)
    rows = sampling.seeded_draw(groups, D.SETTINGS.seed, "example_id", "layer", "kind")
    # draws are multiples of 2^-31, so their sum is exact in any order
    return rows.groupBy("example_id", "layer", "kind").agg(
        F.count("*").alias("n_rows"),
        F.min("u").alias("min_u"),
        F.max("u").alias("max_u"),
        F.sum("u").alias("sum_u"),
    )


@register
def sample_shared_mask(spark, folder):
    rows = heads.attach_heads(sampled_positions(documents(spark, folder), D.SETTINGS), D.LAYOUT)
    return rows.select("example_id", "layer", "head", "kind", "position", "bucket")


@register
def sample_per_head(spark, folder):
    groups = heads.attach_heads(groups_of(examples(spark, folder), D.SETTINGS), D.LAYOUT)
    rows = sampling.sample_per_head(groups, strategy_of(D.SETTINGS), D.SETTINGS.seed)
    return rows.select("example_id", "layer", "head", "kind", "position", "bucket")


@register
def cap_rows(spark, folder):
    return sampled_positions(documents(spark, folder), replace(D.SETTINGS, max_rows=D.ROW_CAP))


@register
def sampler_by_name(spark, folder):
    parts = []
    for name in sampling.STRATEGIES:
        rows = sampled_positions(documents(spark, folder), replace(D.SETTINGS, strategy=name))
        parts.append(rows.withColumn("strategy", F.lit(name)))
    return gather.merge_batches(*parts).groupBy("strategy", "example_id", "layer", "kind").agg(
        F.count("*").alias("n_rows"), F.sum("position").alias("position_sum")
    )


@register
def custom_sampler(spark, folder):
    size = D.SETTINGS.bucket_size
    first_of_bucket = lambda position, bucket: position == bucket * F.lit(size)
    groups = groups_of(examples(spark, folder), D.SETTINGS)
    return sampling.sample_where(groups, strategy_of(D.SETTINGS), first_of_bucket).drop("n_tokens")


@register
def custom_sampler_udf(spark, folder):
    size = D.SETTINGS.bucket_size
    groups = groups_of(examples(spark, folder), D.SETTINGS)
    mask = lambda position, bucket: position == bucket * size
    return sampling.sample_with_mask(groups, strategy_of(D.SETTINGS), mask).drop("n_tokens")


# --- heads ----------------------------------------------------------------------


def model_configs(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue of JSON model configs: one model per part, in six shapes."""
    body = (
        '"num_hidden_layers": %d, "num_attention_heads": %d, '
        '"num_key_value_heads": %d, "layer_types": [%s]'
    )
    rows = spread(table(spark, folder, "part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("model"),
        (F.lit(3) + F.col("p_size") % 6).alias("layers"),
        (F.lit(1) + F.col("p_partkey") % 3).alias("k_heads"),
        (F.lit(1) + F.col("p_size") % 4).alias("group"),
        (F.col("p_size") % 5 == 0).cast("int").alias("short_by"),
    )
    types = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.col("layers") - F.col("short_by") - 1),
            lambda i: F.when((i + F.col("model")) % 3 == 0, '"full_attention"').otherwise(
                '"sliding_attention"'
            ),
        ),
        ", ",
    )
    rows = rows.withColumn(
        "body",
        F.format_string(
            body,
            F.col("layers"),
            F.col("k_heads") * F.col("group"),
            F.col("k_heads"),
            types,
        ),
    )
    shape = F.col("model") % 6
    text = lambda before, after: F.concat(F.lit(before), F.col("body"), F.lit(after))
    bare = F.regexp_replace(F.col("body"), F.lit('"num_key_value_heads": \\d+, '), F.lit(""))
    config = (
        F.when(shape == 0, text("{", "}"))
        .when(shape == 1, text('{"num_hidden_layers": 1, "text_config": {', "}}"))
        .when(shape == 2, F.concat(F.lit('{"language_config": {'), bare, F.lit("}}")))
        .when(
            shape == 3,
            text(
                '{"num_hidden_layers": "auto", "num_attention_heads": 8, "llm_config": {', "}}"
            ),
        )
        .when(
            shape == 4,
            text(
                '{"text_config": {"num_hidden_layers": 3, "num_attention_heads": 0, '
                '"decoder_config": {',
                "}}}",
            ),
        )
        .otherwise(
            text(
                '{"num_hidden_layers": 9, "num_attention_heads": 8, '
                '"num_key_value_heads": null, "decoder_config": {',
                "}}",
            )
        )
    )
    return rows.select("model", config.alias("config"))


def _models(spark, folder):
    return heads.head_layout(model_configs(spark, folder)).drop("config")


def _sampled_models(spark, folder):
    candidates = heads.with_candidates(_models(spark, folder), full_attention_only=True)
    return heads.with_sampled_heads(candidates, D.HEAD_SAMPLE, D.SETTINGS.seed)


@register
def head_layout(spark, folder):
    return _models(spark, folder).select(
        "model", "num_layers", "q_heads", "k_heads", F.size("layer_types").alias("n_types")
    )


@register
def sliding_layers(spark, folder):
    return heads.sliding_layers(_models(spark, folder))


@register
def head_candidates(spark, folder):
    rows = heads.with_candidates(_models(spark, folder), full_attention_only=True)
    return heads.explode_heads(rows, "candidates")


@register
def sample_heads(spark, folder):
    return heads.explode_heads(_sampled_models(spark, folder), "selected_q")


@register
def key_heads_for_queries(spark, folder):
    return heads.explode_heads(_sampled_models(spark, folder), "selected_k")


@register
def head_sampling_summary(spark, folder):
    return heads.head_sampling_summary(_sampled_models(spark, folder), D.HEAD_SAMPLE)


def _capture_keys(rows: DataFrame) -> DataFrame:
    return rows.select(*VECTOR_KEY, "bucket")


@register
def filter_layers_heads(spark, folder):
    rows = captured(spark, folder, replace(D.SETTINGS, layers=(1, 2), heads=(1,)))
    return _capture_keys(rows)


def default_selection(spark: SparkSession) -> DataFrame:
    rows = heads.with_candidates(heads.layout_frame(spark, D.LAYOUT))
    return heads.selected_heads(
        heads.with_sampled_heads(rows, D.HEAD_SAMPLE, D.SETTINGS.seed)
    )


@register
def filter_selected_heads(spark, folder):
    rows = captured(spark, folder)
    return _capture_keys(heads.filter_selected_heads(rows, default_selection(spark)))


@register
def filter_full_attention(spark, folder):
    return _capture_keys(heads.filter_full_attention(captured(spark, folder)))


@register
def filter_kind(spark, folder):
    return _capture_keys(heads.filter_kind(captured(spark, folder), queries=False))


# --- vectors --------------------------------------------------------------------


@register
def batch_encode(spark, folder):
    rows = encoder(spark, folder).encode(sampled_tokens(documents(spark, folder), D.SETTINGS))
    return rows.select(
        "example_id", "layer", "kind", "position", "vec_id", F.size("flat").alias("n_values"),
        *digest("flat", None),
    )


class PrefixLengths:
    """A model that needs the sequence: lengths of a token, of the one before it, and of
    all up to it.  A block hands on the length of its last token and its total.

    A block is asked once for every layer and kind; its lengths are worked out once."""

    _last = (None, None, None)

    def digest(self, words):
        return len(words[-1]), sum(map(len, words))

    def merge(self, state, digest):
        return digest[0], digest[1] + (state[1] if state else 0)

    def vectors(self, words, first, state, layer, kind, positions):
        if self._last[0] is not words or self._last[1] != state:
            last, total = state or (0, 0)
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            rows = np.stack([sizes, np.r_[last, sizes[:-1]], total + np.cumsum(sizes)], axis=1)
            self._last = words, state, rows
        return self._last[2][positions - first] * (layer + 1) + (kind == "k")


def prefix_lengths(words, layer, kind, positions):
    """The same of a whole sequence."""
    return PrefixLengths().vectors(words, 0, None, layer, kind, positions)


def _prefix_lengths(rows: DataFrame) -> DataFrame:
    names = ("own_length", "previous_length", "total_length")
    values = [F.get("flat", i).cast("double").alias(n) for i, n in enumerate(names)]
    return rows.select("example_id", "layer", "kind", "position", *values)


@register
def encode_sequences(spark, folder):
    """Sampled rows meet their sequences by block."""
    texts = documents(spark, folder)
    source = sequences.BlockEncoder(PrefixLengths(), tokens.tokenize(texts, None))
    return _prefix_lengths(source.encode(sampled_positions(texts, D.SETTINGS)))


@register
def encode_in_row(spark, folder):
    """The same where the sample stays with its sequence."""
    source = sequences.BlockEncoder(PrefixLengths())
    return _prefix_lengths(encoded_in_row(documents(spark, folder), D.SETTINGS, source))


@register
def split_heads(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("flat"))
    parts = gather.split_heads(rows, D.LAYOUT.q_heads, D.LAYOUT.head_dim)
    return parts.select("vec_id", "head", *digest("vector"))


@register
def gather_vectors(spark, folder):
    source = encoder(spark, folder)
    sampled = gather.with_vector_place(
        sampled_tokens(documents(spark, folder), D.SETTINGS), source.n_vectors, source.width, D.LAYOUT
    )
    by_kind = [
        gather.split_heads(
            gather.flat_vectors(source.vectors, D.LAYOUT, kind), D.LAYOUT.heads(kind), D.LAYOUT.head_dim
        )
        for kind in D.KINDS
    ]
    rows = gather.gather_vectors(
        sampled,
        gather.merge_batches(*by_kind),
        ("vec_id", "slot", "kind"),
        default_selection(spark),
    )
    return rows.select(*VECTOR_KEY, *digest("vector"))


@register
def gather_from_store(spark, folder):
    """The same from a store that is neither shuffled nor read where it is not needed."""
    source = encoder(spark, folder)
    store = vector_store.VectorStore.write(
        source.vectors, scratch_path(spark, "vector-store"), ("vec_id",), STORE_BUCKETS
    )
    sampled = gather.with_vector_place(
        sampled_tokens(documents(spark, folder), D.SETTINGS), source.n_vectors, source.width, D.LAYOUT
    )
    chosen = default_selection(spark)
    active = sampled.join(chosen.select("layer", "kind").distinct(), ["layer", "kind"], "left_semi")
    # texts are read once, for a sample of numbers
    active = stored(active.select("example_id", "layer", "kind", "position", "vec_id", "slot"), "sample")
    found = store.gather(active).withColumn(
        "flat", gather.place_in_row(F.col("embedding"), source.width, D.LAYOUT)
    )
    return gather.head_vectors(found, D.LAYOUT, chosen).select(*VECTOR_KEY, *digest("vector"))


@register
def vectors_float32(spark, folder):
    rows = table(spark, folder, "embeddings")
    wide = F.transform("embedding", lambda x: x.cast("double") / F.lit(3.0))
    return rows.select("vec_id", vectors.to_float32(wide).alias("vector")).select(
        "vec_id", F.explode(F.col("vector").cast("array<double>")).alias("value")
    ).groupBy("vec_id").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.count("value").alias("n_values"),
    )


def layer_table(spark: SparkSession, layout: D.Layout = D.LAYOUT) -> DataFrame:
    """One row per layer: window, rotary base, and whether it rotates at all."""
    rows = [
        (
            i,
            layout.window(i),
            D.SLIDING_ROPE_THETA if layout.window(i) else D.ROPE_THETA,
            i != layout.num_layers - 1,
        )
        for i in range(layout.num_layers)
    ]
    return spark.createDataFrame(
        rows, "layer int, sliding_window int, rope_theta double, use_rope boolean"
    )


@register
def sliding_window_tag(spark, folder):
    rows = sampled_positions(documents(spark, folder), D.SETTINGS)
    return gather.tag_sliding_window(rows, layer_table(spark))


@register
def config_names(spark, folder):
    rows = heads.attach_heads(sampled_positions(documents(spark, folder), D.SETTINGS), D.LAYOUT)
    name = config_name(F.col("layer"), F.col("head"), F.col("kind"))
    return rows.groupBy(name.alias("config")).agg(F.count("*").alias("n_rows"))


QUERIES["config_name"] = QUERIES.pop("config_names")


@register
def merge_batches(spark, folder):
    uniform = sampled_positions(documents(spark, folder), D.SETTINGS)
    log = sampled_positions(documents(spark, folder), LOG_SETTINGS)
    return gather.merge_batches(uniform, log, uniform).groupBy(
        "example_id", "layer", "kind"
    ).agg(F.count("*").alias("n_rows"), F.sum("position").alias("position_sum"))


def _transformed(spark, folder, vector: Callable[[Column, Column], Column]) -> DataFrame:
    rows = captured(spark, folder)
    out = vector(F.col("vector"), F.col("position")).alias("out")
    return rows.select(*VECTOR_KEY, out).select(*VECTOR_KEY, *digest("out"))


def _rotated(
    spark, folder, layers: DataFrame, rotary_dim: int | None = None
) -> DataFrame:
    """The capture after the rotary step; turns are worked out before heads are split."""
    rows = capture(
        documents(spark, folder),
        D.SETTINGS,
        encoder(spark, folder),
        before_heads=lambda rows: rotary.with_turns(rows, layers, D.LAYOUT, rotary_dim),
        keep=("turns",),
    )
    return rotary.rotate_turned(rows, D.LAYOUT, rotary_dim)


def _one_base(spark) -> DataFrame:
    """The same base for all layers."""
    return layer_table(spark).select(
        "layer", F.lit(D.ROPE_THETA).alias("rope_theta"), F.lit(True).alias("use_rope")
    )


@register
def rotate_half_split(spark, folder):
    return _rotated(spark, folder, _one_base(spark)).select(*VECTOR_KEY, *digest("vector"))


@register
def rotate_interleaved_partial(spark, folder):
    rows = _rotated(spark, folder, _one_base(spark), D.LAYOUT.head_dim // 2)
    return rows.select(*VECTOR_KEY, *digest("vector"))


@register
def rotate_by_layer_type(spark, folder):
    return _rotated(spark, folder, layer_table(spark)).select(*VECTOR_KEY, *digest("vector"))


@register
def query_position_scale(spark, folder):
    """After rotation with one base for all layers; queries only are returned."""
    rows = heads.filter_kind(_rotated(spark, folder, _one_base(spark)), keys=False)
    scaled = rotary.scale_queries(rows, D.QUERY_SCALE_BETA, D.QUERY_SCALE_LENGTH)
    return scaled.select(*VECTOR_KEY, *digest("vector"))


@register
def head_rms_norm(spark, folder):
    return _transformed(
        spark, folder, lambda v, p: vectors.rms_norm(v, RMS_WEIGHTS, D.RMS_EPS)
    )


@register
def head_rms_norm_one_plus(spark, folder):
    return _transformed(
        spark, folder, lambda v, p: vectors.rms_norm(v, RMS_WEIGHTS, D.RMS_EPS, True)
    )


# --- attention ------------------------------------------------------------------


def _sides(spark, folder, in_run: Callable[[Column], Column] | None = None):
    # keys know the length of their sequence, and with it the tiles they are sent to
    run_of = () if in_run is None else ("run_start", "run_end")
    rows = capture(
        documents(spark, folder),
        D.SETTINGS,
        encoder(spark, folder),
        keep=("n_tokens", *run_of),
        in_run=in_run,
    )
    return attention.query_side(rows, D.LAYOUT), attention.key_side(rows)


def _heads_together(spark, folder):
    """Queries and keys with all heads in a row, and the length of their sequence."""
    return encoded_sample(
        documents(spark, folder), D.SETTINGS, encoder(spark, folder), keep=("n_tokens",)
    )


def _rounded_rows(rows: DataFrame, *figures: str) -> DataFrame:
    return rows.select(*attention.QUERY_ROW, "n_keys", *[r4(F.col(c)).alias(c) for c in figures])


LOGIT_FIGURES = ("max_logit", "min_logit", "sum_logit")


def _logit_rows(pairs: DataFrame) -> DataFrame:
    return _rounded_rows(attention.logit_rows(pairs), *LOGIT_FIGURES)


@register
def attention_logits(spark, folder):
    rows = query_rows.query_figures(_heads_together(spark, folder), D.LAYOUT)
    return _rounded_rows(rows, *LOGIT_FIGURES)


@register
def causal_pairs(spark, folder):
    return attention.visible_rows(attention.causal_pairs(*_sides(spark, folder), D.LAYOUT))


def _window_pairs(spark, folder, bidirectional):
    queries, keys = _sides(spark, folder)
    sliding = [i for i in range(D.LAYOUT.num_layers) if D.LAYOUT.window(i)]
    near = F.col("layer").isin(sliding)
    pairs = attention.window_pairs(
        queries.filter(near), keys.filter(near), D.LAYOUT, D.LAYOUT.sliding_window, bidirectional
    )
    return pairs.select(
        *attention.QUERY_ROW, "key_head", "k_position", r4(F.col("logit")).alias("logit")
    )


@register
def sliding_window_pairs(spark, folder):
    return _window_pairs(spark, folder, False)


@register
def sliding_window_pairs_bidirectional(spark, folder):
    return _window_pairs(spark, folder, True)


def _run_sides(spark, folder):
    """Sides that know their run of tokens without a full stop."""
    return _sides(spark, folder, lambda token: ~token.contains("."))


@register
def run_visible_pairs(spark, folder):
    """Causal pairs, and pairs of one run both ways."""
    return _logit_rows(attention.causal_pairs(*_run_sides(spark, folder), D.LAYOUT))


@register
def run_visible_window_pairs(spark, folder):
    """Pairs of one window, and pairs of one run both ways."""
    pairs = attention.window_pairs(
        *_run_sides(spark, folder), D.LAYOUT, D.LAYOUT.sliding_window
    )
    return _logit_rows(pairs)


@register
def attention_softmax(spark, folder):
    rows = query_rows.softmax_rows(_heads_together(spark, folder), D.LAYOUT)
    return _rounded_rows(rows, "max_weight", "log_sum_exp", "entropy")


@register
def logit_softcap(spark, folder):
    rows = query_rows.query_figures(_heads_together(spark, folder), D.LAYOUT, D.SOFTCAP)
    return _rounded_rows(rows, *LOGIT_FIGURES)


@register
def run_groups(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return runs.run_groups(rows, "conv_id", "turn", F.col("role") == "user")


@register
def run_group_spans(spark, folder):
    return runs.run_spans(run_groups(spark, folder), "conv_id", "turn")


# --- catalogue ------------------------------------------------------------------


def _stored_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "config", "example_id", "position", "bucket", "sliding_window", "token_str",
        *digest("vector"),
    )


def _stored_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "config").agg(
        F.count("*").alias("n_rows"),
        F.sum("position").alias("position_sum"),
        F.count("sliding_window").alias("n_windows"),
        F.count("token_str").alias("n_tokens"),
    )


def _written(spark, folder, settings=D.SETTINGS):
    path = scratch_path(spark, "capture")
    catalogue.write_capture(captured(spark, folder, settings), path)
    return path


@register
def write_capture(spark, folder):
    return _stored_rows(catalogue.read_capture(spark, _written(spark, folder)))


def _published(spark, folder):
    """Root of a branch ``b`` that holds a capture."""
    root = scratch_path(spark, "published")
    catalogue.publish_branch(captured(spark, folder), root, "b")
    return root


def _branch(spark, root):
    return catalogue.read_capture(spark, catalogue.branch_path(root, "b"))


@register
def overwrite_configs(spark, folder):
    root = _published(spark, folder)
    later = captured(spark, folder, replace(LOG_SETTINGS, layers=(0, 1)))
    catalogue.replace_branch_configs(later, root, "b")
    return _stored_counts(_branch(spark, root))


@register
def append_rows(spark, folder):
    root = _published(spark, folder)
    catalogue.append_to_branch(captured(spark, folder, LOG_SETTINGS), root, "b")
    catalogue.append_to_branch(captured(spark, folder, LOG_SETTINGS), root, "b")
    return _stored_counts(_branch(spark, root))


@register
def token_column_policy(spark, folder):
    first = captured(spark, folder)
    later = captured(spark, folder, LOG_SETTINGS).drop("token_str")
    return _stored_counts(catalogue.union_with_tokens(first, later))


@register
def one_model_guard(spark, folder):
    rows = table(spark, folder, "documents")
    stored = rows.select(F.col("source").alias("branch"), F.lit("model-a").alias("model_name"))
    name = F.when(F.col("lang") == "en", "model-a").otherwise(F.concat(F.lit("model-"), "lang"))
    incoming = rows.select(F.col("source").alias("branch"), name.alias("model_name"))
    return statistics.model_violations(stored, incoming)


@register
def bucket_counts(spark, folder):
    rows = heads.attach_heads(sampled_positions(documents(spark, folder), D.SETTINGS), D.LAYOUT)
    return statistics.bucket_counts(rows)


@register
def bucket_counts_ledger(spark, folder):
    sessions = [
        statistics.bucket_counts(
            heads.attach_heads(sampled_positions(documents(spark, folder), s), D.LAYOUT)
        )
        for s in (D.SETTINGS, LOG_SETTINGS, LOG_SETTINGS)
    ]
    ledger = None
    for session in sessions:
        ledger = statistics.add_to_ledger(ledger, session)
    return ledger


@register
def list_configs(spark, folder):
    root = _published(spark, folder)
    return catalogue.stored_configs(spark, catalogue.branch_path(root, "b"))


def _branches(spark, folder):
    root = scratch_path(spark, "branches")
    catalogue.publish_branch(captured(spark, folder), root, "uniform")
    catalogue.publish_branch(captured(spark, folder, LOG_SETTINGS), root, "log")
    return root


def _runs(spark, folder):
    root = scratch_path(spark, "run")
    for branch, settings in (("uniform", D.SETTINGS), ("log", LOG_SETTINGS)):
        run.run_capture(
            documents(spark, folder),
            settings,
            encoder(spark, folder),
            root=root,
            branch=branch,
            model_name="model-a",
            metadata={"dataset_split": "all", "distributed_world_size": 2.0},
        )
    return root


@register
def dataset_card_stats(spark, folder):
    root = _runs(spark, folder)
    return statistics.dataset_card(
        catalogue.read_branches(spark, root), run.read_manifest(spark, root)
    )


def run_settings(spark: SparkSession, folder: str) -> DataFrame:
    """One run per document, with its metadata as a map."""
    rows = table(spark, folder, "documents")
    return rows.select(
        F.col("doc_id").alias("run_id"),
        F.create_map(
            F.lit("source_dataset"), F.col("source"),
            F.lit("dataset_split"), F.col("lang"),
            F.lit("sampling_strategy"), F.lit("uniform"),
            F.lit("sampling_bucket_size"), F.lit("64"),
            F.lit("text_chars"), F.col("n_chars").cast("string"),
            F.lit("dataset_branch"), F.concat("lang", F.lit("-"), "source"),
            F.lit("avg_quarter"), (F.col("n_chars") / 4.0).cast("string"),
        ).alias("metadata"),
    )


@register
def extra_metadata(spark, folder):
    return statistics.extra_metadata(run_settings(spark, folder), "run_id")


@register
def run_metadata(spark, folder):
    rows = table(spark, folder, "documents")
    size = F.when(F.col("lang") == "en", "32")
    entries = F.array(
        F.struct(F.lit("source_dataset").alias("key"), F.col("source").alias("value")),
        F.struct(F.lit("dataset_split").alias("key"), F.col("lang").alias("value")),
        F.struct(F.lit("sampling_bucket_size").alias("key"), size.alias("value")),
    )
    explicit = rows.select(F.col("doc_id").alias("run_id"), F.explode(entries).alias("e")).select(
        "run_id", "e.key", "e.value"
    ).filter(F.col("value").isNotNull())
    defaults = statistics.sampler_metadata(D.SETTINGS.strategy, D.SETTINGS.bucket_size)
    return statistics.run_metadata(explicit, defaults, "run_id")


@register
def read_config(spark, folder):
    root = _branches(spark, folder)
    return _stored_rows(catalogue.read_config(spark, root, "uniform", "l01h02q"))


@register
def read_config_prefix(spark, folder):
    root = _branches(spark, folder)
    return _stored_rows(catalogue.read_config_prefix(spark, root, "log", "l00h00"))


@register
def publish_branch(spark, folder):
    root = _branches(spark, folder)
    catalogue.publish_branch(captured(spark, folder, FULL_ONLY), root, "uniform")
    return _stored_counts(catalogue.read_branches(spark, root), "branch")


@register
def reset_root(spark, folder):
    root = _published(spark, folder)
    catalogue.publish_branch(captured(spark, folder, FULL_ONLY), root, "b")
    return _stored_counts(_branch(spark, root))


@register
def capture_counters(spark, folder):
    return statistics.capture_counters(captured(spark, folder))


@register
def capture_run(spark, folder):
    manifest = run.read_manifest(spark, _runs(spark, folder))
    return manifest.filter("bucket is not null").select(
        "branch",
        "model_name",
        F.col("metadata")["sampling_strategy"].alias("sampling_strategy"),
        "bucket",
        "n_rows",
    )


@register
def capture_run_sampled(spark, folder):
    """A run that prepares its ids and draws its heads by itself, with its record."""
    root = scratch_path(spark, "run-sampled")
    run.run_capture(
        run.run_corpus(table(spark, folder, "documents"), "doc_id"),
        D.SETTINGS,
        encoder(spark, folder),
        root=root,
        branch="sampled",
        model_name="model-a",
        head_sampling=run.HeadSampling(D.HEAD_SAMPLE, D.SETTINGS.seed),
    )
    manifest = run.read_manifest(spark, root).filter("bucket is not null")
    entry = lambda name: F.col("metadata")[f"head_sampling_{name}"].alias(name)
    names = (
        "strategy", "seed", "requested_query_heads", "selected_query_heads",
        "selected_key_heads", "num_layers", "num_query_heads", "num_key_heads",
        "full_attention_only", "sliding_layer_count", "full_layer_count",
        "sliding_candidates_excluded",
    )
    return manifest.select("bucket", "n_rows", *map(entry, names))


def _sessions(spark, folder):
    """A branch of three sessions: everything, two layers replaced, rows added."""
    root = scratch_path(spark, "sessions")
    steps = (
        (D.SETTINGS, sessions.REPLACE_ALL),
        (replace(LOG_SETTINGS, layers=(0, 1)), sessions.REPLACE_CONFIGS),
        (LOG_SETTINGS, sessions.APPEND),
    )
    for settings, mode in steps:
        sessions.add_session(
            captured(spark, folder, settings),
            root=root,
            branch="b",
            model_name="model-a",
            mode=mode,
        )
    return root


@register
def session_rows(spark, folder):
    rows = catalogue.read_branches(spark, _sessions(spark, folder))
    return _stored_counts(rows)


@register
def session_counts(spark, folder):
    """Per bucket: rows stored now, and rows written over all sessions."""
    root = _sessions(spark, folder)
    stored = sessions.read_manifest(spark, root).filter("bucket is not null")
    written = sessions.ledger_counts(spark, root, "b").withColumnRenamed("n_rows", "n_written")
    return written.join(stored.select("bucket", "n_rows"), "bucket", "left").select(
        "bucket", F.coalesce("n_rows", F.lit(0)).alias("n_stored"), "n_written"
    )


# --- streaming ------------------------------------------------------------------


@register
def corpus_stream_take(spark, folder):
    """The first rows of a stream, as they lie in its file."""
    path, state = scratch_path(spark, "taken"), scratch_path(spark, "taken-state")
    live.run_taken(_stream(spark, folder, places=True), D.MAX_SAMPLES, path, state)
    got = spark.read.schema("example_id bigint, text string").parquet(path)
    return got.select("example_id", F.md5("text").alias("digest"))


@register
def stream_session(spark, folder):
    root, state = scratch_path(spark, "live-run"), scratch_path(spark, "live-run-state")
    sessions.add_stream_session(
        capture(_stream(spark, folder), D.SETTINGS, encoder(spark, folder)),
        root=root,
        branch="live",
        model_name="model-a",
        checkpoint=state,
    )
    manifest = sessions.read_manifest(spark, root).filter("bucket is not null")
    return manifest.select("branch", "model_name", "bucket", "n_rows")


@register
def stream_capture(spark, folder):
    path, state = scratch_path(spark, "live"), scratch_path(spark, "live-state")
    rows = capture(_stream(spark, folder), D.SETTINGS, encoder(spark, folder))
    live.stream_capture(rows, path, state)
    return _stored_rows(catalogue.read_capture(spark, path))


@register
def stream_sequences(spark, folder):
    """A model that sees whole sequences, on a stream."""
    path, state = scratch_path(spark, "live-vectors"), scratch_path(spark, "live-vectors-state")
    source = sequences.SequenceEncoder(prefix_lengths)
    rows = _prefix_lengths(encoded_in_row(_stream(spark, folder), D.SETTINGS, source))
    live.run_available(rows, path, state)
    return spark.read.schema(rows.schema).parquet(path)


@register
def stream_bucket_counts(spark, folder):
    path, state = scratch_path(spark, "live-counts"), scratch_path(spark, "live-counts-state")
    rows = heads.attach_heads(sampled_tokens(_stream(spark, folder), D.SETTINGS), D.LAYOUT)
    live.stream_bucket_counts(rows, path, state)
    return spark.read.schema("bucket int, n_rows bigint").parquet(path)
