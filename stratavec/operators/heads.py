"""Head selection for a table of models, one row per model.

Layers times heads of a model is a small, bounded number, so candidates, the
seeded choice and the key heads are arrays inside the model's row: a catalogue
of any size is processed without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.defaults import SLIDING, Layout

# fixed values: fields that may hold the language part of a model config
NESTED_FIELDS = ("text_config", "language_config", "llm_config", "decoder_config")
_ENTRIES = "map<string,string>"


def _nested(level: Column) -> Column:
    """Configs nested directly in those of ``level``, in the same order."""
    fields = F.array(*[F.lit(f) for f in NESTED_FIELDS])
    inner = F.flatten(
        F.transform(
            level, lambda c: F.transform(fields, lambda f: F.from_json(F.element_at(c, f), _ENTRIES))
        )
    )
    return F.filter(inner, lambda c: c.isNotNull())


def _layout_of(entries: Column) -> Column:
    """(layers, q heads, k heads) of one candidate, or null if it does not qualify."""
    def number(field: str) -> Column:
        value = F.element_at(entries, F.lit(field)).try_cast("double")
        return F.when(value.between(-(2.0**31), 2.0**31 - 1), value.try_cast("int"))

    layers, q_heads = number("num_hidden_layers"), number("num_attention_heads")
    k_heads = F.when(
        F.map_contains_key(entries, F.lit("num_key_value_heads")), number("num_key_value_heads")
    ).otherwise(q_heads)
    return F.when(
        (layers > 0) & (q_heads > 0) & (k_heads > 0),
        F.struct(
            layers.alias("num_layers"), q_heads.alias("q_heads"), k_heads.alias("k_heads")
        ),
    )


def _first_known(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), 0)


def nesting_depth(models: DataFrame, config: str = "config") -> int:
    """No config is nested deeper than this: each level names one of the fields."""
    names = "|".join(NESTED_FIELDS)
    count = F.regexp_count(config, F.lit(f'"({names})"'))
    return models.agg(F.max(count)).first()[0] or 0


def head_layout(
    models: DataFrame, config: str = "config", depth: int | None = None
) -> DataFrame:
    """Adds ``num_layers``, ``q_heads``, ``k_heads`` and ``layer_types`` from a
    JSON model config.

    The config and its nested parts are tried breadth first.  The first one with
    usable layers and query heads wins as a whole; layer types come from the
    first whose list is long enough.  A config without layout, or with heads
    that do not divide, is an error.  Without ``depth`` the configs are searched
    to their end, which takes one aggregate over them first.
    """
    depth = nesting_depth(models, config) if depth is None else depth
    rows = models.withColumn("_level", F.array(F.from_json(config, _ENTRIES)))
    rows = rows.withColumn("_all", F.col("_level"))
    for _ in range(depth):
        rows = rows.withColumn("_level", _nested(F.col("_level")))
        rows = rows.withColumn("_all", F.concat("_all", "_level"))
    rows = rows.withColumn("_l", _first_known(F.transform("_all", _layout_of)))
    layers = F.col("_l.num_layers")

    def types_of(entries: Column) -> Column:
        types = F.from_json(F.element_at(entries, F.lit("layer_types")), "array<string>")
        return F.when(F.size(types) >= layers, types)

    types = F.coalesce(
        _first_known(F.transform("_all", types_of)), F.array().cast("array<string>")
    )
    checked = (
        F.when(F.col("_l").isNull(), F.raise_error(F.lit("no attention head layout in config")))
        .when(
            F.col("_l.q_heads") % F.col("_l.k_heads") != 0,
            F.raise_error(F.lit("q heads are not a multiple of k heads")),
        )
        .otherwise(layers)
    )
    return rows.select(
        *models.columns,
        checked.cast("int").alias("num_layers"),
        F.col("_l.q_heads").alias("q_heads"),
        F.col("_l.k_heads").alias("k_heads"),
        types.alias("layer_types"),
    )


def layout_frame(spark: SparkSession, layout: Layout, model: str = "default") -> DataFrame:
    """One model row of a known layout."""
    return spark.range(1).select(
        F.lit(model).alias("model"),
        F.lit(layout.num_layers).alias("num_layers"),
        F.lit(layout.q_heads).alias("q_heads"),
        F.lit(layout.k_heads).alias("k_heads"),
        F.array(*[F.lit(t) for t in layout.layer_types]).alias("layer_types"),
    )


def with_sliding_layers(models: DataFrame) -> DataFrame:
    """Adds the numbers of the sliding-window layers."""
    numbers = F.sequence(F.lit(0), F.col("num_layers") - 1)
    # a list shorter than the layer count carries no information
    is_sliding = lambda i: F.coalesce(F.get("layer_types", i) == SLIDING, F.lit(False))
    known = F.size("layer_types") >= F.col("num_layers")
    return models.withColumn(
        "sliding_layers",
        F.when(known, F.filter(numbers, is_sliding)).otherwise(F.array().cast("array<int>")),
    )


def sliding_layers(models: DataFrame, model: str = "model") -> DataFrame:
    return _unfold(with_sliding_layers(models), "sliding_layers", "layer", model)


def _unfold(rows: DataFrame, column: str, name: str, model: str) -> DataFrame:
    """Explode a computed array.  A plain explode makes the optimizer add a
    filter on the array's size, which repeats the whole computation."""
    return rows.select(model, F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull())


def with_candidates(
    models: DataFrame,
    layers: Sequence[int] | None = None,
    heads: Sequence[int] | None = None,
    full_attention_only: bool = False,
) -> DataFrame:
    """Adds the query heads to choose from, and how many sliding ones were left out."""
    rows = with_sliding_layers(models)

    def check(numbers: Sequence[int], count: Column, what: str) -> Column:
        wanted = F.array(*[F.lit(int(x)) for x in numbers])
        bad = F.exists(wanted, lambda x: (x < 0) | (x >= count))
        message = F.lit(f"{what} {sorted(numbers)} not all in the model")
        return F.when(bad, F.raise_error(message)).otherwise(wanted).cast("array<int>")

    layer_list = (
        F.sequence(F.lit(0), F.col("num_layers") - 1)
        if layers is None
        else F.array_sort(check(layers, F.col("num_layers"), "layers"))
    )
    head_list = (
        F.sequence(F.lit(0), F.col("q_heads") - 1)
        if heads is None
        else F.array_sort(check(heads, F.col("q_heads"), "heads"))
    )
    grid = F.flatten(
        F.transform(
            layer_list,
            lambda l: F.transform(
                F.col("_heads"), lambda h: F.struct(l.alias("layer"), h.alias("head"))
            ),
        )
    )
    rows = rows.withColumn("_heads", head_list).withColumn("_grid", grid)
    if full_attention_only:
        kept = F.filter(
            "_grid", lambda c: ~F.array_contains(F.col("sliding_layers"), c["layer"])
        )
    else:
        kept = F.col("_grid")
    rows = rows.withColumn("candidates", kept)
    empty = F.raise_error(F.lit("no query head is left after the filters"))
    return (
        rows.withColumn(
            "candidates",
            F.when(F.size("candidates") == 0, empty.cast(rows.schema["candidates"].dataType))
            .otherwise(F.col("candidates")),
        )
        .withColumn("excluded_sliding", F.size("_grid") - F.size("candidates"))
        .drop("_heads", "_grid")
    )


def with_sampled_heads(
    candidates: DataFrame, count: int, seed: int = 0, model: str = "model"
) -> DataFrame:
    """Adds ``selected_q`` (at most ``count`` query heads, seeded) and the key
    heads they use, ``selected_k``."""
    if count < 1:
        raise ValueError("head count must be at least 1")
    ranked = F.array_sort(
        F.transform(
            "candidates",
            lambda c: F.struct(
                F.md5(
                    F.concat_ws(
                        "|",
                        F.lit(str(seed)),
                        F.col(model).cast("string"),
                        c["layer"].cast("string"),
                        c["head"].cast("string"),
                    )
                ).alias("draw"),
                c["layer"].alias("layer"),
                c["head"].alias("head"),
            ),
        )
    )
    selected = F.transform(
        F.slice(ranked, 1, count),
        lambda r: F.struct(r["layer"].alias("layer"), r["head"].alias("head")),
    )
    group = (F.col("q_heads") / F.col("k_heads")).cast("int")
    keys = F.array_distinct(
        F.transform(
            "selected_q",
            lambda r: F.struct(
                r["layer"].alias("layer"), F.floor(r["head"] / group).cast("int").alias("head")
            ),
        )
    )
    return candidates.withColumn("selected_q", selected).withColumn("selected_k", keys)


def explode_heads(rows: DataFrame, column: str, model: str = "model") -> DataFrame:
    """(model, layer, head) of an array of layer/head pairs."""
    return _unfold(rows, column, "_h", model).select(model, "_h.layer", "_h.head")


def selected_heads(rows: DataFrame, model: str = "model") -> DataFrame:
    """(model, layer, head, kind) of all selected query and key heads."""
    tagged = lambda column, kind: F.transform(
        column, lambda r: F.struct(r["layer"], r["head"], F.lit(kind).alias("kind"))
    )
    both = F.concat(tagged("selected_q", "q"), tagged("selected_k", "k"))
    return _unfold(rows.withColumn("_both", both), "_both", "_h", model).select(
        model,
        F.col("_h.layer").alias("layer"),
        F.col("_h.head").alias("head"),
        F.col("_h.kind").alias("kind"),
    )


def head_sampling_summary(rows: DataFrame, count: int, model: str = "model") -> DataFrame:
    """One row of figures per model."""
    n_sliding = F.size("sliding_layers")
    return rows.select(
        model,
        F.lit(count).alias("requested_q"),
        F.size("selected_q").alias("selected_q"),
        F.size("selected_k").alias("selected_k"),
        "num_layers",
        "q_heads",
        "k_heads",
        n_sliding.alias("sliding_layers"),
        (F.col("num_layers") - n_sliding).alias("full_layers"),
        "excluded_sliding",
    )


def attach_heads(rows: DataFrame, layout: Layout) -> DataFrame:
    """All heads of the row's kind."""
    last = F.when(F.col("kind") == "q", layout.q_heads - 1).otherwise(layout.k_heads - 1)
    return rows.withColumn("head", F.explode(F.sequence(F.lit(0), last)))


def filter_layers_heads(
    rows: DataFrame,
    layout: Layout,
    layers: Iterable[int] | None = None,
    heads: Iterable[int] | None = None,
    kinds: Iterable[str] = ("q", "k"),
) -> DataFrame:
    """Keep explicit layers and heads; a head that a captured kind lacks is an error."""
    out = rows
    if layers is not None:
        out = out.filter(F.col("layer").isin(sorted(layers)))
    if heads is not None:
        for kind in kinds:
            invalid = sorted(h for h in heads if not 0 <= h < layout.heads(kind))
            if invalid:
                raise ValueError(f"{kind} has no heads {invalid}, only {layout.heads(kind)}")
        out = out.filter(F.col("head").isin(sorted(heads)))
    return out


def filter_selected_heads(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Keep rows of selected heads; layers without an entry yield nothing."""
    return rows.join(selected.select("layer", "head", "kind"), ["layer", "head", "kind"], "left_semi")


def filter_full_attention(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("sliding_window").isNull())


def filter_kind(rows: DataFrame, queries: bool = True, keys: bool = True) -> DataFrame:
    kinds = [kind for kind, wanted in (("q", queries), ("k", keys)) if wanted]
    return rows.filter(F.col("kind").isin(kinds)) if kinds else rows.filter(F.lit(False))
