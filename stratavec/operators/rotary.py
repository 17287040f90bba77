"""From vectors captured before the rotary step to those after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.defaults import Layout
from stratavec.functions.vectors import (
    frequencies,
    query_scale,
    of_width,
    rotate_halves_by,
    rotate_pairs_by,
    scale_vector,
    turn_arrays,
    turned_entries,
)


def bounded_layers(layers: DataFrame, *columns: str) -> DataFrame:
    """These columns of a table with one row per layer, as a broadcast.

    The layers of a model are few, whatever the capture; a layer with two rows is
    an error, so rows of the capture are never doubled.
    """
    twice = F.raise_error(F.concat(F.lit("more than one row for layer "), F.col("layer").cast("string")))
    # one partition, so that the check needs no shuffle
    once = (
        layers.select("layer", F.struct(*columns).alias("_row"))
        .coalesce(1)
        .groupBy("layer")
        .agg(F.count("*").alias("_n"), F.first("_row").alias("_row"))
        .withColumn("layer", F.when(F.col("_n") == 1, F.col("layer")).otherwise(twice.cast("int")))
    )
    return F.broadcast(once.select("layer", "_row.*"))


def rotate_capture(
    capture: DataFrame, layers: DataFrame, layout: Layout, rotary_dim: int | None = None
) -> DataFrame:
    """Rotate every vector with the base of its layer.

    ``layers(layer, rope_theta, use_rope)`` is one row per layer; vectors of
    layers that do not rotate pass unchanged.  With ``rotary_dim`` neighbours
    are paired and only the first entries turn, otherwise halves are paired.
    The frequencies are worked out once per layer and travel with its row.
    """
    vector, position, own_rates = F.col("vector"), F.col("position"), F.col("_rates")
    if rotary_dim is None:
        turned = rotate_halves_by(vector, position, layout.head_dim, own_rates)
    else:
        turned = rotate_pairs_by(vector, position, layout.head_dim, rotary_dim, own_rates)
    out = F.when(F.col("use_rope"), turned).otherwise(vector.cast("array<double>"))
    rates = layers.withColumn(
        "_rates", frequencies(rotary_dim or layout.head_dim, F.col("rope_theta"))
    )
    return (
        capture.join(bounded_layers(rates, "_rates", "use_rope"), "layer")
        .withColumn("vector", out)
        .drop("_rates", "use_rope")
    )


def with_turns(
    rows: DataFrame, layers: DataFrame, layout: Layout, rotary_dim: int | None = None
) -> DataFrame:
    """Adds ``turns`` to rows without heads: what the entries of a vector at the row's
    position are multiplied by, with the base of its layer.  Layers that do not rotate
    turn by nothing."""
    dim = rotary_dim or layout.head_dim
    theta = F.when(F.col("use_rope"), F.col("rope_theta")).otherwise(F.lit(1.0))
    rates = F.transform(
        frequencies(dim, theta), lambda rate: F.when(F.col("use_rope"), rate).otherwise(F.lit(0.0))
    )
    joined = rows.join(bounded_layers(layers.withColumn("_rates", rates), "_rates"), "layer")
    cosines, sines = turn_arrays(F.col("position"), F.col("_rates"), rotary_dim is not None)
    return joined.withColumn("turns", F.struct(cosines.alias("c"), sines.alias("s"))).drop("_rates")


def rotate_turned(
    capture: DataFrame, layout: Layout, rotary_dim: int | None = None
) -> DataFrame:
    """Rotate vectors that carry the ``turns`` of their position."""
    dim, vector = layout.head_dim, F.col("vector")
    # a column of its own, so that the check and the cast are made once
    wide = capture.withColumn(
        "vector", of_width(vector, dim, vector.cast("array<double>"), "array<double>")
    ).withColumn("_c", F.col("turns.c")).withColumn("_s", F.col("turns.s"))
    own, rest = vector, None
    if rotary_dim is not None and rotary_dim < dim:
        wide = wide.withColumn("_rest", F.slice(vector, rotary_dim + 1, dim - rotary_dim))
        wide = wide.withColumn("vector", F.slice(vector, 1, rotary_dim))
        rest = F.col("_rest")
    out = turned_entries(own, F.col("_c"), F.col("_s"), rotary_dim or dim, rotary_dim is not None)
    out = out if rest is None else F.concat(out, rest)
    return wide.withColumn("vector", out).drop("turns", "_c", "_s", "_rest")


def scale_queries(capture: DataFrame, beta: float, max_position: int) -> DataFrame:
    """Position-dependent scale of rotated query vectors; keys pass unchanged."""
    scale = query_scale(F.col("position"), beta, max_position)
    scaled = scale_vector(F.col("vector"), scale)
    return capture.withColumn(
        "vector",
        F.when(F.col("kind") == "q", scaled).otherwise(F.col("vector").cast("array<double>")),
    )
