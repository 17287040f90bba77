"""Vectors for sampled positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.defaults import KINDS, SLIDING, Layout
from stratavec.functions.vectors import head_slice, to_float32
from stratavec.operators.heads import attach_heads
from stratavec.operators.rotary import bounded_layers
from stratavec.operators.vector_store import require_unique


# vectors broadcast for frequent tokens: 1000 of 128 floats are half a megabyte
HOT_LIMIT = 1000


def _token_number(start: int, digits: int) -> Column:
    """Some hexadecimal digits of a hash of (token, layer, kind)."""
    text = F.concat_ws("|", "token_str", F.col("layer").cast("string"), "kind")
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def token_vector_id(n_vectors: int) -> Column:
    """Row of the vector table for (token, layer, kind): 60 bits of the hash."""
    return F.pmod(_token_number(1, 15), F.lit(n_vectors)).cast("bigint")


def flat_vectors(vectors: DataFrame, layout: Layout, kind: str) -> DataFrame:
    """``(vec_id, slot, kind, flat)``: the flat vectors of a kind in every table row.

    A row may hold several vectors of a kind with fewer heads; a row that is no
    whole number of them is an error.
    """
    width = layout.heads(kind) * layout.head_dim
    size = F.size("embedding")
    wrong = F.raise_error(
        F.concat(F.lit(f"not a multiple of {width} entries: "), size.cast("string"))
    )
    last = F.when((size > 0) & (size % width == 0), (size / width).cast("int") - 1)
    slots = F.sequence(F.lit(0), last.otherwise(wrong.cast("int")))
    return vectors.select("vec_id", "embedding", F.explode(slots).alias("slot")).select(
        "vec_id",
        "slot",
        F.lit(kind).alias("kind"),
        F.slice("embedding", F.col("slot") * width + 1, F.lit(width)).alias("flat"),
    )


def _slots(width: int, layout: Layout) -> Column:
    """How many vectors of the row's kind a table row of this width holds."""
    for kind in KINDS:
        if width % (layout.heads(kind) * layout.head_dim):
            raise ValueError(f"{width} entries hold no whole vectors of kind {kind}")
    count = lambda kind: width // (layout.heads(kind) * layout.head_dim)
    return F.when(F.col("kind") == "q", count("q")).otherwise(count("k"))


def with_vector_place(rows: DataFrame, n_vectors: int, width: int, layout: Layout) -> DataFrame:
    """Adds ``vec_id`` and ``slot``, the place of the row's vector in the table."""
    slot = F.pmod(_token_number(16, 7), _slots(width, layout)).cast("int")
    return rows.withColumn("vec_id", token_vector_id(n_vectors)).withColumn("slot", slot)


def found_vector(vector: Column, *key: str) -> Column:
    """The vector, or an error that names the row which has none."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key]
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.concat_ws(", ", *parts)))
    return F.when(vector.isNotNull(), vector).otherwise(missing.cast("array<float>"))


def place_in_row(row: Column, width: int, layout: Layout) -> Column:
    """The vector at ``slot`` of a vector table's row; a missing row is an error."""
    size = (F.lit(width) / _slots(width, layout)).cast("int")
    return F.slice(found_vector(row, "vec_id"), F.col("slot") * size + 1, size)


@dataclass
class LookupEncoder:
    """Encoder that takes flat vectors from a table ``(vec_id, embedding)``, whose
    ids are 0 .. n - 1.

    The sample is the left side of the join, so it is never what is broadcast and
    none of its rows is lost: a missing vector is an error.  Spark broadcasts the
    table only below ``spark.sql.autoBroadcastJoinThreshold``; a larger one is
    joined by shuffle, where AQE splits the partitions of frequent tokens.

    Without AQE, or to save it the work, ``hot`` may name up to ``HOT_LIMIT``
    frequent vector ids (see ``frequent_vector_ids``); more are refused.  Their
    vectors are broadcast and their rows are spread evenly instead of by id.  The
    result is the same for any choice of ids.
    """

    vectors: DataFrame
    n_vectors: int
    hot: DataFrame | None = None
    layout: Layout = Layout()
    width: int = 0

    @classmethod
    def over(
        cls, vectors: DataFrame, hot: DataFrame | None = None, layout: Layout | None = None
    ) -> LookupEncoder:
        n, least, most, narrow, wide = vectors.agg(
            F.count("*"),
            F.min("vec_id"),
            F.max("vec_id"),
            F.min(F.size("embedding")),
            F.max(F.size("embedding")),
        ).first()
        if n and (least, most) != (0, n - 1):
            raise ValueError(f"vector ids must be 0 .. {n - 1}, got {least} .. {most}")
        # an id on two rows would double the sample
        require_unique(vectors, ("vec_id",))
        if narrow != wide:
            raise ValueError(f"vectors of {narrow} and of {wide} entries in one table")
        return cls(vectors, n, hot, layout or Layout(), wide or 0)

    def encode(self, rows: DataFrame) -> DataFrame:
        width = self.width or self.layout.q_heads * self.layout.head_dim
        keyed = with_vector_place(rows, self.n_vectors, width, self.layout)
        source = self.vectors.select("vec_id", F.col("embedding").alias("flat"))
        if self.hot is None:
            joined = keyed.join(source, "vec_id", "left")
        else:
            joined = self._joined_hot(keyed, source)
        part = place_in_row(F.col("flat"), width, self.layout)
        return joined.withColumn("flat", part).drop("slot")

    def _joined_hot(self, keyed: DataFrame, source: DataFrame) -> DataFrame:
        ids = self.hot.select("vec_id").distinct()
        if len(ids.take(HOT_LIMIT + 1)) > HOT_LIMIT:
            raise ValueError(f"more than {HOT_LIMIT} frequent vector ids")
        hot = source.join(F.broadcast(ids), "vec_id", "left_semi").withColumnRenamed("flat", "_hot")
        # rows that have their vector get a negative key, which matches nothing
        spot = F.pmod(F.xxhash64("example_id", "layer", "kind", "position"), F.lit(1 << 30))
        key = F.when(F.col("_hot").isNull(), F.col("vec_id")).otherwise(-F.lit(1) - spot)
        return (
            keyed.join(F.broadcast(hot), "vec_id", "left")
            .withColumn("_key", key)
            .join(source.withColumnRenamed("vec_id", "_key"), "_key", "left")
            .withColumn("flat", F.coalesce("_hot", "flat"))
            .drop("_hot", "_key")
        )


def frequent_vector_ids(sample: DataFrame, n_vectors: int, limit: int = HOT_LIMIT) -> DataFrame:
    """The most frequent vector ids among the sampled tokens of some texts."""
    return (
        sample.groupBy(token_vector_id(n_vectors).alias("vec_id"))
        .count()
        .orderBy(F.col("count").desc(), "vec_id")
        .limit(limit)
        .select("vec_id")
    )


@dataclass
class BatchEncoder:
    """Encoder around a Python model, called once per Arrow batch of rows.

    ``model(tokens, layers, kinds, positions)`` returns one flat vector per row.
    """

    model: Callable[[list[str], np.ndarray, list[str], np.ndarray], np.ndarray]

    def encode(self, rows: DataFrame) -> DataFrame:
        model = self.model

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def flat(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for token, layer, kind, position in batches:
                out = np.asarray(
                    model(list(token), layer.to_numpy(), list(kind), position.to_numpy()),
                    dtype=np.float32,
                )
                if len(out) != len(token):
                    raise ValueError(f"{len(out)} vectors for {len(token)} rows")
                yield pd.Series(list(out))

        return rows.withColumn("flat", flat("token_str", "layer", "kind", "position"))


def split_heads(rows: DataFrame, n_heads: int, head_dim: int, flat: str = "flat") -> DataFrame:
    """One row per head of a flat projection."""
    return (
        rows.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(n_heads - 1))))
        .withColumn("vector", head_slice(F.col(flat), F.col("head"), head_dim, n_heads))
        .drop(flat)
    )


def head_vectors(encoded: DataFrame, layout: Layout, selected: DataFrame | None = None) -> DataFrame:
    """Vector of every active head of every encoded row, as float32."""
    if selected is None:
        rows = attach_heads(encoded, layout)
    else:
        rows = encoded.join(selected.select("layer", "head", "kind"), ["layer", "kind"])
    n_heads = F.when(F.col("kind") == "q", layout.q_heads).otherwise(layout.k_heads)
    vector = head_slice(F.col("flat"), F.col("head"), layout.head_dim, n_heads)
    return rows.withColumn("vector", to_float32(vector)).drop("flat")


def gather_vectors(
    sampled: DataFrame,
    vectors: DataFrame,
    on: tuple[str, ...] = ("example_id", "layer", "kind", "position"),
    selected: DataFrame | None = None,
    checked: bool = False,
) -> DataFrame:
    """Vectors of the active heads at the sampled positions only.

    ``vectors`` has a row per head.  Heads that are not selected are left out
    before the join: on the vector side if it knows its layer, otherwise by
    giving each sampled row just the active heads of its layer and kind.  The
    sample is the left side, and a position without a vector is an error.  So is a
    key with two vectors, which would double rows: the keys alone are read for it
    first, unless ``checked`` says that was done.
    """
    if not checked:
        head = {"head"} & set(vectors.columns) - set(on)
        layer = {"layer", "kind"} & set(vectors.columns) - set(on) if head else set()
        require_unique(vectors, (*on, *sorted(head | layer)))
    if selected is None:
        return _with_vectors(sampled, vectors, on)
    chosen = selected.select("layer", "head", "kind")
    if {"layer", "head", "kind"} <= set(vectors.columns):
        source = vectors.join(chosen, ["layer", "head", "kind"], "left_semi")
        active = sampled.join(chosen.select("layer", "kind").distinct(), ["layer", "kind"], "left_semi")
        return _with_vectors(active, source, on)
    return _with_vectors(sampled.join(chosen, ["layer", "kind"]), vectors, (*on, "head"))


def _with_vectors(sampled: DataFrame, vectors: DataFrame, on: tuple[str, ...]) -> DataFrame:
    rows = sampled.join(vectors, list(on), "left")
    return rows.withColumn("vector", found_vector(F.col("vector"), *on))


def window_of_layer(layout: Layout) -> Column:
    """Window of the row's layer, null for full attention."""
    sliding = [i for i, t in enumerate(layout.layer_types) if t == SLIDING]
    return F.when(F.col("layer").isin(sliding), F.lit(layout.sliding_window).cast("int"))


def tag_sliding_window(rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Adds ``sliding_window`` from a table ``(layer, sliding_window)``."""
    return rows.join(bounded_layers(layers, "sliding_window"), "layer", "left")


def window_conflicts(rows: DataFrame) -> DataFrame:
    """Groups (layer, kind) that carry more than one window; must be empty."""
    seen = F.coalesce(F.col("sliding_window"), F.lit(-1))
    return (
        rows.groupBy("layer", "kind")
        .agg(F.min(seen).alias("low"), F.max(seen).alias("high"))
        .filter(F.col("low") != F.col("high"))
    )


def merge_batches(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all batches; equal rows are kept."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out
