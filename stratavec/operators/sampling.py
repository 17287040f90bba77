"""Seeded, stratified sampling of positions.

Every step up to the sample itself works row by row: the corpus is never
shuffled, and a sequence is turned into its sampled positions inside the task
that read it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.defaults import KINDS
from stratavec.functions import buckets
from stratavec.functions.draws import group_seeds, uniform_draw, uniform_draws
from stratavec.operators.tokens import explode_positions, position_range

# positions of a sequence that are drawn for at once in Python
DRAWS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Strategy:
    """How positions are put into buckets and which draws keep a position."""

    name: str
    base_rate: float = 1.0
    bucket_size: int = 128

    def bucket(self, position: Column) -> Column:
        if self.name == "log_uniform":
            return buckets.log_bucket(position, self.bucket_size)
        return buckets.uniform_bucket(position, self.bucket_size)

    def bucket_array(self, positions: np.ndarray) -> np.ndarray:
        """The same buckets for an array of positions."""
        if self.name == "log_uniform":
            # exponents of frexp are exact, unlike a logarithm
            powers = np.frexp((positions + 1).astype(np.float64))[1].astype(np.int64) - 1
            return np.maximum(powers, buckets.floor_power(self.bucket_size))
        return positions // self.bucket_size

    def keep(self, draw: Column, position: Column) -> Column | None:
        """Condition on the draw, or None if every position is kept."""
        if self.name == "log_uniform":
            # the smallest bucket has the largest probability: this cheap bound
            # drops most positions before their bucket is worked out
            smallest = 1 << buckets.floor_power(self.bucket_size)
            bound = draw < F.lit(buckets.uniform_keep_probability(smallest, self.base_rate))
            probability = buckets.log_keep_probability(self.bucket(position), self.base_rate)
            return bound & (draw < probability)
        if self.name == "uniform":
            return draw < F.lit(buckets.uniform_keep_probability(self.bucket_size, self.base_rate))
        return None

    def keep_array(self, draws: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The same choice for arrays of draws and positions."""
        if self.name == "log_uniform":
            widths = np.exp2(self.bucket_array(positions))
            return draws < np.minimum(1.0, self.base_rate / widths)
        if self.name == "uniform":
            return draws < buckets.uniform_keep_probability(self.bucket_size, self.base_rate)
        return np.ones(len(positions), dtype=bool)


STRATEGIES = ("log_uniform", "uniform", "all")


def sampler_by_name(name: str, base_rate: float = 1.0, bucket_size: int = 128) -> Strategy:
    if name.lower() not in STRATEGIES:
        raise ValueError(f"unsupported sampler {name!r}, use one of {', '.join(STRATEGIES)}")
    if bucket_size < 1:
        raise ValueError("bucket size must be at least 1")
    return Strategy(name.lower(), float(base_rate), int(bucket_size))


def sequence_groups(
    examples: DataFrame, layers: Sequence[int], kinds: Sequence[str] = KINDS
) -> DataFrame:
    """One row per (example, layer, kind)."""
    return examples.withColumn(
        "layer", F.explode(F.array(*[F.lit(int(x)) for x in layers]))
    ).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))


def with_seeds(groups: DataFrame, seed: int, *key: str) -> DataFrame:
    first, second = group_seeds(seed, *[F.col(k) for k in key])
    return groups.select("*", first.alias("_s1"), second.alias("_s2"))


def seeded_draw(groups: DataFrame, seed: int, *key: str) -> DataFrame:
    """Every position of every group with its draw ``u``."""
    rows = explode_positions(with_seeds(groups, seed, *key))
    draw = uniform_draw(F.col("_s1"), F.col("_s2"), F.col("position"))
    return rows.withColumn("u", draw).drop("_s1", "_s2")


def _sample(groups: DataFrame, strategy: Strategy, seed: int, key: tuple[str, ...]) -> DataFrame:
    position = F.col("position")
    draw = uniform_draw(F.col("_s1"), F.col("_s2"), position)
    condition = strategy.keep(draw, position)
    if condition is None:
        rows = explode_positions(groups)
    else:
        rows = explode_positions(with_seeds(groups, seed, *key)).filter(condition)
    return rows.withColumn("bucket", strategy.bucket(position)).drop("_s1", "_s2")


def sample_shared(groups: DataFrame, strategy: Strategy, seed: int = 0) -> DataFrame:
    """One mask per (example, layer, kind), the same for all heads."""
    return _sample(groups, strategy, seed, ("example_id", "layer", "kind"))


def sample_per_head(groups: DataFrame, strategy: Strategy, seed: int = 0) -> DataFrame:
    """A mask of its own for every head; ``groups`` must carry ``head``."""
    return _sample(groups, strategy, seed, ("example_id", "layer", "kind", "head"))


def cap_rows(rows: DataFrame, limit: int | None, seed: int = 0) -> DataFrame:
    """At most ``limit`` positions per (example, layer, kind), by seeded choice.

    Rows are ranked in their map task first, so a group sends no more than
    ``limit`` rows per task into the shuffle.
    """
    if limit is None or limit <= 0:
        return rows
    key = ["example_id", "layer", "kind"]
    first, second = group_seeds(seed, *[F.col(k) for k in key], F.lit("cap"))
    seeded = rows.select("*", first.alias("_c1"), second.alias("_c2"))
    draw = uniform_draw(F.col("_c1"), F.col("_c2"), F.col("position"))
    ranked = seeded.withColumn("_draw", draw).withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy(*key).orderBy("_draw", "position")),
    )
    return ranked.filter(F.col("_rank") <= limit).drop("_c1", "_c2", "_draw", "_rank")


def sample_capped_in_row(
    groups: DataFrame, strategy: Strategy, limit: int, seed: int = 0
) -> DataFrame:
    """Same rows as ``cap_rows(sample_shared(...))`` without a window.

    The choice is made inside the row of the group, so it also runs on a stream.
    """
    key = ("example_id", "layer", "kind")
    seeded = with_seeds(groups, seed, *key)
    first, second = group_seeds(seed, *[F.col(k) for k in key], F.lit("cap"))
    seeded = seeded.select("*", first.alias("_c1"), second.alias("_c2"))
    positions = position_range()

    def keep(p: Column) -> Column:
        condition = strategy.keep(uniform_draw(F.col("_s1"), F.col("_s2"), p), p)
        return F.lit(True) if condition is None else condition

    ranked = F.array_sort(
        F.transform(
            F.filter(positions, keep),
            lambda p: F.struct(
                uniform_draw(F.col("_c1"), F.col("_c2"), p).alias("draw"), p.alias("position")
            ),
        )
    )
    chosen = F.explode(F.slice(ranked, 1, limit)) if limit > 0 else F.explode(ranked)
    return (
        seeded.withColumn("_chosen", chosen)
        .withColumn("position", F.col("_chosen.position"))
        .withColumn("bucket", strategy.bucket(F.col("position")))
        .drop("_s1", "_s2", "_c1", "_c2", "_chosen")
    )


def sampled_in_row(
    examples: DataFrame,
    layers: Sequence[int],
    kinds: Sequence[str],
    strategy: Strategy,
    seed: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Adds ``wanted``: the sampled positions of every (layer, kind), in the row of the
    example.

    The same positions as ``cap_rows(sample_shared(...))``, in ascending order.  Only lengths
    and seeds go to Python, and positions come back.
    """
    groups = F.array(
        *[F.struct(F.lit(int(x)).alias("layer"), F.lit(k).alias("kind")) for x in layers for k in kinds]
    )

    def seeds(g: Column) -> Column:
        key = (F.col("example_id"), g["layer"], g["kind"])
        return F.array(*group_seeds(seed, *key), *group_seeds(seed, *key, F.lit("cap")))

    def kept_of(length: int, s1: int, s2: int, c1: int, c2: int) -> np.ndarray:
        kept = [np.empty(0, dtype=np.int64)]
        for start in range(0, length, DRAWS_AT_ONCE):
            positions = np.arange(start, min(length, start + DRAWS_AT_ONCE), dtype=np.int64)
            draws = uniform_draws(s1, s2, positions)
            kept.append(positions[strategy.keep_array(draws, positions)])
        positions = np.concatenate(kept)
        if limit is not None and 0 < limit < len(positions):
            order = np.lexsort((positions, uniform_draws(c1, c2, positions)))
            positions = np.sort(positions[order[:limit]])
        return positions

    n_groups = len(layers) * len(kinds)

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def chosen(lengths: pa.Array, seeds: pa.Array) -> pa.Array:
        sizes = lengths.fill_null(0).to_numpy(zero_copy_only=False).repeat(n_groups)
        each = seeds.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        parts = [kept_of(n, *four) for n, four in zip(sizes.tolist(), each.tolist())]
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        places = pa.array(np.concatenate([np.empty(0, np.int64), *parts]), pa.int32())
        of_group = pa.ListArray.from_arrays(pa.array(ends), places)
        rows = np.arange(len(lengths) + 1, dtype=np.int32) * n_groups
        return pa.ListArray.from_arrays(pa.array(rows), of_group)

    of_group = F.zip_with(
        groups,
        chosen(F.col("n_tokens"), F.transform(groups, seeds)),
        lambda g, p: F.struct(g["layer"].alias("layer"), g["kind"].alias("kind"), p.alias("positions")),
    )
    return examples.select("*", of_group.alias("wanted"))


Predicate = Callable[[Column, Column], Column]
MaskFunction = Callable[[np.ndarray, np.ndarray], np.ndarray]


def sample_where(groups: DataFrame, strategy: Strategy, predicate: Predicate) -> DataFrame:
    """Custom sampler as a column predicate over position and bucket."""
    rows = explode_positions(groups).withColumn("bucket", strategy.bucket(F.col("position")))
    return rows.filter(predicate(F.col("position"), F.col("bucket")).cast("boolean"))


def sample_with_mask(groups: DataFrame, strategy: Strategy, mask: MaskFunction) -> DataFrame:
    """Custom sampler as a Python function from a sequence's positions and
    buckets to one mask entry per position.  A mask of another length is an
    error; entries are cast to boolean.

    Positions and buckets follow from the length, so only lengths are sent to
    Python, and only kept positions come back.  A mask depends on nothing else:
    it is asked once for every length in an Arrow batch.
    """

    def kept_of(length: int) -> list[int]:
        positions = np.arange(length, dtype=np.int64)
        flags = np.asarray(mask(positions, strategy.bucket_array(positions)))
        if flags.shape != (length,):
            raise ValueError(f"mask of shape {flags.shape} for a sequence of {length}")
        return positions[flags.astype(bool)].tolist()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def kept(lengths: pd.Series) -> pd.Series:
        return lengths.map({n: kept_of(n) for n in lengths.unique().tolist()})

    return (
        groups.filter(F.col("n_tokens") > 0)
        .withColumn("position", F.explode(kept("n_tokens")))
        .withColumn("bucket", strategy.bucket(F.col("position")))
    )
