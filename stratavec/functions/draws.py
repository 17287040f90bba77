"""Uniform numbers fixed by a key and a position.

``rand()`` depends on how rows are partitioned, so it would change between
runs.  Here the key of a group gives two seeds (one md5 per group) and a short
31-bit integer mixer turns seeds and position into a number in [0, 1).  Compute
the seeds before positions are exploded: afterwards every row would pay the md5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the mixer
MULTIPLIER = 73244475
MASK_31 = 2147483647
RANGE_31 = 2147483648.0


def _hex_number(digest: Column, start: int, length: int) -> Column:
    number = F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")
    # never null; saying so spares a null filter that would repeat the md5
    return F.coalesce(number, F.lit(0).cast("bigint"))


def group_seeds(seed: int, *key: Column) -> tuple[Column, Column]:
    """Two 28-bit seeds of a group key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return _hex_number(digest, 1, 7), _hex_number(digest, 8, 7)


def _scramble(value: Column) -> Column:
    return ((value.bitwiseXOR(F.shiftright(value, 16))) * F.lit(MULTIPLIER)).bitwiseAND(
        F.lit(MASK_31).cast("bigint")
    )


def uniform_draw(first: Column, second: Column, position: Column) -> Column:
    """Number in [0, 1) for one position of a seeded group."""
    start = first.bitwiseXOR(position.cast("bigint"))
    middle = _scramble(start).bitwiseXOR(second)
    end = _scramble(middle)
    return end.bitwiseXOR(F.shiftright(end, 16)) / F.lit(RANGE_31)


def uniform_draws(first: int, second: int, positions: np.ndarray) -> np.ndarray:
    """The same numbers for an array of positions of one group."""
    scramble = lambda value: ((value ^ (value >> 16)) * MULTIPLIER) & MASK_31
    end = scramble(scramble(positions.astype(np.int64) ^ first) ^ second)
    return (end ^ (end >> 16)) / RANGE_31
