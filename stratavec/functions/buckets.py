"""Position buckets and keep probabilities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_power(min_size: int) -> int:
    """Exponent of the smallest power of two that is at least ``min_size``."""
    if min_size < 1:
        raise ValueError("bucket size must be at least 1")
    return (min_size - 1).bit_length()


def _bit_length(value: Column) -> Column:
    # exact for every BIGINT, where floor(log2()) is off near powers of two
    return F.length(F.bin(value))


def log_bucket(position: Column, min_size: int) -> Column:
    """floor(log2(position + 1)), not below the bucket of ``min_size``."""
    power = _bit_length(position.cast("bigint") + 1) - 1
    return F.greatest(power, F.lit(floor_power(min_size))).cast("int")


def uniform_bucket(position: Column, size: int) -> Column:
    """Number of the fixed-width bucket."""
    if size < 1:
        raise ValueError("bucket size must be at least 1")
    return F.floor(position / F.lit(size)).cast("int")


def effective_bucket_size(size: Column) -> Column:
    """Requested size rounded up to a power of two."""
    return F.when(size == 1, F.lit(1).cast("bigint")).otherwise(
        bucket_width(_bit_length(size - 1))
    )


def bucket_width(bucket: Column) -> Column:
    """2^bucket, the nominal width of a log bucket."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bucket)


def log_keep_probability(bucket: Column, base_rate: float) -> Column:
    return F.least(F.lit(1.0), F.lit(float(base_rate)) / bucket_width(bucket).cast("double"))


def uniform_keep_probability(size: int, base_rate: float) -> float:
    return min(1.0, float(base_rate) / float(size))
