"""Example ids as 64-bit integers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def md5_id(value: Column) -> Column:
    """60-bit id of a string; stays in the JVM and is the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


@F.pandas_udf(T.LongType())
def blake2b_id(values: pd.Series) -> pd.Series:
    """Signed little-endian 8-byte blake2b of a string; Spark has no blake2b."""
    return values.map(
        lambda text: int.from_bytes(
            hashlib.blake2b(str(text).encode("utf-8"), digest_size=8).digest(), "little", signed=True
        )
    )


def normalize_example_id(value: Column, data_type: T.DataType, hashed=md5_id) -> Column:
    """64-bit id of a column: whole numbers pass, everything else is hashed.

    Strings are always hashed, also those that look like numbers.
    """
    low, high = F.lit(-(2**63)).cast("bigint"), F.lit(2**63 - 1).cast("bigint")
    as_text = value.cast("string")
    if isinstance(data_type, T.BooleanType):
        return value.cast("int").cast("bigint")
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("bigint")
    if isinstance(data_type, T.DecimalType) and data_type.scale == 0:
        fits = value.between(low.cast("decimal(38,0)"), high.cast("decimal(38,0)"))
        return F.when(fits, value.try_cast("bigint")).otherwise(hashed(as_text))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(2.0**63))
        return F.when(whole, value.try_cast("bigint")).otherwise(hashed(as_text))
    return hashed(as_text)


def wrap_int32(value: Column) -> Column:
    """Low 32 bits of a BIGINT as a signed INT, without an ANSI overflow."""
    low_bits = value.bitwiseAND(F.lit(4294967295).cast("bigint"))
    sign = F.lit(2147483648).cast("bigint")
    return (low_bits.bitwiseXOR(sign) - sign).cast("int")
