"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from stratavec.session import scratch_path

# code points of one Arrow batch are handled in slices of about this many bytes
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: what follows reads files that outlive every executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_struct(row: Callable[[str], tuple], schema: pa.StructType) -> Callable[[Column], Column]:
    """Arrow function from a text column to a struct, one Python call per text.

    A null text is handed on as the empty string.
    """
    fields = list(schema)

    @F.arrow_udf(from_arrow_type(schema))
    def apply(texts: pa.Array) -> pa.Array:
        rows = [row(t or "") for t in texts.to_pylist()]
        columns = zip(*rows) if rows else [[] for _ in fields]
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, fields)]
        return pa.StructArray.from_arrays(arrays, fields=fields)

    return apply


def without_id_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of several rows with one id keeps one; rows without an id all stay."""
    ids = docs.select(key).filter(F.col(key).isNotNull())
    repeated = ids.groupBy(key).count().filter("count > 1").select(key)
    if not repeated.head(1):
        return docs
    single = docs.filter(F.col(key).isNull()).unionByName(
        docs.filter(F.col(key).isNotNull()).join(repeated, key, "left_anti").select(*docs.columns)
    )
    chosen = docs.join(repeated, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return single.unionByName(chosen)


def chunks(items: Iterable, size: int):
    """Lists of at most ``size`` items."""
    part: list = []
    for item in items:
        part.append(item)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
