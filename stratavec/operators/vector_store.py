"""A vector table that is met where it lies.

The vectors are written once, bucketed and sorted by their key.  A sample is then brought
to them: only the sample is shuffled, into the buckets, and the scan leaves out

* row groups outside the ranges of keys that the sample touches, by Parquet statistics;
* rows whose key is surely not in the sample, by a Bloom filter.

The filter is a bitmap aggregate in blocks of 32768 bits, with several bits of one block
for each key, so it is one small broadcast whose size is bounded whatever the sample; a
large sample makes it let more rows through, never fewer.  Keys with a large share of the
sample would fill their bucket's task; their vectors are broadcast, ``HOT_KEYS`` at most.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratavec.session import stored

BLOCK_BITS = 32768
# bits of the filter for each key, and set bits per key
BITS_PER_KEY, PROBES = 12, 4
# blocks of 4 kB: the filter is 64 MB at most
MAX_BLOCKS = 16384
# ranges of keys that the scan is restricted to
RANGES = 64
HOT_KEYS = 1000


def _hash(keys: tuple[str, ...], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def _probes(keys: tuple[str, ...]) -> list[Column]:
    """Places of a key's bits in its block: 15 bits of one hash for each."""
    places = _hash(keys, 2)
    return [
        F.shiftright(places, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("bigint"))
        for i in range(PROBES)
    ]


def filter_blocks(n_keys: int) -> int:
    return min(max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS)), MAX_BLOCKS)


def key_filter(sample: DataFrame, keys: tuple[str, ...], blocks: int) -> DataFrame:
    """``(_block, _bits)``: a Bloom filter of the keys, one row per block."""
    number = F.pmod(_hash(keys, 1), F.lit(blocks)).alias("_block")
    bits = sample.select(number, F.explode(F.array(*_probes(keys))).alias("_bit"))
    return bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def maybe_in(rows: DataFrame, keys: tuple[str, ...], found: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter; a key that is in it always passes."""

    def is_set(place: Column) -> Column:
        byte = F.substring(F.col("_bits"), (F.shiftright(place, 3) + 1).cast("int"), 1)
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        bit = F.get(F.lit([1 << i for i in range(8)]), place.bitwiseAND(F.lit(7)).cast("int"))
        return value.bitwiseAND(bit) != 0

    number = F.pmod(_hash(keys, 1), F.lit(blocks))
    return (
        rows.withColumn("_block", number)
        .join(F.broadcast(found), "_block")
        .filter(reduce(and_, [is_set(p) for p in _probes(keys)]))
        .drop("_block", "_bits")
    )


def key_counts(sample: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every key of the sample once, with its number of rows ``_n``."""
    return sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def covering_ranges(numbers: list[int], low: int, width: int) -> list[tuple[int, int]]:
    """Ranges of keys (ends included) made of neighbouring slabs of one width."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        first, last = low + n * width, low + (n + 1) * width - 1
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


@dataclass(frozen=True)
class VectorStore:
    """Vectors below ``path``, bucketed by ``keys``, the first of which is a whole number.

    A key is there once; writing one that is there twice, or a null, is an error.
    """

    spark: SparkSession
    path: str
    table: str
    keys: tuple[str, ...]
    buckets: int

    @classmethod
    def write(
        cls, vectors: DataFrame, path: str, keys: tuple[str, ...], buckets: int
    ) -> VectorStore:
        """Writes the vectors: one shuffle, after which each bucket is one file."""
        require_unique(vectors, keys)
        spark, name = vectors.sparkSession, f"vectors_{uuid.uuid4().hex}"
        (
            vectors.repartition(buckets, *keys)
            .sortWithinPartitions(*keys)
            .write.bucketBy(buckets, *keys)
            .sortBy(*keys)
            .option("path", f"{path}/data")
            .option("compression", "zstd")
            .saveAsTable(name)
        )
        about = json.dumps({"keys": keys, "buckets": buckets, "schema": vectors.schema.json()})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")
        return cls(spark, path, name, tuple(keys), buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorStore:
        """A store that was written before, in any session."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        fields = StructType.fromJson(json.loads(about["schema"])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        listed = ", ".join(f"`{k}`" for k in about["keys"])
        name = f"vectors_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({listed}) "
            f"SORTED BY ({listed}) INTO {about['buckets']} BUCKETS LOCATION '{path}/data'"
        )
        return cls(spark, path, name, tuple(about["keys"]), about["buckets"])

    def rows(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def touched(self, sample: DataFrame) -> DataFrame:
        """Rows of the store that the sample may ask for."""
        first = self.keys[0]
        low, high, distinct = sample.agg(
            F.min(first), F.max(first), F.approx_count_distinct(_hash(self.keys, 1))
        ).first()
        if low is None:
            return self.rows().limit(0)
        width = -(-(high - low + 1) // RANGES)
        slab = F.floor((F.col(first) - F.lit(low)) / F.lit(width))
        # at most RANGES numbers
        numbers = sample.agg(F.collect_set(slab)).first()[0]
        ranges = covering_ranges(numbers, low, width)
        near = reduce(or_, [F.col(first).between(a, b) for a, b in ranges])
        blocks = filter_blocks(distinct)
        found = key_filter(sample, self.keys, blocks)
        return maybe_in(self.rows().filter(near), self.keys, found, blocks)

    def hot_keys(self, sample: DataFrame) -> list[int]:
        """Keys with more than a quarter of an even bucket's rows."""
        return self._hot(key_counts(sample, self.keys))

    def _hot(self, counts: DataFrame) -> list[int]:
        if len(self.keys) > 1:
            return []
        total = counts.agg(F.sum("_n")).first()[0] or 0
        # fewer than four times the buckets
        many = (F.col("_n") * (4 * self.buckets) > total) & F.col(self.keys[0]).isNotNull()
        rows = counts.filter(many).orderBy(F.col("_n").desc()).limit(HOT_KEYS).collect()
        return [r[0] for r in rows]

    def gather(self, sample: DataFrame) -> DataFrame:
        """The sample with the columns of its vectors; null where a key has none.

        The store is not shuffled.  The sample is read twice: for its different keys, which
        are stored and tell ranges, filter and frequent keys, and for the join.
        """
        keys, values = list(self.keys), [c for c in self.rows().columns if c not in self.keys]
        counts = stored(key_counts(sample, self.keys), "sample-keys")
        hot, plain = self._hot(counts), counts.select(*keys)
        if not hot:
            source = self.touched(plain).hint("merge")
            return sample.join(source, keys, "left")
        key = keys[0]
        is_hot = F.col(key).isin(hot)
        # at most HOT_KEYS rows, found by their row groups
        few = self.rows().filter(is_hot).select(F.col(key), F.struct(*values).alias("_hot"))
        source = self.touched(plain.filter(~is_hot)).select(key, F.struct(*values).alias("_cold"))
        # rows that have their vector get a key that is in no store, spread evenly
        spot = F.pmod(F.xxhash64(*sample.columns), F.lit(1 << 30))
        own = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(-F.lit(1) - spot)
        joined = (
            sample.join(F.broadcast(few), key, "left")
            .withColumn("_key", own)
            .join(source.withColumnRenamed(key, "_key").hint("merge"), "_key", "left")
            .withColumn("_found", F.coalesce("_hot", "_cold"))
        )
        return joined.select(
            *keys, *[c for c in sample.columns if c not in keys], *[F.col("_found")[v].alias(v) for v in values]
        )


def require_unique(rows: DataFrame, keys: tuple[str, ...]) -> None:
    """An error if a key is null or there twice; only the keys are read and shuffled."""
    empty = reduce(or_, [F.col(k).isNull() for k in keys])
    bad = (
        rows.select(*keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > 1) | empty)
        .head(1)
    )
    if bad:
        raise ValueError(f"vector keys must be there once and not null: {bad[0].asDict()}")
