"""One document of every group of near copies: the pipeline's stage on SimHash.

Fingerprints and the pigeonhole search are those of ``simhash``, with a wider threshold:
``SURE`` bits, as there, are a link; up to ``NEAR`` bits are one if a second fingerprint,
of other hashes of the same shingles, differs in at most ``SECOND`` bits.  Both distances
grow with the share of shingles that differ, so texts that merely happen to be close in
one are far apart in the other.

Decisions are made row by row, on the id and a hash of the text.  The row that stays is the
one with the smallest id, rows without an id last, then by the hash of the text.

Defined cases: null and empty texts are near copies of each other; rows of one id with
different texts are judged by their texts; of rows equal in id and text one stays, and of
copies without an id one stays; other columns have no influence, whatever their names; an
empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.llm import simhash
from stratavec.llm.common import stored
from stratavec.llm.components import components

SURE, NEAR, SECOND = simhash.MAX_BITS, 9, 11
SECOND_SEED = 43
# rows of a group compared with all others of it at once
ROWS_AT_ONCE = 512
CARRIED = ("fp", "other", "node")


@F.arrow_udf(T.LongType())
def second_fingerprints(texts: pa.Array) -> pa.Array:
    values = [simhash.fingerprint(t or "", SECOND_SEED) for t in texts.to_pylist()]
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _linked(fp: np.ndarray, other: np.ndarray, at, rest) -> np.ndarray:
    """Which of ``rest`` link with ``at``, both index arrays or numbers."""
    first = np.bitwise_count(fp[at] ^ fp[rest])
    second = np.bitwise_count(other[at] ^ other[rest])
    return (first <= SURE) | ((first <= NEAR) & (second <= SECOND))


def forest(fp: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among these rows, as pairs of places."""
    n = len(fp)
    near = np.zeros(n, dtype=bool)
    everything = np.arange(n)
    for start in range(0, n, ROWS_AT_ONCE):
        rows = everything[start : start + ROWS_AT_ONCE]
        found = np.bitwise_count(fp[rows, None] ^ fp[None, :]) <= NEAR
        found[np.arange(len(rows)), rows] = False
        near[rows] = found.any(axis=1)
    # only rows with a neighbour are searched one by one, each once
    left = np.flatnonzero(near)
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _linked(fp, other, at, left)
            if hit.any():
                found, left = left[hit].tolist(), left[~hit]
                links += [(at, k) for k in found]
                queue += found
    return links


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(rows: pa.Table) -> pa.Table:
    """Links among the rows of one task group, value by value."""
    rows = rows.sort_by([("part", "ascending"), ("value", "ascending"), ("node", "ascending")])
    part, value, node = (rows[c].to_numpy() for c in ("part", "value", "node"))
    fp, other = (rows[c].to_numpy().view(np.uint64) for c in ("fp", "other"))
    border = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0)) + 1
    pairs: list[tuple[int, int]] = []
    for start, stop in zip(np.r_[0, border], np.r_[border, len(node)]):
        if stop - start > 1:
            found = forest(fp[start:stop], other[start:stop])
            pairs += [(int(node[start + i]), int(node[start + k])) for i, k in found]
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def links(distinct: DataFrame) -> DataFrame:
    """Enough links between different nodes ``(fp, other, node)`` to connect all that link."""
    n, both = simhash.bit_statistics(distinct)
    if n < 2:
        return distinct.select(F.col("node").alias("a"), F.col("node").alias("b")).filter("false")
    rows = stored(simhash.probes(distinct, simhash.plan(n, both, NEAR), CARRIED), "near-probes")
    return (
        simhash.task_groups(rows, CARRIED)
        .groupBy("g", "i", "j")
        .applyInArrow(lambda t: _verified(t.select(["part", "value", *CARRIED])), "a long, b long")
    )


def groups_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, hash, root)`` of every row: hash of its text, and name of its group."""
    marked = stored(
        docs.select(
            "doc_id",
            F.xxhash64("text").alias("hash"),
            simhash.fingerprints(F.col("text")).alias("fp"),
            second_fingerprints(F.col("text")).alias("other"),
        ).withColumn("node", F.xxhash64("fp", "other")),
        "near-fingerprints",
    )
    distinct = stored(marked.select("fp", "other", "node").distinct(), "near-distinct")
    roots = components(links(distinct))
    joined = marked.join(roots, "node", "left")
    return joined.select("doc_id", "hash", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of every group of near copies one row."""
    groups = stored(groups_of(docs.select("doc_id", "text")), "near-groups")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    stay = groups.groupBy("root").agg(F.min(row).alias("stay")).select(
        F.col("stay.doc_id").alias("_id"), F.col("stay.hash").alias("_text")
    )
    # the row travels as a struct, so none of its columns can clash with ours
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    own, text = F.col("_row").getField("doc_id"), F.xxhash64(F.col("_row").getField("text"))
    kept = whole.join(stay, own.eqNullSafe(F.col("_id")) & (text == F.col("_text")), "left_semi")
    repeated = stored(groups.groupBy("doc_id", "hash").count().filter("count > 1"), "near-repeats")
    if not repeated.head(1):
        return kept.select("_row.*")
    twice = repeated.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_text"))
    same = own.eqNullSafe(F.col("_id")) & (text == F.col("_text"))
    once = kept.join(twice, same, "left_anti")
    first = (
        kept.join(twice, same, "left_semi")
        .withColumns({"_own": own, "_text": text})
        .dropDuplicates(["_own", "_text"])
    )
    return once.select("_row.*").unionByName(first.select("_row.*"))
