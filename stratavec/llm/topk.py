"""Exact top-k by inner product with block-at-a-time pruning.

Ids are cut into ranges of ``BLOCK`` ids.  A block keeps its vectors (its forward
index) and, per dimension, the largest and the smallest value.  For a query the
sum over dimensions of the larger of ``q * max`` and ``q * min`` bounds every score
in the block.  Blocks are visited by falling bound; once the next bound is below
the k-th best score so far, no later block can hold a result.  Blocks whose bound
equals it are still scored, because of ties.

Blocks travel in chunks and queries in groups of bounded size; a task has one
chunk and one group, and only k rows per query and chunk leave it.  A query first
searches one chunk, and its k-th score there is the threshold that it starts from
in all others.

Scores are exact integers.  Defined cases: rows without an id, and vectors that
are null or hold null or non-finite components, take no part; of rows with one
id the smallest vector counts; shorter vectors are filled up with zeros; a score
that does not fit a long is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.llm.common import stored

SCALE = 1024
K = 10
QUERY_STEP = 100
BLOCK = 64
BLOCKS_PER_CHUNK = 256
GROUP_QUERIES = 512


def quantised(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with whole-numbered components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(F.coalesce(fine, F.lit(False)))
        .groupBy("vec_id")
        .agg(F.min(whole).alias("v"))
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of ``a`` with the rows of ``b``."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    product = a.astype(object) @ b.T.astype(object)
    if product.size and max(abs(product.max()), abs(product.min())) >= 2**63:
        raise OverflowError("a score does not fit a long")
    return product.astype(np.int64)


def _bounds(query: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima: queries by blocks, as doubles rounded up."""
    up, down = np.maximum(query, 0).astype(float), np.minimum(query, 0).astype(float)
    bound = up @ high.T.astype(float) + down @ low.T.astype(float)
    return bound + np.abs(bound) * 1e-9


class _Blocks:
    """Forward index of the vectors of a task, by ranges of ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        edge = np.flatnonzero(np.diff(self.ids // BLOCK)) + 1
        self.start = np.r_[0, edge][: len(ids)]
        self.stop = np.r_[edge, len(ids)][: len(self.start)]
        self.high = np.maximum.reduceat(self.vectors, self.start, axis=0)
        self.low = np.minimum.reduceat(self.vectors, self.start, axis=0)

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, least: float, k: int):
        """(ids, scores) of the best ``k`` that are not below ``least``."""
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, take = 0, 2
        while at < len(order) and bound[order[at]] >= least:
            chosen = order[at : at + take]
            chosen = chosen[bound[chosen] >= least]
            rows = np.concatenate([np.arange(self.start[b], self.stop[b]) for b in chosen])
            rows = rows[self.ids[rows] != query_id]
            ids = np.r_[ids, self.ids[rows]]
            scores = np.r_[scores, _exact(self.vectors[rows], query[None, :])[:, 0]]
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                least = max(least, scores[-1])
            at, take = at + take, take * 2
        near = scores >= least if len(ids) == k else slice(None)
        return ids[near], scores[near]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "query_id long, vec_id long, score long"


def _searched(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of one chunk for the queries ``(chunk, g, query_id, v, least)``."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return _FOUND.empty_table()
        width = max(max(map(len, t["v"].to_pylist())) for t in (rows, asked))
        index = _Blocks(rows["vec_id"].to_numpy(), _matrix(rows["v"], width))
        vectors = _matrix(asked["v"], width)
        bounds = _bounds(vectors, index.high, index.low)
        out = []
        for i, (query_id, least) in enumerate(
            zip(asked["query_id"].to_pylist(), asked["least"].to_pylist())
        ):
            ids, scores = index.search(query_id, vectors[i], bounds[i], least, k)
            out.append((np.full(len(ids), query_id, np.int64), ids, scores))
        return pa.Table.from_arrays(
            [pa.array(np.concatenate(c)) for c in zip(*out)], schema=_FOUND
        )

    keys = ["chunk", "g"]
    return blocks.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, _FOUND_DDL)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best other vectors of each query.

    ``vectors(vec_id, v)`` and ``queries(query_id, v)`` as made by ``quantised``.
    """
    block = F.floor(F.col("vec_id") / BLOCK)
    rows = stored(vectors.withColumn("block", block), "vectors")
    asked = stored(queries, "queries")
    n_chunks = max(1, -(-rows.select("block").distinct().count() // BLOCKS_PER_CHUNK))
    n_groups = max(1, -(-asked.count() // GROUP_QUERIES))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunk = F.pmod(F.xxhash64("block"), F.lit(n_chunks)).cast("int")
    # every chunk meets every group of queries
    placed = rows.select(chunk.alias("chunk"), numbers(n_groups).alias("g"), "vec_id", "v")
    grouped = asked.select(
        F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).cast("int").alias("g"),
        F.pmod(F.xxhash64(F.lit(1), F.col("query_id")), F.lit(n_chunks)).cast("int").alias("home"),
        "query_id",
        "v",
    )
    at_home = grouped.withColumn("chunk", F.col("home")).withColumn("least", F.lit(-float("inf")))
    found = stored(_searched(placed, at_home, k), "topk-home")
    if n_chunks > 1:
        least = (
            found.groupBy("query_id")
            .agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
            .filter(F.col("n") == k)
            .select("query_id", "least")
        )
        away = (
            grouped.join(least, "query_id", "left")
            .withColumn("least", F.coalesce("least", F.lit(-float("inf"))))
            .withColumn("chunk", numbers(n_chunks))
            .filter("chunk != home")
        )
        found = found.union(_searched(placed, away, k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """The search with every vector whose id is divisible by ``step`` as a query."""
    whole = quantised(vectors)
    queries = whole.filter(F.col("vec_id") % step == 0).withColumnRenamed("vec_id", "query_id")
    return top_k(whole, queries, k)


ORACLE = """
WITH fine AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), component AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM fine
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM component q JOIN component c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY ALL
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER
           AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""
