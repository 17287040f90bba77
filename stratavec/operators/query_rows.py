"""Figures of every sampled query over the sampled keys that it sees, in one pass.

A capture is read once, queries and keys together, with the vectors of all heads in one
row.  Queries are cut into tiles of positions; a key is sent to the tiles from its own up
to the last one of its sequence.  Within a tile rows come sorted, queries first, and keys
pass by in batches of arrays, so a task holds the queries of one tile and one batch of
keys however long the sequence is.  Figures of a query are complete when its tile is:
neither pairs nor parts of figures enter a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.defaults import KEY_TILE, Layout

# pairs of positions whose logits are worked out at once
PAIRS_AT_ONCE = 1 << 15
_PLACE_BITS = 32
_COLUMNS = "example_id bigint, layer int, head int, q_position int, n_keys bigint, "
_LOGITS = "max_logit double, min_logit double, sum_logit double"
_SOFTMAX = ", total double, weighted_logit double"


def tiles_of_rows(encoded: DataFrame, tile: int) -> DataFrame:
    """Rows with ``_tile``, the tile of queries that they are sent to, in which they lie
    together, queries first."""
    at = lambda place: F.floor(place / F.lit(tile)).cast("int")
    own, last = at(F.col("position")), at(F.col("n_tokens") - 1)
    tiles = F.when(F.col("kind") == "q", F.array(own)).otherwise(
        F.sequence(own, F.greatest(own, last))
    )
    together = ("example_id", "layer", "_tile")
    return (
        encoded.filter(F.col("example_id").isNotNull())
        .select(
            "example_id",
            "layer",
            F.explode(tiles).alias("_tile"),
            (F.col("kind") == "k").alias("_is_key"),
            "position",
            "flat",
        )
        .repartition(*together)
        .sortWithinPartitions(*together, "_is_key", "position")
    )


def _entries(flat: pa.Array, rows: np.ndarray, n_heads: int, dim: int) -> np.ndarray:
    """Vectors of some rows as (row, head, entry); another width or a null is an error."""
    starts = flat.offsets.to_numpy()
    sizes = np.diff(starts)[rows]
    if flat.null_count or flat.values.null_count:
        raise ValueError("null in a vector")
    if (sizes != n_heads * dim).any():
        wrong = sizes[sizes != n_heads * dim][0]
        raise ValueError(f"flat vector of {n_heads * dim} entries expected, got {wrong}")
    places = starts[:-1][rows][:, None] + np.arange(n_heads * dim)
    return flat.values.to_numpy(zero_copy_only=False)[places].reshape(-1, n_heads, dim)


def _by_entry(vectors: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(vectors.transpose(2, 0, 1), dtype=np.float64)


class _Figures:
    """Figures of some queries: ``place`` by query, the others by query and head."""

    def __init__(self, place, n, top, low, summed, total=None, moment=None):
        self.place, self.n, self.top, self.low, self.summed = place, n, top, low, summed
        self.total, self.moment = total, moment

    @classmethod
    def of_pairs(cls, place, seen, logit, softmax):
        """``seen`` neighbouring rows of ``logit`` belong to each place."""
        first = np.cumsum(seen) - seen
        top = np.maximum.reduceat(logit, first)
        out = cls(place, seen, top, np.fmin.reduceat(logit, first), np.add.reduceat(logit, first))
        if softmax:
            weight = np.exp(logit - top.repeat(seen, axis=0))
            out.total = np.add.reduceat(weight, first)
            out.moment = np.add.reduceat(weight * logit, first)
        return out

    @classmethod
    def joined(cls, parts: list[_Figures]) -> _Figures:
        """One row for each place, in their order."""
        fields = [
            None if parts[0].__dict__[f] is None else np.concatenate([p.__dict__[f] for p in parts])
            for f in ("place", "n", "top", "low", "summed", "total", "moment")
        ]
        order = np.argsort(fields[0], kind="stable")
        place, n, top, low, summed, total, moment = [None if f is None else f[order] for f in fields]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        if len(first) == len(place):
            return cls(place, n, top, low, summed, total, moment)
        highest = np.maximum.reduceat(top, first)
        if total is not None:
            shift = np.exp(top - highest.repeat(np.diff(first, append=len(place)), axis=0))
            total, moment = (np.add.reduceat(x * shift, first) for x in (total, moment))
        return cls(
            place[first],
            np.add.reduceat(n, first),
            highest,
            np.fmin.reduceat(low, first),
            np.add.reduceat(summed, first),
            total,
            moment,
        )

    def taken(self, rows) -> _Figures:
        return _Figures(*[None if f is None else f[rows] for f in self.__dict__.values()])


def _over_batches(
    layout: Layout, softcap: float | None, softmax: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dim, n_heads = layout.head_dim, layout.q_heads
    scale = float(dim) ** -0.5
    low_bits = (1 << _PLACE_BITS) - 1

    def logits(queries, keys, of_query, of_key):
        out = np.zeros((len(of_query), n_heads))
        # entry by entry: the order in which a sum of products is written out
        for q, k in zip(queries, keys):
            out += q.take(of_query, axis=0) * k.take(of_key, axis=0)
        out *= scale
        return out if softcap is None else softcap * np.tanh(out / softcap)

    def figures(places, queries, key_places, keys) -> Iterator[_Figures]:
        """Of every query that sees a key; places are ascending numbers of (group, position)."""
        start = np.searchsorted(key_places, places >> _PLACE_BITS << _PLACE_BITS)
        seen = np.searchsorted(key_places, places, side="right") - start
        ends = np.cumsum(seen)
        cuts = np.searchsorted(ends, np.arange(PAIRS_AT_ONCE, ends[-1], PAIRS_AT_ONCE), side="right")
        bounds = np.unique(np.concatenate([[0], cuts, [len(places)]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            some = a + np.flatnonzero(seen[a:b])
            if len(some):
                n = seen[some]
                of_query = some.repeat(n)
                of_key = np.arange(n.sum()) - (np.cumsum(n) - n - start[some]).repeat(n)
                found = logits(queries, keys, of_query, of_key)
                yield _Figures.of_pairs(places[some], n, found, softmax)

    def told(done: _Figures, ids, layers) -> pa.RecordBatch:
        group = done.place >> _PLACE_BITS
        each = lambda values: values.repeat(n_heads)
        arrays = [
            each(ids[group]),
            each(layers[group]),
            np.tile(np.arange(n_heads, dtype=np.int32), len(group)),
            each((done.place & low_bits).astype(np.int32)),
            each(done.n.astype(np.int64)),
            *[x.ravel() for x in (done.top, done.low, done.summed, done.total, done.moment) if x is not None],
        ]
        names = [c.split()[0] for c in (_COLUMNS + _LOGITS + _SOFTMAX * softmax).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the tile that goes on: its name, its queries, and what they have seen
        name, places, queries, open_ = None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, layers, tiles, is_key, positions = [
                batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)
            ]
            flat = batch.column(5)
            change = np.ones(len(ids), dtype=bool)
            change[1:] = (np.diff(ids) != 0) | (np.diff(layers) != 0) | (np.diff(tiles) != 0)
            change[0] = name != (ids[0], layers[0], tiles[0])
            # group 0 is the one that goes on
            group = np.cumsum(change)
            own = (group << _PLACE_BITS) + positions
            first = np.flatnonzero(change)
            before = name or (0, 0, 0)
            group_ids, group_layers = np.r_[before[0], ids[first]], np.r_[before[1], layers[first]]

            asked, told_of = np.flatnonzero(~is_key), np.flatnonzero(is_key)
            new_queries = _entries(flat, asked, n_heads, dim)
            keys = _entries(flat, told_of, layout.k_heads, dim)
            if name is not None:
                places = np.concatenate([places, own[asked]])
                queries = np.concatenate([queries, new_queries])
            else:
                places, queries = own[asked], new_queries
            if len(places) and len(told_of):
                spread = keys.repeat(layout.queries_per_key, axis=1)
                open_.extend(figures(places, _by_entry(queries), own[told_of], _by_entry(spread)))
            if open_:
                found = _Figures.joined(open_)
                done = found.place >> _PLACE_BITS < group[-1]
                if done.any():
                    yield told(found.taken(done), group_ids, group_layers.astype(np.int32))
                found = found.taken(~done)
                found.place &= low_bits
                open_ = [found] if len(found.place) else []
            goes_on = places >> _PLACE_BITS == group[-1]
            places, queries = places[goes_on] & low_bits, queries[goes_on]
            name = (ids[-1], layers[-1], tiles[-1])
        if open_:
            yield told(open_[0], np.array([name[0]]), np.array([name[1]], dtype=np.int32))

    return over


def query_figures(
    encoded: DataFrame,
    layout: Layout,
    softcap: float | None = None,
    softmax: bool = False,
    tile: int = KEY_TILE,
) -> DataFrame:
    """Per query row and head: number of keys at or before it, largest, least and summed
    logit; with ``softmax`` also the sums of exp(logit - max_logit) (``total``) and of
    logit * exp(logit - max_logit).

    ``encoded`` holds ``(example_id, layer, kind, position, n_tokens, flat)``, the vectors
    of all heads of a kind in one row.  A query without a key is left out.
    """
    schema = _COLUMNS + _LOGITS + (_SOFTMAX if softmax else "")
    return tiles_of_rows(encoded, tile).mapInArrow(_over_batches(layout, softcap, softmax), schema)


def softmax_rows(
    encoded: DataFrame, layout: Layout, softcap: float | None = None, tile: int = KEY_TILE
) -> DataFrame:
    """Per query row: largest softmax weight, log-sum-exp and entropy."""
    rows = query_figures(encoded, layout, softcap, True, tile)
    lse = F.col("max_logit") + F.log("total")
    return rows.select(
        "example_id",
        "layer",
        "head",
        "q_position",
        "n_keys",
        (F.lit(1.0) / F.col("total")).alias("max_weight"),
        lse.alias("log_sum_exp"),
        (lse - F.col("weighted_logit") / F.col("total")).alias("entropy"),
    )
