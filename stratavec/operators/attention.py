"""Attention between sampled queries and sampled keys of one capture.

Pairs grow with the square of the sample of an example, so they are built
inside the join and reduced in the same stage; no pair enters a shuffle unless
the caller asks for pairs.  A softmax here is over the *sampled* keys; with a
keep-all capture it is the model's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.defaults import KEY_TILE, Layout
from stratavec.functions.vectors import dot, soft_cap

# positions of a tile in which rows look for their run
RUN_TILE = 256
# windows of a block in which near pairs meet
WINDOWS_A_BLOCK = 4

# exp(EXP_STEP / 2) times any number of keys is far below the largest double
EXP_STEP = 500.0
QUERY_ROW = ("example_id", "layer", "head", "q_position")
# what a side may carry besides its vectors
_CARRIED = ("n_tokens", "run_start", "run_end")


def _carried(capture: DataFrame) -> list[str]:
    return [c for c in _CARRIED if c in capture.columns]


def query_side(capture: DataFrame, layout: Layout) -> DataFrame:
    return capture.filter(F.col("kind") == "q").select(
        "example_id",
        "layer",
        "head",
        F.floor(F.col("head") / F.lit(layout.queries_per_key)).cast("int").alias("key_head"),
        F.col("position").alias("q_position"),
        F.col("vector").alias("q_vector"),
        *[c for c in _carried(capture) if c != "n_tokens"],
    )


def key_side(capture: DataFrame) -> DataFrame:
    return capture.filter(F.col("kind") == "k").select(
        "example_id",
        "layer",
        F.col("head").alias("key_head"),
        F.col("position").alias("k_position"),
        F.col("vector").alias("k_vector"),
        *_carried(capture),
    )


def _block(position: str, size: int) -> Column:
    return F.floor(F.col(position) / F.lit(size)).cast("int")


def _with_logit(pairs: DataFrame, layout: Layout, softcap: float | None) -> DataFrame:
    logit = dot(F.col("q_vector"), F.col("k_vector"), layout.head_dim) * F.lit(
        float(layout.head_dim) ** -0.5
    )
    if softcap is not None:
        logit = soft_cap(logit, softcap)
    return pairs.withColumn("logit", logit).drop("q_vector", "k_vector", "_block")


def _with_last_tile(keys: DataFrame, queries: DataFrame, tile: int) -> DataFrame:
    """Adds ``_last``, the tile of the last query that a key's sequence may have."""
    if "n_tokens" in keys.columns:
        # known from the sequence itself: nothing has to be worked out from the queries
        last = F.floor((F.col("n_tokens") - 1) / F.lit(tile)).cast("int")
        return keys.withColumn("_last", last).drop("n_tokens")
    own = ["example_id", "layer", "key_head"]
    ends = queries.groupBy(*own).agg(F.max(_block("q_position", tile)).alias("_last"))
    return keys.join(ends, own)


def causal_pairs(
    queries: DataFrame,
    keys: DataFrame,
    layout: Layout,
    softcap: float | None = None,
    tile: int = KEY_TILE,
) -> DataFrame:
    """All pairs with key position <= query position, with their logit.

    Both sides are cut into tiles of ``tile`` positions and meet per pair of
    tiles: a query is sent to the key tiles up to its own, a key to the query
    tiles from its own up to the last one of the sequence.  A sequence
    shorter than a tile is not replicated at all, and no join key of a longer one
    holds more than the pairs of two tiles (times the query heads of a key head).

    Keys that carry ``n_tokens`` know the last tile; otherwise it is that of the
    last query, which takes another pass over the queries.

    Sides that carry ``run_start`` and ``run_end`` (see ``with_runs``) also see
    each other both ways inside a run: the tiles of the run are added to those
    that a row is sent to, so a pair still meets once.
    """
    both_ways = "run_start" in queries.columns
    own = ["example_id", "layer", "key_head"]
    q_tile, k_tile = _block("q_position", tile), _block("k_position", tile)
    first, last, seen = k_tile, F.greatest("_last", k_tile), q_tile
    if both_ways:
        first = F.least(k_tile, _block("run_start", tile))
        seen = F.greatest(q_tile, _block("run_end", tile))
    sent = (
        _with_last_tile(keys, queries, tile)
        .withColumn("_q_block", F.explode(F.sequence(first, last)))
        .withColumn("_block", k_tile)
        .drop("_last", "run_start", "run_end")
    )
    pairs = (
        queries.drop("n_tokens")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), seen)))
        .withColumn("_q_block", q_tile)
        .join(sent, [*own, "_block", "_q_block"])
        .drop("_q_block")
    )
    visible = F.col("k_position") <= F.col("q_position")
    if both_ways:
        visible = visible | F.col("k_position").between(F.col("run_start"), F.col("run_end"))
        pairs = pairs.filter(F.coalesce(visible, F.lit(False))).drop("run_start", "run_end")
        return _with_logit(pairs, layout, softcap)
    return _with_logit(pairs.filter(visible), layout, softcap)


def with_runs(side: DataFrame, spans: DataFrame, position: str, tile: int = RUN_TILE) -> DataFrame:
    """Adds the run that a row lies in, null outside: an interval join.

    ``spans(example_id, run_start, run_end)`` are disjoint within an example.  A
    span is sent to the tiles it covers and a row to its own, so they meet by an
    equal key and each row finds at most one span.
    """
    covered = F.sequence(_block("run_start", tile), _block("run_end", tile))
    sent = spans.select("example_id", "run_start", "run_end", F.explode(covered).alias("_tile"))
    rows = side.withColumn("_tile", _block(position, tile))
    inside = (
        (rows["example_id"] == sent["example_id"])
        & (rows["_tile"] == sent["_tile"])
        & rows[position].between(sent["run_start"], sent["run_end"])
    )
    return rows.join(sent, inside, "left").select(
        *[rows[c] for c in side.columns], sent["run_start"], sent["run_end"]
    )


def window_pairs(
    queries: DataFrame,
    keys: DataFrame,
    layout: Layout,
    window: int,
    bidirectional: bool = False,
    softcap: float | None = None,
) -> DataFrame:
    """Pairs closer than ``window``: a band join on blocks of ``WINDOWS_A_BLOCK`` windows.

    A key is sent to the blocks that its window reaches, mostly just its own; each query
    has one block, so no pair is doubled.
    Sides that carry runs (see ``with_runs``) also see each other inside a run:
    a key is sent to the blocks of its run as well.
    """
    both_ways = "run_start" in queries.columns
    size = WINDOWS_A_BLOCK * window
    at = lambda place: F.floor(place / F.lit(size)).cast("int")
    place = F.col("k_position")
    reach = F.sequence(at(place - (window - 1) if bidirectional else place), at(place + (window - 1)))
    if both_ways:
        run = F.sequence(_block("run_start", size), _block("run_end", size))
        reach = F.when(F.col("run_start").isNull(), reach).otherwise(F.array_union(reach, run))
    pairs = queries.drop("n_tokens").withColumn("_block", _block("q_position", size)).join(
        keys.withColumn("_block", F.explode(reach)).drop("n_tokens", "run_start", "run_end"),
        ["example_id", "layer", "key_head", "_block"],
    )
    distance = F.col("q_position") - F.col("k_position")
    if bidirectional:
        near = F.abs(distance) < window
    else:
        near = (distance >= 0) & (distance < window)
    if both_ways:
        near = F.coalesce(
            near | F.col("k_position").between(F.col("run_start"), F.col("run_end")), F.lit(False)
        )
    return _with_logit(pairs.filter(near).drop("run_start", "run_end"), layout, softcap)


def logit_rows(pairs: DataFrame) -> DataFrame:
    """Per query row: number of visible keys, largest logit and logit sum."""
    return pairs.groupBy(*QUERY_ROW).agg(
        F.count("*").alias("n_keys"),
        F.max("logit").alias("max_logit"),
        F.min("logit").alias("min_logit"),
        F.sum("logit").alias("sum_logit"),
    )


def visible_rows(pairs: DataFrame) -> DataFrame:
    """Per query row: number of visible keys, the first and the nearest of them."""
    return pairs.groupBy(*QUERY_ROW).agg(
        F.count("*").alias("n_keys"),
        F.min("k_position").alias("first_key"),
        F.max("k_position").alias("nearest_key"),
    )


def softmax_terms(pairs: DataFrame) -> DataFrame:
    """Per query row: the largest logit ``shift``, ``n_keys``, and the sums of
    exp(logit - shift) and of logit * exp(logit - shift).

    The shift is known only after all pairs of a row were seen.  To need no
    second pass, exponentials are summed relative to the nearest multiple of
    ``EXP_STEP``, which cannot overflow, and the few steps of a row (one, unless
    its logits lie hundreds apart) are brought to the common shift at the end.
    """
    step = F.rint(F.col("logit") / F.lit(EXP_STEP)) * F.lit(EXP_STEP)
    weight = F.exp(F.col("logit") - F.col("_step"))
    steps = (
        pairs.withColumn("_step", step)
        .groupBy(*QUERY_ROW, "_step")
        .agg(
            F.count("*").alias("n"),
            F.max("logit").alias("top"),
            F.sum(weight).alias("total"),
            F.sum(weight * F.col("logit")).alias("moment"),
        )
    )
    rows = steps.groupBy(*QUERY_ROW).agg(
        F.max("top").alias("shift"),
        F.sum("n").alias("n_keys"),
        F.collect_list(F.struct("_step", "total", "moment")).alias("_parts"),
    )

    def shifted(field: str) -> Column:
        return F.aggregate(
            "_parts",
            F.lit(0.0),
            lambda total, part: total + part[field] * F.exp(part["_step"] - F.col("shift")),
        )

    return rows.select(
        *QUERY_ROW,
        "shift",
        "n_keys",
        shifted("total").alias("total"),
        shifted("moment").alias("weighted_logit"),
    )


def softmax_rows(
    queries: DataFrame, keys: DataFrame, layout: Layout, softcap: float | None = None
) -> DataFrame:
    """Per query row: largest softmax weight, log-sum-exp and entropy."""
    terms = softmax_terms(causal_pairs(queries, keys, layout, softcap))
    lse = F.col("shift") + F.log("total")
    return terms.select(
        *QUERY_ROW,
        "n_keys",
        (F.lit(1.0) / F.col("total")).alias("max_weight"),
        lse.alias("log_sum_exp"),
        (lse - F.col("weighted_logit") / F.col("total")).alias("entropy"),
    )


def softmax_weights(
    queries: DataFrame, keys: DataFrame, layout: Layout, softcap: float | None = None
) -> DataFrame:
    """Every causal pair with its softmax weight.

    The pairs are built a second time with the figures of their row at hand,
    which moves one row per query instead of shuffling and sorting all pairs.
    """
    terms = softmax_terms(causal_pairs(queries, keys, layout, softcap))
    shifted = queries.join(terms.select(*QUERY_ROW, "shift", "total"), list(QUERY_ROW))
    pairs = causal_pairs(shifted, keys, layout, softcap)
    weight = F.exp(F.col("logit") - F.col("shift")) / F.col("total")
    return pairs.withColumn("weight", weight).drop("shift", "total")
