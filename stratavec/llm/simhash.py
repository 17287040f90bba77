"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``MAX_BITS`` or fewer differing bits.  The bits
are dealt into ``m`` groups with thresholds ``t_1 .. t_m`` that sum to
``MAX_BITS - m + 1``: if every group differed by more than its threshold, the
whole would differ by more than ``MAX_BITS``.  So every link is found by probing
each group's value with all values within its threshold (a threshold of -1 is
no probe at all), and candidates are verified on the whole fingerprint.

Groups are formed from correlated bits, which makes what is left between groups
independent; correlations and bit frequencies come from all fingerprints.  For
every ``m`` the thresholds are allocated by dynamic programming on estimated
candidate counts plus the probes to be moved, and the cheapest ``m`` is used.

Equal fingerprints are one row from the start.  Fingerprints that share a probed
value are compared inside a task by a search that joins every one to a visited
one, so a group of n near copies yields n - 1 links, not n * n.  A value with more
than ``TILE`` fingerprints is cut into chunks and every pair of chunks is a task
group of its own.  Links go through connected components.

Defined cases: a null or empty text has fingerprint zero and links like any
other; documents without an id get the component of their fingerprint, and null
if no member has an id; repeated rows are documents of one fingerprint each; texts of
any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.llm.common import stored
from stratavec.llm.components import components

BITS = 64
MAX_BITS = 4
SHINGLE = 4
HASH_SEED = 42
# fingerprints of one value compared in one go; more are cut into chunks
TILE = 4096
# rows of many small values handled by one task group
GROUP_ROWS = 20_000
MAX_GROUPS_OF_BITS = 5
# cost of moving one probe against that of comparing one candidate
PROBE_COST = 200.0
# shingles whose bits are counted at once
STRETCH = 1 << 14


def fingerprint(text: str, seed: int = HASH_SEED) -> int:
    """SimHash of a text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return hash_of(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - SHINGLE + 1].tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), STRETCH):
        hashes = [
            hash_of(joined[s:e], seed)
            for s, e in zip(starts[at : at + STRETCH], stops[at : at + STRETCH])
        ]
        packed = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8)
        ones += np.unpackbits(packed.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    values = np.array([fingerprint(t or "") for t in texts.to_pylist()], dtype=np.uint64)
    return pa.array(values.view(np.int64))


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, highest bit first."""
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for all pairs of bits, how many have both set."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), STRETCH):
                bits = _bit_matrix(values[at : at + STRETCH]).astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_pydict(
            {"pair": np.arange(BITS * BITS + 1), "n": np.r_[both.ravel(), n].astype(np.int64)}
        )

    sums = (
        distinct.select("fp")
        .mapInArrow(partial, "pair long, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    out = np.zeros(BITS * BITS + 1)
    out[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def correlations(n: int, both: np.ndarray) -> np.ndarray:
    share = np.diag(both) / n
    covariance = both / n - np.outer(share, share)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return np.abs(covariance / np.outer(spread, spread))


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size; each grows by the bit most correlated with it."""
    free = set(range(BITS))
    groups = []
    for size in [BITS // m + (k < BITS % m) for k in range(m)]:
        rest = sorted(free)
        seed = max(rest, key=lambda b: (correlation[b, rest].sum(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _within(share: np.ndarray, limit: int) -> list[float]:
    """P(at most t of these bits differ in two fingerprints), t = 0 .. limit."""
    differ = 2 * share * (1 - share)
    exact = np.zeros(limit + 1)
    exact[0] = 1.0
    for p in differ:
        exact[1:] = exact[1:] * (1 - p) + exact[:-1] * p
        exact[0] *= 1 - p
    return np.cumsum(exact).tolist()


def allocated(
    groups: list[list[int]], share: np.ndarray, n: int, limit: int = MAX_BITS
) -> tuple[float, list[int]]:
    """Cheapest thresholds of these groups and their estimated cost."""
    budget = limit + 1  # shared out as t + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        chance = _within(share[group], limit)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for given in range(budget - used + 1):
                extra = 0.0
                if given:
                    probes = sum(math.comb(len(group), k) for k in range(given))
                    extra = PROBE_COST * n * probes + n * n * chance[given - 1]
                entry = (cost + extra, [*chosen, given - 1])
                if used + given not in step or entry < step[used + given]:
                    step[used + given] = entry
        best = step
    return best[budget]


def plan(n: int, both: np.ndarray, limit: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """Groups of bits to probe, with their thresholds."""
    correlation, share = correlations(n, both), np.diag(both) / n
    options = []
    for m in range(1, MAX_GROUPS_OF_BITS + 1):
        groups = grouped_bits(correlation, m)
        cost, thresholds = allocated(groups, share, n, limit)
        options.append((cost, m, list(zip(groups, thresholds))))
    return [(g, t) for g, t in min(options)[2] if t >= 0]


def _mask(bits: list[int]) -> int:
    """Signed long with these bits set, bit 0 the highest."""
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def probes(
    distinct: DataFrame, parts: list[tuple[list[int], int]], carried: tuple[str, ...] = ("fp",)
) -> DataFrame:
    """``(part, value, fp)`` of every fingerprint and every value it probes."""
    out = None
    for number, (bits, threshold) in enumerate(parts):
        flips = [_mask(list(c)) for k in range(threshold + 1) for c in combinations(bits, k)]
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        # bound here and now: the function runs before the next round
        value = F.explode(F.transform(F.lit(flips), lambda flip: own.bitwiseXOR(flip)))
        rows = distinct.select(F.lit(number).alias("part"), value.alias("value"), *carried)
        out = rows if out is None else out.union(rows)
    return out


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among these fingerprints."""
    values = fps.view(np.uint64)
    left = np.arange(len(values))
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= MAX_BITS
            if near.any():
                found = left[near]
                left = left[~near]
                links.extend((int(fps[at]), int(fps[k])) for k in found)
                queue.extend(found.tolist())
    return links


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(rows: pa.Table) -> pa.Table:
    """Links among the rows of one task group, value by value."""
    rows = rows.sort_by([("part", "ascending"), ("value", "ascending"), ("fp", "ascending")])
    part, value, fp = (rows[c].to_numpy() for c in ("part", "value", "fp"))
    border = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0)) + 1
    links: list[tuple[int, int]] = []
    for start, stop in zip(np.r_[0, border], np.r_[border, len(fp)]):
        if stop - start > 1:
            links.extend(_forest(np.unique(fp[start:stop])))
    a, b = zip(*links) if links else ((), ())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def links(distinct: DataFrame) -> DataFrame:
    """Enough links ``(a, b)`` between different fingerprints to connect all that link."""
    n, both = bit_statistics(distinct)
    if n < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    rows = stored(probes(distinct, plan(n, both)), "probes")
    return (
        task_groups(rows, ("fp",))
        .groupBy("g", "i", "j")
        .applyInArrow(lambda t: _verified(t.select(["part", "value", "fp"])), "a long, b long")
    )


def task_groups(rows: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """Probes dealt to task groups ``(g, i, j)`` of a bounded size, in which all that
    share a value meet: small values together, chunks of a large one pair by pair."""
    counts = rows.groupBy("part", "value").count()
    total = rows.count()
    hot = (
        counts.filter(F.col("count") > TILE)
        .select("part", "value", F.ceil(F.col("count") / TILE).cast("int").alias("n_chunks"))
    )
    groups = max(1, total // GROUP_ROWS)
    spot = F.pmod(F.xxhash64("part", "value"), F.lit(groups))
    placed = rows.join(hot, ["part", "value"], "left")
    small = placed.filter(F.col("n_chunks").isNull()).select(
        "part", "value", *carried, spot.alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j")
    )
    chunk = F.pmod(F.xxhash64(F.lit(1), F.col("fp")), F.col("n_chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))
    large = (
        placed.filter(F.col("n_chunks").isNotNull())
        .withColumn("c", chunk)
        .withColumn("o", other)
        .select(
            "part",
            "value",
            *carried,
            (-F.lit(1) - F.pmod(F.xxhash64("part", "value"), F.lit(1 << 40))).alias("g"),
            (F.least("c", "o") + 1).alias("i"),
            (F.greatest("c", "o") + 1).alias("j"),
        )
    )
    return small.union(large)


def components_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row."""
    marked = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(lowest, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    return components_of(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
