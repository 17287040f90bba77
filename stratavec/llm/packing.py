"""Packing of token sequences by bin completion.

Documents are cut and measured where they are read.  How many pieces have each
length is all the packing needs: at most ``CAPACITY`` numbers, whatever the
corpus.  On these the driver plans in *patterns* -- one filling of a sequence,
used for as many sequences as its lengths last:

* best fit in decreasing length gives the first solution; where a bound says that there
  may be better ones, so do completions of the fullest kind with some of the longest
  pieces set aside, which then share sequences among themselves;
* a branch-and-bound search completes a bin around the largest length left.  It tries
  the fullest filling there is, found over all reachable sums, and other fillings that
  no filling dominates, and gives up a branch once its waste can no longer beat the best
  solution;
* it ends when the solution meets a lower bound or after ``SEARCH_NODES`` nodes, with the
  best solution found.  The bound counts tokens, and what pieces too long for each other
  leave unused.

Pieces of one length are interchangeable, so a piece finds its sequence from its
number among those of its length.  The numbers come from per-bucket counts and a
window inside each bucket, so a length with a third of all pieces is spread.

Defined cases: a null or empty text is its end token alone, one piece; repeated
rows are packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratavec.llm.bpe_prefix import byte_of_char, read_vocabulary
from stratavec.llm.common import stored
from stratavec.llm.token_units import LETTERS, UnitMemory

CAPACITY = 2048
END_TOKEN = 0
SEARCH_NODES = 4000
# shares of the pieces that are set aside, longest first, and rounds around the best one
SET_ASIDE = (0.0, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3)
SET_ASIDE_ROUNDS = 3
# fillings tried around one largest length, and items a filling is searched to
BRANCHES = 4
FILL_STEPS = 600
# pieces of one length that are numbered by one task
BUCKET_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str) -> tuple[UnitMemory, dict[str, bytes]]:
    """Encoder by the tokenizer's own pre-tokenizer and a merge loop over ranks."""
    model = json.loads(vocabulary)
    byte_of = byte_of_char()
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in token): number
        for token, number in model["model"]["vocab"].items()
        if token not in added
    }
    merge = tiktoken.Encoding(
        "pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary
    split = Tokenizer.from_str(vocabulary).pre_tokenizer.pre_tokenize_str

    @lru_cache(maxsize=200_000)
    def piece(text: str) -> bytes:
        return array("I", merge(text)).tobytes()

    def unit(text: str) -> bytes:
        if LETTERS.fullmatch(text):
            return array("I", merge(text)).tobytes()
        return b"".join([piece(text[a:b]) for _, (a, b) in split(text)])

    special = {t: array("I", [i]).tobytes() for t, i in added.items()}
    return UnitMemory(unit), special


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None) -> DataFrame:
    """One row per piece of a document."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    end = np.array([END_TOKEN], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, special = _tokenizer(sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                packed = memory.packed(text or "", special) + end
                for number, (start, length) in enumerate(cuts(len(packed) // 4, capacity)):
                    crc = zlib.crc32(packed[4 * start : 4 * (start + length)])
                    rows.append((doc_id, number, start, length, crc))
            columns = zip(*rows) if rows else [[] for _ in _PIECES]
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, _PIECES)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, _PIECES_DDL
    )


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over counts of lengths; bins of equal content are one entry."""
    bins: dict[tuple[int, Pattern], int] = {}
    done: list[tuple[Pattern, int]] = []

    def add(room: int, pattern: Pattern, number: int) -> None:
        if number and room:
            bins[room, pattern] = bins.get((room, pattern), 0) + number
        elif number:
            done.append((pattern, number))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for key in sorted(k for k in bins if k[0] >= length):
            if not left:
                break
            room, pattern = key
            number, each = bins.pop(key), room // length
            full = min(number, left // each)
            add(room - each * length, (*pattern, (length, each)), full)
            left, number = left - full * each, number - full
            if number and left:
                add(room - left * length, (*pattern, (length, left)), 1)
                left, number = 0, number - 1
            add(room, pattern, number)
        each = capacity // length
        add(capacity - each * length, ((length, each),), left // each)
        if left % each:
            add(capacity - left % each * length, ((length, left % each),), 1)
    return done + [(pattern, number) for (_, pattern), number in bins.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and, for every threshold, by the
    pieces longer than half, each of which has a sequence of its own."""
    lengths = sorted((n for n in counts if counts[n]), reverse=True)
    total = sum(n * counts[n] for n in lengths)
    best = -(-total // capacity)
    for small in [0, *[n for n in lengths if 2 * n <= capacity]]:
        alone = sum(counts[n] for n in lengths if n > capacity - small)
        large = [n for n in lengths if capacity < 2 * n and n <= capacity - small]
        number = sum(counts[n] for n in large)
        room = number * capacity - sum(n * counts[n] for n in large)
        rest = sum(n * counts[n] for n in lengths if small <= n and 2 * n <= capacity)
        best = max(best, alone + number + max(0, -(-(rest - room) // capacity)))
    return best


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> Pattern:
    """The filling that leaves least of ``room``, of those the one with the longest items.

    Reachable sums are the bits of one number per length, shortest lengths first; the
    filling is read off from the longest length back.
    """
    fitting = [n for n in lengths if n <= room]  # longest first
    mask, reach = (1 << (room + 1)) - 1, [1]
    for n in reversed(fitting):
        sums = reach[-1]
        for _ in range(min(counts[n], room // n)):
            more = (sums | sums << n) & mask
            if more == sums:
                break
            sums = more
        reach.append(sums)
    left, chosen = reach[-1].bit_length() - 1, []
    for k, n in enumerate(fitting):
        below = reach[len(fitting) - k - 1]
        for use in range(min(counts[n], left // n), 0, -1):
            if below >> (left - use * n) & 1:
                chosen.append((n, use))
                left -= use * n
                break
    return tuple(chosen)


def fillings(room: int, counts: dict[int, int], lengths: list[int]) -> list[Pattern]:
    """Undominated ways to fill ``room``, the fullest first.

    A filling is given up if one length more still fits into it, or if another
    uses the same items but a longer one in the place of one of them.
    """
    first = fullest(room, counts, lengths)
    best: list[tuple[int, int, Pattern]] = [(room - sum(n * k for n, k in first), len(first), first)]
    steps = 0
    stack: list[tuple[int, int, Pattern]] = [(0, room, ())]
    smallest = lengths[-1] if lengths else room + 1
    while stack and steps < FILL_STEPS:
        steps += 1
        at, left, chosen = stack.pop()
        while at < len(lengths) and lengths[at] > left:
            at += 1
        if left < smallest or at == len(lengths):
            best.append((left, len(chosen), chosen))
            if left == 0 and sum(b[0] == 0 for b in best) >= BRANCHES:
                break
            continue
        length = lengths[at]
        most = min(counts[length], left // length)
        if at + 1 < len(lengths):
            stack.append((at + 1, left, chosen))  # without this length
        for use in range(1, most + 1):
            stack.append((at + 1, left - use * length, (*chosen, (length, use))))
    best.sort(key=lambda b: (b[0], b[1], tuple(-n for n, _ in b[2])))
    kept: list[Pattern] = []
    for _, _, pattern in best:
        if pattern not in kept and not any(_dominates(other, pattern) for other in kept):
            kept.append(pattern)
            if len(kept) == BRANCHES:
                break
    return kept


def fullest_completion(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Bins around the largest length left, each filled as far as it goes."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        largest = max(left)
        after = {**left, largest: left[largest] - 1}
        lengths = sorted((n for n in after if after[n]), reverse=True)
        items = {largest: 1}
        for n, k in fullest(capacity - largest, after, lengths):
            items[n] = items.get(n, 0) + k
        times = min(left[n] // k for n, k in items.items())
        for n, k in items.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        out.append((tuple(sorted(items.items(), reverse=True)), times))
    return out


def set_aside(counts: dict[int, int], capacity: int, share: float) -> list[tuple[Pattern, int]]:
    """The longest pieces among themselves by best fit, the others by completion."""
    wanted, long, rest = round(share * sum(counts.values())), {}, dict(counts)
    for n in sorted(counts, reverse=True):
        long[n] = min(wanted, counts[n])
        rest[n] -= long[n]
        wanted -= long[n]
    long = {n: c for n, c in long.items() if c}
    return best_fit(long, capacity) + fullest_completion(rest, capacity)


def first_solution(counts: dict[int, int], capacity: int, bound: int) -> list[tuple[Pattern, int]]:
    """The best of best fit and of completions with some pieces set aside."""
    size = lambda plan: sum(k for _, k in plan)
    best, at = best_fit(counts, capacity), 0.0
    shares, step = list(SET_ASIDE), 0.02
    for _ in range(SET_ASIDE_ROUNDS):
        for share in shares:
            if size(best) <= bound:
                return best
            plan = set_aside(counts, capacity, share)
            if size(plan) < size(best):
                best, at = plan, share
        step /= 2
        shares = [s for s in (at - step, at + step) if 0 < s < 1]
    return best


def _dominates(better: Pattern, worse: Pattern) -> bool:
    """Each item of ``worse`` has its own item in ``better`` that is as long."""
    a = [n for n, k in better for _ in range(k)]
    b = [n for n, k in worse for _ in range(k)]
    return len(b) <= len(a) and all(y <= x for x, y in zip(a, b))


def bin_completion(
    counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES
) -> list[tuple[Pattern, int]]:
    """Patterns with the number of sequences that use them."""
    counts = {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in counts.items())
    bound = lower_bound(counts, capacity)
    best = first_solution(counts, capacity, bound)
    best_bins = sum(k for _, k in best)
    left, used = dict(counts), []  # what is not packed yet; patterns in use
    number = waste = 0

    def change(pattern: Pattern, times: int, sign: int) -> None:
        nonlocal number, waste
        for n, k in pattern:
            left[n] = left.get(n, 0) - sign * times * k
            if not left[n]:
                del left[n]
        number += sign * times
        waste += sign * times * (capacity - sum(n * k for n, k in pattern))

    # one list of untried patterns per depth, the best one last
    open_nodes = [_completions(left, capacity)] if left else []
    while open_nodes and nodes and best_bins > bound:
        if not open_nodes[-1]:
            open_nodes.pop()
            if used:
                change(*used.pop(), -1)
            continue
        nodes -= 1
        pattern = open_nodes[-1].pop()
        times = min(left[n] // k for n, k in pattern)
        change(pattern, times, 1)
        used.append((pattern, times))
        if left and waste <= (best_bins - 1) * capacity - total:
            open_nodes.append(_completions(left, capacity))
            continue
        if not left and number < best_bins:
            best, best_bins = list(used), number
        change(*used.pop(), -1)
    return best


def _completions(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns around the largest length left, the best filled last."""
    lengths = sorted(left, reverse=True)
    largest = lengths[0]
    after = {**left, largest: left[largest] - 1}
    rest = [n for n in lengths if after[n]]
    out = []
    for filling in reversed(fillings(capacity - largest, after, rest)):
        items = {largest: 1}
        for n, k in filling:
            items[n] = items.get(n, 0) + k
        out.append(tuple(sorted(items.items(), reverse=True)))
    return out


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go: sorted arrays, one entry per use of a
    length in a pattern."""

    keys: np.ndarray  # length and first number
    each: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (length.astype(np.int64) << 44) + number

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.key(length, number)
        at = np.searchsorted(self.keys, key, side="right") - 1
        rank = key - self.keys[at]
        sequence = self.first_sequence[at] + rank // self.each[at]
        return sequence, self.offset[at] + rank % self.each[at] * length


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in bin_completion(counts, capacity):
        offset = 0
        for length, each in pattern:
            rows.append(((length << 44) + taken.get(length, 0), each, sequence, offset))
            taken[length] = taken.get(length, 0) + each * times
            offset += length * each
        sequence += times
    rows.sort()
    return Plan(*(np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [[]] * 4)))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number``, 0, 1, ... among the pieces of one length."""
    n_buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    # the content too, as many rows may lack an id
    spot = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    spot = F.pmod(spot, F.lit(n_buckets)).cast("int")
    rows = rows.withColumn("_bucket", spot)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = (
        rows.groupBy("length", "_bucket")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        rows.withColumn("_k", F.row_number().over(inside))
        .join(shift, ["length", "_bucket"])
        .withColumn("number", F.col("_before") + F.col("_k") - 1)
        .drop("_bucket", "_k", "_before")
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None) -> DataFrame:
    """Every piece with its sequence and its place there."""
    rows = stored(pieces(docs, capacity, vocabulary_path), "pieces")
    histogram = rows.groupBy("length").count().collect()  # at most ``capacity`` rows
    plan = planned({r["length"]: r["count"] for r in histogram}, capacity)
    sent = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = sent.value.place(length, number)
            columns = [batch[f.name] for f in _PIECES]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                schema=_PIECES.append(pa.field("sequence_id", pa.int64())).append(
                    pa.field("offset", pa.int64())
                ),
            )

    return numbered(rows).mapInArrow(place, f"{_PIECES_DDL}, sequence_id long, offset long")
