"""Vectors from models that see the sequence, a block of tokens at a time.

A sequence is cut into blocks of tokens.  What a block has to tell the blocks behind it
is its *digest*; the digests before a block, merged in order, are its *state*.  So a
model may depend on everything before a block, and yet blocks are independent work: a
sequence with a third of all tokens is many tasks, and none holds more than one block
and one Arrow batch of sampled rows.

There are two ways to the vectors.  ``encode`` takes sampled rows and meets them with
the sequences by (example, block).  ``encode_in_row`` takes sequences whose sample is
still an array in their own row; nothing is grouped or shuffled and no state is kept
between rows, so it also runs on a stream.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# tokens of a block
TOKEN_BLOCK = 1024
# sampled positions handed to a model at once
POSITIONS_AT_ONCE = 4096
_STATE, _TOKENS, _ROW = range(3)
_KEY = ("example_id", "layer", "kind", "position")

SequenceFunction = Callable[[list[str], int, str, np.ndarray], np.ndarray]


class BlockModel(Protocol):
    """A model over blocks of a sequence.

    ``vectors`` gives one flat vector for each absolute position, all of them inside the
    block whose first token is at ``first``.  ``digest`` may be None where a model needs
    nothing of earlier blocks; the state before the first block is None.
    """

    def digest(self, tokens: list[str]) -> Any: ...

    def merge(self, state: Any, digest: Any) -> Any: ...

    def vectors(
        self, tokens: list[str], first: int, state: Any, layer: int, kind: str, positions: np.ndarray
    ) -> np.ndarray: ...


def _vectors(
    model: BlockModel, tokens: list[str], first: int, state: Any, layer: int, kind: str, positions: np.ndarray
) -> Iterator[np.ndarray]:
    """Checked vectors of positions of one block, a bounded number at a time."""
    for start in range(0, len(positions), POSITIONS_AT_ONCE):
        wanted = positions[start : start + POSITIONS_AT_ONCE].astype(np.int64)
        if len(wanted) and not (first <= wanted.min() and wanted.max() < first + len(tokens)):
            raise ValueError(f"sampled position beyond the {first + len(tokens)} tokens of its block")
        out = np.asarray(model.vectors(tokens, first, state, layer, kind, wanted), dtype=np.float32)
        if len(out) != len(wanted):
            raise ValueError(f"{len(out)} vectors for {len(wanted)} positions")
        yield out


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    """Vectors as one Arrow list array; parts may differ in width."""
    widths = [np.full(len(p), p.shape[1] if p.ndim > 1 else 0) for p in parts]
    ends = np.cumsum(np.concatenate(widths)) if parts else np.empty(0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    values = np.concatenate([p.ravel() for p in parts]) if parts else np.empty(0)
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32()))


def _lists(column: pa.Array) -> Callable[[int], list]:
    """The lists of an Arrow list column by row, null as an empty one."""
    ends, values = column.offsets.to_numpy(), column.values

    def row(i: int) -> list:
        first, last = ends[i], ends[i + 1]
        return values.slice(first, last - first).to_numpy(zero_copy_only=False).tolist()

    return row


def token_blocks(examples: DataFrame, size: int = TOKEN_BLOCK) -> DataFrame:
    """``(example_id, block, tokens)`` of sequences ``(example_id, tokens)``."""
    last = F.floor((F.size("tokens") - 1) / F.lit(size)).cast("int")
    numbers = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), last))
    return examples.select("example_id", "tokens", F.explode(numbers).alias("block")).select(
        "example_id", "block", F.slice("tokens", F.col("block") * size + 1, F.lit(size)).alias("tokens")
    )


def block_states(blocks: DataFrame, model: BlockModel) -> DataFrame:
    """``(example_id, block, state)``: what the model knows before each block.

    Digests are worked out block by block, wherever the blocks are; only they are
    brought in order, so a task sees one small row per block of its sequences.
    """
    fields = "example_id bigint, block int, state binary"
    schema = pa.schema([("example_id", pa.int64()), ("block", pa.int32()), ("state", pa.binary())])

    def batch(ids: list, numbers: list, states: list) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip((ids, numbers, states), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            tokens = _lists(rows.column("tokens"))
            told = [pickle.dumps(model.digest(tokens(i))) for i in range(rows.num_rows)]
            yield batch(rows.column("example_id").to_pylist(), rows.column("block").to_pylist(), told)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, state, due = object(), None, 0
        for rows in batches:
            ids, numbers, told = (rows.column(n).to_pylist() for n in schema.names)
            states = []
            for example, number, digest in zip(ids, numbers, told):
                if example != seen:
                    seen, state, due = example, None, 0
                if number != due:
                    raise ValueError(f"more than one sequence for example {example}")
                states.append(pickle.dumps(state))
                state, due = model.merge(state, pickle.loads(digest)), due + 1
            yield batch(ids, numbers, states)

    return (
        blocks.mapInArrow(digests, fields)
        .repartition("example_id")
        .sortWithinPartitions("example_id", "block")
        .mapInArrow(chained, fields)
    )


@dataclass
class BlockEncoder:
    """Encoder around a ``BlockModel``.

    With ``examples(example_id, tokens)``, sampled rows meet their sequences by block.
    Without, the sample has to be in the row of its sequence (``encode_in_row``).  A
    sampled row without its token and a sequence that is there twice are errors.
    """

    model: BlockModel
    examples: DataFrame | None = None
    block: int = TOKEN_BLOCK

    def encode(self, rows: DataFrame) -> DataFrame:
        if self.examples is None:
            raise ValueError("sampled rows need the sequences they were taken from")
        blocks = token_blocks(self.examples, self.block)
        number = F.floor(F.col("position") / F.lit(self.block)).cast("int").alias("block")
        own = rows.select("example_id", number, F.struct(*rows.columns).alias("_row"))
        part = lambda frame, k: frame.withColumn("_part", F.lit(k))
        return _encoded(
            part(block_states(blocks, self.model), _STATE)
            .unionByName(part(blocks, _TOKENS), allowMissingColumns=True)
            .unionByName(part(own, _ROW), allowMissingColumns=True),
            rows.schema,
            self.model,
            self.block,
        )

    def encode_in_row(self, sampled: DataFrame) -> DataFrame:
        return _encoded_in_row(sampled, self.model, self.block)


def _encoded(parts: DataFrame, row: T.StructType, model: BlockModel, size: int) -> DataFrame:
    """Sampled rows with their vectors, from states, blocks and rows by (example, block)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state_of = tokens_of = object()
        state, tokens = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.column("_part").to_numpy()
            told = [batch.column(n).to_numpy() for n in ("example_id", "block")]
            whole = batch.column("_row")
            layers = whole.field("layer").fill_null(-1).to_numpy()
            names = whole.field("kind").fill_null("").dictionary_encode()
            positions = whole.field("position").fill_null(-1).to_numpy()
            marks = [kinds, *told, layers, names.indices.to_numpy()]
            tokens_at = _lists(batch.column("tokens"))
            # runs of rows that differ in none of these
            new = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            starts = [0, *new.tolist()]
            parts = []
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                part, key = kinds[at], (int(told[0][at]), int(told[1][at]))
                if part == _STATE:
                    state_of, state = key, pickle.loads(batch.column("state")[at].as_py())
                elif part == _TOKENS:
                    if end - at > 1 or key == tokens_of:
                        raise ValueError(f"more than one sequence for example {key[0]}")
                    tokens_of, tokens = key, tokens_at(at)
                else:
                    if key != tokens_of or key != state_of:
                        raise ValueError("sampled rows of an example without tokens")
                    kind = names.dictionary[names.indices[at].as_py()].as_py()
                    wanted = positions[at:end]
                    parts += _vectors(model, tokens, key[1] * size, state, int(layers[at]), kind, wanted)
            if parts:
                rows = whole.filter(pa.array(kinds == _ROW))
                yield pa.RecordBatch.from_arrays([rows, _list_array(parts)], names=["_row", "flat"])

    schema = T.StructType(
        [T.StructField("_row", row), T.StructField("flat", T.ArrayType(T.FloatType()))]
    )
    order = ["example_id", "block", "_part", *[F.col("_row").getField(k) for k in _KEY[1:]]]
    return (
        parts.select("example_id", "block", "_part", "tokens", "state", "_row")
        .repartition("example_id", "block")
        .sortWithinPartitions(*order)
        .mapInArrow(encode, schema)
        .select("_row.*", "flat")
    )


IN_ROW = (
    "example_id bigint, layer int, kind string, position int, token_str string, flat array<float>"
)


def _encoded_in_row(sampled: DataFrame, model: BlockModel, size: int | None) -> DataFrame:
    """One row per wanted position of sequences ``(example_id, tokens, wanted)``, where
    ``wanted`` holds ``(layer, kind, positions)``, its positions in ascending order."""
    schema = pa.schema(
        [
            ("example_id", pa.int64()),
            ("layer", pa.int32()),
            ("kind", pa.string()),
            ("position", pa.int32()),
            ("token_str", pa.string()),
            ("flat", pa.list_(pa.float32())),
        ]
    )

    def sequence(tokens: list[str], wanted: list[tuple]) -> Iterator[tuple]:
        """``(layer, kind, places, tokens, vectors)``, a bounded number of places at a time."""
        state, step = None, size or max(len(tokens), 1)
        for first in range(0, len(tokens), step):
            part = tokens[first : first + step]
            for layer, kind, spots in wanted:
                low, high = np.searchsorted(spots, (first, first + len(part)))
                done = low
                for out in _vectors(model, part, first, state, layer, kind, spots[low:high]):
                    places = spots[done : done + len(out)]
                    done += len(out)
                    yield layer, kind, places, [part[p] for p in (places - first).tolist()], out
            if first + step < len(tokens):
                state = model.merge(state, model.digest(part))

    def batch(held: list[tuple]) -> pa.RecordBatch:
        examples, layers, kinds, places, words, parts = zip(*held)
        sizes = [len(p) for p in places]
        columns = [
            np.repeat(np.array(examples, dtype=np.int64), sizes),
            np.repeat(np.array(layers, dtype=np.int32), sizes),
            np.repeat(np.array(kinds, dtype=object), sizes),
            np.concatenate(places),
            list(chain.from_iterable(words)),
        ]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays([*arrays, _list_array(list(parts))], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in batches:
            examples, tokens = rows.column("example_id").to_pylist(), _lists(rows.column("tokens"))
            groups = rows.column("wanted")
            ends, each = groups.offsets.to_pylist(), groups.values
            layers, kinds = (each.field(f).to_pylist() for f in ("layer", "kind"))
            spots = each.field("positions")
            bounds, places = spots.offsets.to_pylist(), spots.values.to_numpy(zero_copy_only=False)
            for row, example in enumerate(examples):
                wanted = [
                    (layers[g], kinds[g], places[bounds[g] : bounds[g + 1]])
                    for g in range(ends[row], ends[row + 1])
                    if bounds[g] < bounds[g + 1]
                ]
                if not wanted:
                    continue
                for found in sequence(tokens(row), wanted):
                    held.append((example, *found))
                    n += len(found[2])
                    # small pieces are put together, up to a bounded number of rows
                    if n >= POSITIONS_AT_ONCE:
                        yield batch(held)
                        held, n = [], 0
        if held:
            yield batch(held)

    return sampled.select("example_id", "tokens", "wanted").mapInArrow(encode, IN_ROW)


@dataclass(frozen=True)
class WholeSequence:
    """A function of the whole sequence as a model whose only block is the sequence."""

    function: SequenceFunction

    def digest(self, tokens: list[str]) -> None:
        return None

    def merge(self, state: None, digest: None) -> None:
        return None

    def vectors(
        self, tokens: list[str], first: int, state: None, layer: int, kind: str, positions: np.ndarray
    ) -> np.ndarray:
        return self.function(tokens, layer, kind, positions)


@dataclass
class SequenceEncoder:
    """Encoder around ``model(tokens, layer, kind, positions)``, which sees a whole
    sequence and returns one flat vector per position.

    A task holds the tokens of one sequence and a batch of its sampled rows; sequences
    too long for that need a ``BlockEncoder``.  ``examples`` as there.
    """

    model: SequenceFunction
    examples: DataFrame | None = None

    def _blocks(self) -> BlockEncoder:
        # no sequence is as long, so each is one block
        return BlockEncoder(WholeSequence(self.model), self.examples, (1 << 31) - 1)

    def encode(self, rows: DataFrame) -> DataFrame:
        return self._blocks().encode(rows)

    def encode_in_row(self, sampled: DataFrame) -> DataFrame:
        return replace(self._blocks(), block=None).encode_in_row(sampled)
