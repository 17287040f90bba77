"""Conversation structure repair by divide and conquer over cost vectors.

Conversations are damaged on purpose, row by row; then the faults of every row are
found and the cheapest edits that give the form ``(s?(ua)+)?`` (see ``turn_grammar``).

A conversation may hold most of all rows.  Rows are range-partitioned in the order of
the conversations and written once, numbered; ``BLOCK`` consecutive numbers within a
conversation are a block.  A block is summed up as four-by-four costs; up to ``FAN``
neighbouring blocks become one node of the next level, until one node is a whole
conversation (most are one block).  On the way back the states at which the cheapest way
crosses from block to block follow from each node's own entry and exit state, and
inside a block from Hirschberg's recursion.  So no task solves more than a block or the
children of a node.  Repeated rows are found by minima over (conversation, role, hash
of the text), which are partial sums.  Only the digest of the repaired text is
sequential by nature: its rows stream through one task per conversation, one at a time.

Defined cases: a null conv_id is a conversation of its own; in the hashed name, in role
and in text a null is one space; null turns come first; rows of one turn are ordered by
role, then by the first ``PREFIX`` characters of their text and a hash of it; repeated
rows are repeated turns; texts of any length are read whole; an empty table has no
conversations; other columns have no influence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from stratavec.llm import turn_grammar as G
from stratavec.llm.common import stored

BLOCK_BITS, FAN_BITS = 11, 8
# rows of a block, children of a node
BLOCK, FAN = 1 << BLOCK_BITS, 1 << FAN_BITS
PREFIX = 64
ROWS_AT_A_TIME = 256
FAULTS = 20

COUNTS = ("blank", "duplicate", "truncated", "illegal")
NODE = pa.struct(
    [("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32()))]
    + [(c, pa.int64()) for c in COUNTS]
    + [("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("low", "high", "turns")]
)
END = pa.struct([("cost", pa.int64()), ("leave", pa.int32())])


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: rows dropped, emptied, cut, repeated, reroled."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    named = F.concat(filled("conv_id"), F.lit(":"), filled("turn"))
    fault = F.col("_fault")
    rows = conversations.select(
        "conv_id",
        "turn",
        filled("role").alias("role"),
        filled("text").alias("text"),
        (F.crc32(named.cast("binary")) % FAULTS).cast("int").alias("_fault"),
    )
    text = (
        F.when(fault == 1, "")
        .when(fault == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    return (
        rows.filter(fault != 0)
        .select(
            "conv_id",
            "turn",
            F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
            text.alias("text"),
            copies.alias("_copy"),
        )
        .drop("_copy")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their place: ``spot`` grows along conversations and turns."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, G.BLANK).when(whole, G.FINE).otherwise(G.TRUNCATED)
    order = ["conv_id", "turn", "role", "_prefix", "_h1"]
    placed = (
        rows.select(
            "*",
            fault.alias("fault"),
            F.xxhash64("text").alias("_h1"),
            F.xxhash64(F.lit(1), "text").alias("_h2"),
            F.substring("text", 1, PREFIX).alias("_prefix"),
            # equal rows may be dealt to any range
            F.monotonically_increasing_id().alias("_any"),
        )
        .repartitionByRange(*order, "_any")
        .sortWithinPartitions(*order)
        .withColumn("spot", F.monotonically_increasing_id())
        .drop("_prefix", "_any")
    )
    return stored(placed, "repair-rows").withColumn("block", F.shiftright("spot", BLOCK_BITS))


def _same_conversation(left: DataFrame, right: DataFrame) -> Column:
    return left["conv_id"].eqNullSafe(right["conv_id"])


def blocks_of(placed: DataFrame) -> DataFrame:
    """One row per block of a conversation: initials, faults, turns of its rows, in order.

    Conversations may share the number of a block, not its rows.
    """
    narrow = placed.select(
        "conv_id", "block", "spot", F.substring("role", 1, 1).alias("initial"), "fault", "turn"
    )
    rows = narrow.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("spot", "initial", "fault", "turn"))).alias("rows")
    )
    firsts = (
        placed.filter(F.col("fault") != G.BLANK)
        .groupBy("conv_id", "role", "_h1", "_h2")
        .agg(F.min("spot").alias("spot"))
        .groupBy("conv_id", F.shiftright("spot", BLOCK_BITS).alias("block"))
        .agg(F.collect_list("spot").alias("firsts"))
    )
    on = _same_conversation(rows, firsts) & (rows["block"] == firsts["block"])
    joined = rows.join(firsts, on, "left").select(
        rows["conv_id"],
        rows["block"],
        "rows",
        F.coalesce("firsts", F.array().cast("array<bigint>")).alias("firsts"),
    )
    # blocks of a conversation in order, and its first spot as its name
    chain = Window.partitionBy("conv_id").orderBy("block")
    return joined.select(
        "conv_id",
        "block",
        F.min(F.get("rows", 0)["spot"]).over(chain).alias("chain"),
        (F.row_number().over(chain) - 1).cast("bigint").alias("idx"),
        F.col("rows.spot").alias("spots"),
        F.col("rows.initial").alias("initials"),
        F.col("rows.fault").alias("faults"),
        F.col("rows.turn").alias("turns"),
        "firsts",
    )


def _real_faults(spots: list, faults: list, firsts: list) -> list[int]:
    seen = set(firsts)
    return [
        f if f == G.BLANK or s in seen else G.REPEATED for s, f in zip(spots, faults)
    ]


def _joined(parts: list[dict]) -> dict:
    """Counts and ends of neighbouring stretches taken together."""
    out = {c: sum(p[c] for p in parts) for c in (*COUNTS, "turns")}
    out["first"], out["last"] = parts[0]["first"], parts[-1]["last"]
    out["illegal"] += sum(a["last"] + b["first"] not in G.LEGAL for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["low"] is not None]
    out["low"] = known[0]["low"] if known else None
    out["high"] = known[-1]["high"] if known else None
    out["turns"] -= sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    return out


def _node(steps: list[G.Step], figures: dict) -> dict:
    cells = [c for row in G.whole(steps) for c in row]
    return figures | {"cost": [c for c, _ in cells], "rank": [r for _, r in cells]}


def _row_figures(initial: str, fault: int, turn: int | None) -> dict:
    return {
        "blank": int(fault == G.BLANK),
        "duplicate": int(fault == G.REPEATED),
        "truncated": int(fault == G.TRUNCATED),
        "illegal": 0,
        "first": initial,
        "last": initial,
        "low": turn,
        "high": turn,
        "turns": int(turn is not None),
    }


def _step_of(node: dict) -> G.Step:
    cells = list(zip(node["cost"], node["rank"]))
    return G.stretch([cells[4 * x : 4 * x + 4] for x in G.STATES])


@F.arrow_udf(from_arrow_type(NODE))
def block_node(
    spots: pa.Array, initials: pa.Array, faults: pa.Array, turns: pa.Array, firsts: pa.Array
) -> pa.Array:
    """A block summed up."""
    out = []
    for s, i, f, t, seen in zip(*[c.to_pylist() for c in (spots, initials, faults, turns, firsts)]):
        real = _real_faults(s, f, seen)
        figures = _joined([_row_figures(*row) for row in zip(i, real, t)])
        out.append(_node([G.row_step(*row) for row in zip(i, real)], figures))
    return pa.array(out, NODE)


@F.arrow_udf(from_arrow_type(NODE))
def parent_node(children: pa.Array) -> pa.Array:
    """Neighbouring nodes summed up."""
    return pa.array(
        [_node([_step_of(c) for c in nodes], _joined(nodes)) for nodes in children.to_pylist()],
        NODE,
    )


@F.arrow_udf(from_arrow_type(END))
def ending(nodes: pa.Array) -> pa.Array:
    """Cost of a whole conversation and the state after its last row."""
    ends = [G.last_state(list(zip(n["cost"], n["rank"]))[:4]) for n in nodes.to_pylist()]
    return pa.array([{"cost": c, "leave": s} for c, s in ends], END)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def passed(children: pa.Array, entry: pa.Array, leave: pa.Array) -> pa.Array:
    """States before, between and after the children of a node."""
    rows = zip(children.to_pylist(), entry.to_pylist(), leave.to_pylist())
    return pa.array(
        [[x, *G.crossings([_step_of(c) for c in nodes], x, y), y] for nodes, x, y in rows],
        pa.list_(pa.int32()),
    )


@F.arrow_udf(T.StringType())
def block_edits(
    spots: pa.Array, initials: pa.Array, faults: pa.Array, firsts: pa.Array, entry: pa.Array, leave: pa.Array
) -> pa.Array:
    """Letters of a block's edits."""
    columns = [c.to_pylist() for c in (spots, initials, faults, firsts, entry, leave)]
    return pa.array(
        [
            G.edits([G.row_step(*row) for row in zip(i, _real_faults(s, f, seen))], x, y)
            for s, i, f, seen, x, y in zip(*columns)
        ],
        pa.string(),
    )


def _families(level: DataFrame) -> DataFrame:
    """Nodes of a level gathered by their parent: ``(chain, idx, places, nodes)``."""
    gathered = level.groupBy("chain", F.shiftright("idx", FAN_BITS).alias("idx")).agg(
        F.array_sort(
            F.collect_list(F.struct("idx", "node")), lambda a, b: (a["idx"] - b["idx"]).cast("int")
        ).alias("kids")
    )
    return gathered.select(
        "chain", "idx", F.col("kids.idx").alias("places"), F.col("kids.node").alias("nodes")
    )


def solved(blocks: DataFrame) -> DataFrame:
    """``(block, idx, entry, leave, tops)``: states around each block; ``tops`` are the
    figures of the conversation, with its first block."""
    levels = [
        stored(
            blocks.select(
                "chain", "idx", "block", block_node("spots", "initials", "faults", "turns", "firsts").alias("node")
            ),
            "repair-level",
        )
    ]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        above = _families(levels[-1]).select("chain", "idx", parent_node("nodes").alias("node"))
        levels.append(stored(above, "repair-level"))
    states = levels[-1].select(
        "chain", "idx", ending("node").alias("end"), F.col("node").alias("top")
    ).select("chain", "idx", F.lit(G.START).alias("entry"), "end.leave", "end.cost", "top")
    tops = states.select(
        "chain",
        F.struct("cost", *[F.col("top").getField(c).alias(c) for c in (*COUNTS, "low", "high", "turns")]).alias("tops"),
        F.col("leave").alias("end_state"),
    )
    states = states.select("chain", "idx", "entry", "leave")
    for level in reversed(levels[:-1]):
        kids = (
            _families(level)
            .join(states, ["chain", "idx"])
            .select("chain", "places", passed("nodes", "entry", "leave").alias("states"))
        )
        states = stored(
            kids.select("chain", "states", F.posexplode("places").alias("k", "idx")).select(
                "chain", "idx", F.get("states", F.col("k")).alias("entry"), F.get("states", F.col("k") + 1).alias("leave")
            ),
            "repair-states",
        )
    return (
        levels[0].select("chain", "idx").join(states, ["chain", "idx"]).join(tops, "chain", "left")
    )


def edited(conversations: DataFrame) -> DataFrame:
    """Everything the repaired conversations are written from, by conversation.

    One row per conversation (place -1), one per block with its edits, one per turn
    with its text, sorted within partitions.
    """
    placed = numbered(damaged(conversations))
    blocks = stored(blocks_of(placed), "repair-blocks")
    found = blocks.join(solved(blocks), ["chain", "idx"]).select(
        "conv_id",
        "block",
        F.lit(-1).cast("bigint").alias("spot"),
        block_edits("spots", "initials", "faults", "firsts", "entry", "leave").alias("edits"),
        F.when(F.col("idx") == 0, F.col("tops")).alias("tops"),
        F.when(F.col("idx") == 0, F.col("end_state")).alias("end_state"),
    )
    every = conversations.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("spot")
    )
    texts = placed.select("conv_id", "block", "spot", "role", "text")
    return (
        every.unionByName(found, allowMissingColumns=True)
        .unionByName(texts, allowMissingColumns=True)
        .select("conv_id", "block", "spot", "edits", "tops", "end_state", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "block", "spot")
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, ROWS_AT_A_TIME).columns])


class _Conversation:
    """Turns of one repaired conversation, from its rows in order."""

    def __init__(self) -> None:
        self.tops: dict | None = None
        self.audit: list[str] = []
        self._state, self._end, self._letters = G.START, G.START, iter("")

    def _due(self) -> tuple[str, str, str]:
        initial = G.due(self._state)
        self._state = G.after(self._state, initial)
        return G.NAMES[initial], "", "I"

    def turns(self, rows: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
        """``(role, text, edit)`` of every turn of the result."""
        for _, _, spot, edits, tops, end_state, role, text in rows:
            if edits is not None:
                self._letters = iter(edits)
                self.audit.append(edits)
                if tops is not None:
                    self.tops, self._end = tops, end_state
            elif spot >= 0:
                letter = next(self._letters)
                while letter == "I":
                    yield self._due()
                    letter = next(self._letters)
                if letter == "K":
                    self._state = G.after(self._state, role[:1])
                    yield role, text, "K"
                elif letter == "R":
                    yield self._due()[0], text, "R"
        self.audit.append(G.END[self._end])
        for _ in G.END[self._end]:
            yield self._due()


REPORT = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
REPORT_DDL = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, audit string, repaired_sha256 string"
)
TURNS = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64())]
    + [(c, pa.string()) for c in ("role", "text", "edit")]
)
TURNS_DDL = "conv_id bigint, place bigint, role string, text string, edit string"


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*part), schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for row in rows:
        part.append(row)
        if len(part) == ROWS_AT_A_TIME:
            yield batch()
            part.clear()
    if part:
        yield batch()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
            conversation, digest, between = _Conversation(), hashlib.sha256(), b""
            for role, text, _ in conversation.turns(group):
                digest.update(between + f"{role}:".encode())
                digest.update(text.encode())
                between = b"\n"
            tops = conversation.tops or dict.fromkeys((*COUNTS, "cost", "turns"), 0) | {"low": None}
            gaps = 0 if tops["low"] is None else tops["high"] - tops["low"] + 1 - tops["turns"]
            yield (
                conv_id, gaps, *[tops[c] for c in (*COUNTS, "cost")],
                "".join(conversation.audit), digest.hexdigest(),
            )

    return _batched(rows(), REPORT)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
            for place, turn in enumerate(_Conversation().turns(group)):
                yield conv_id, place, *turn

    return _batched(rows(), TURNS)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: every turn with the edit that made it."""
    return edited(conversations).mapInArrow(_turns, TURNS_DDL)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of every conversation."""
    return edited(conversations).mapInArrow(_report, REPORT_DDL)


ORACLE = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), coded AS (
  SELECT *, xor(4294967295, list_reduce(
    flatten(list_transform(range(1, len(name) + 1),
      lambda i: [ascii(name[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384)
                      ELSE c >> 1 END, 4294967295)) % 20 AS k
  FROM source
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
              ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
              AS pos FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1
              THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated'
              ELSE 'fine' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
), figures AS (
  SELECT conv_id,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         count(*) AS n
  FROM judged GROUP BY conv_id
), every AS (
  SELECT DISTINCT conv_id FROM conversations
), tried AS (
  SELECT unnest(['D', 'K', 'R', 'ID', 'IK', 'IR']) AS letters
), way AS (
  SELECT conv_id, 0::BIGINT AS pos, '' AS state, 0::BIGINT AS cost, '' AS audit,
         []::VARCHAR[] AS lines FROM every
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best
    FROM (
      SELECT conv_id, pos,
             CASE letter WHEN 'D' THEN s WHEN 'K' THEN initial ELSE next_due END AS state,
             cost + added + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
               + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost,
             audit || letters AS audit,
             CASE letter WHEN 'D' THEN lines
               WHEN 'K' THEN list_append(lines, role || ':' || text)
               ELSE list_append(lines, CASE next_due WHEN 'u' THEN 'user:' ELSE 'assistant:' END
                                       || text) END AS lines
      FROM (
        SELECT *, CASE s WHEN 'u' THEN 'a' ELSE 'u' END AS next_due FROM (
          SELECT w.conv_id, j.pos, j.role, j.text, j.initial, j.fault, w.cost, w.audit, t.letters,
                 right(t.letters, 1) AS letter,
                 CASE WHEN len(t.letters) = 1 THEN 0 ELSE 5 END AS added,
                 CASE WHEN len(t.letters) = 1 THEN w.state WHEN w.state = 'u' THEN 'a'
                      ELSE 'u' END AS s,
                 CASE WHEN len(t.letters) = 1 THEN w.lines
                      WHEN w.state = 'u' THEN list_append(w.lines, 'assistant:')
                      ELSE list_append(w.lines, 'user:') END AS lines
          FROM way w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id
                                  AND j.pos = w.pos + 1, tried t))
      WHERE letter = 'D' OR (fault IN ('fine', 'truncated')
            AND (letter = 'R' OR s || ':' || initial IN (':s', ':u', 's:u', 'u:a', 'a:u')))))
  WHERE best = 1
), ended AS (
  SELECT w.conv_id, w.cost + 5 * len(more) AS cost, w.audit || more AS audit,
         CASE WHEN more = 'I' THEN list_append(lines, 'assistant:') ELSE lines END AS lines
  FROM (SELECT *, CASE state WHEN 'u' THEN 'I' ELSE '' END AS more FROM way) w
  LEFT JOIN figures f ON w.conv_id IS NOT DISTINCT FROM f.conv_id
  WHERE w.pos = coalesce(f.n, 0) AND w.state <> 's'
), chosen AS (
  SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM chosen c LEFT JOIN figures f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
"""
