"""Filter interaction audit: what five filters remove in each of their 120 orders.

A document fails filter

* A with under 200 words,
* B if less than half of its words are distinct,
* C if more than 3 % of its code points are capital letters A-Z,
* D if it holds any of ``#$%&*|``,
* E if a document with a smaller id has the very same text.

E is found by radix tries.  A task first gathers its own texts in a compressed trie:
rows that are not the least of their text there fail E at once, and only one row of a
text goes on.  Those are range-partitioned by text prefixes: boundaries lie in the
first ``PREFIX`` characters, deeper ones where those are too frequent, and in a hash
of the whole text where even ``PREFIX + DEEPER`` characters are.  Each range, sorted,
is inserted into a trie whose terminals hold the least id of their text, and the
traversal of the trie tells which rows are not the least.

The five verdicts are the bits of a mask.  Masks are counted per part (language) and
label -- partial sums, at most 128 cells a part -- and all 600 rows of a part follow
from how many masks avoid each of the 32 sets of filters.

No task holds more than ``HELD`` characters and rows in a trie: the local one is
emptied, which costs only some repeats later on, and in a sorted range every text
before the last one is complete, so the trie is traversed, and only the least id of
the last text stays.

Defined cases: a null text is empty (and equal to any other empty one), a null
language is the part ``''``; a row without an id never fails E and makes no other row
fail; rows that repeat an id with the same text are not copies of each other;
a document with several rows in ``labels`` has a label if one of them says so;
other columns have no influence; an empty table gives no part and so no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial
from string import ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import chunks, stored
from stratavec.llm.text_trie import TextTrie

FILTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = "#$%&*|"
COPY = 1 << FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1
# characters of a text in which ranges are cut first, and how many more where needed
PREFIX, DEEPER = 32, 96
# characters, and 64 for each row, in one trie
HELD = 24_000_000
ROWS_AT_A_TIME = 256
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ROWS = pa.schema(
    [
        ("text", pa.string()),
        ("doc_id", pa.int64()),
        ("part", pa.string()),
        ("mask", pa.int32()),
    ]
)
ROWS_DDL = "text string, doc_id bigint, part string, mask int"
MARKED_DDL = "doc_id bigint, part string, mask int"


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    words = WORD.findall(text)
    capitals = sum(map(text.count, ascii_uppercase))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 3 * len(text)) << 2
        | any(map(text.__contains__, SYMBOLS)) << 3
    )


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in chunks(rows, ROWS_AT_A_TIME):
        columns = zip(*part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, ROWS_AT_A_TIME).columns])


def _combined(trie: TextTrie) -> Iterator[tuple]:
    """Rows of a task's own trie; those that are not the least are done with."""
    for text, node in trie.terminals():
        for doc_id, part, mask in node.rows:
            if doc_id > node.least:
                yield None, doc_id, part, mask | COPY
            else:
                yield text, doc_id, part, mask


def local_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(text, doc_id, part, mask)`` of ``(doc_id, part, text)``; a null text means
    that the mask is final."""
    trie = TextTrie()
    for doc_id, part, text in rows:
        mask = text_mask(text)
        if doc_id is None:
            yield None, None, part, mask
            continue
        trie.insert(text, doc_id, (part, mask))
        if trie.weight > HELD:
            yield from _combined(trie)
            trie = TextTrie()
    yield from _combined(trie)


def _marked(trie: TextTrie) -> Iterator[tuple]:
    for _, node in trie.terminals():
        for doc_id, part, mask in node.rows:
            yield doc_id, part, mask | (COPY if doc_id > node.least else 0)


def marked_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Final masks of a range of ``(text, doc_id, part, mask)``, sorted by the first two."""
    trie = TextTrie()
    for text, doc_id, part, mask in rows:
        trie.insert(text, doc_id, (part, mask))
        if trie.weight > HELD:
            yield from _marked(trie)
            least, trie = trie.terminal(text).least, TextTrie()
            last = trie.terminal(text)
            last.least, last.rows = least, []
    yield from _marked(trie)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(local_rows(_rows(batches)), ROWS)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(marked_rows(_rows(batches)), pa.schema(list(ROWS)[1:]))


def masks(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask)`` of every row of ``docs``."""
    filled = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    rows = docs.select("doc_id", filled("lang"), filled("text"))
    local = stored(rows.mapInArrow(_local, ROWS_DDL), "audit-texts")
    ranged = (
        local.filter("text IS NOT NULL")
        .repartitionByRange(
            F.substring("text", 1, PREFIX),
            F.substring("text", PREFIX + 1, DEEPER),
            F.xxhash64("text"),
        )
        .sortWithinPartitions("text", "doc_id")
    )
    final = local.filter("text IS NULL").select("doc_id", "part", "mask")
    return ranged.mapInArrow(_mark, MARKED_DDL).unionByName(final)


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, cells)``: documents of each mask and label, at most 128 cells."""
    said = lambda name: F.max(
        F.coalesce(F.col(name).cast("string").try_cast("double") == 1, F.lit(False))
    )
    known = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    )
    # equal rows are counted first, so an id on very many rows is one row here
    counted = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    labelled = counted.join(known, "doc_id", "left").select(
        "part",
        "mask",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
        "n",
    )
    return (
        labelled.groupBy("part", "mask", "good", "toxic")
        .agg(F.sum("n").alias("n"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    )


def _avoiding(weight) -> Column:
    """For each set of filters, the documents that fail none of them."""

    def survivors(filters: Column) -> Column:
        return F.aggregate(
            "cells",
            F.lit(0).cast("long"),
            lambda total, c: total
            + F.when(c["mask"].bitwiseAND(filters) == 0, weight(c)).otherwise(F.lit(0).cast("long")),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), survivors)


def _shapley(bit: Column) -> Column:
    """Removals of a filter summed over all orders: a set of k filters comes before it
    in k! (4 - k)! of them."""
    weights = F.lit([factorial(n) * factorial(max(len(FILTERS) - 1 - n, 0)) for n in range(6)])

    def gain(filters: Column) -> Column:
        removed = F.get("alive", filters) - F.get("alive", filters + bit)
        return F.when(
            filters.bitwiseAND(bit) == 0, removed * F.get(weights, F.bit_count(filters))
        ).otherwise(F.lit(0).cast("long"))

    every = F.transform(F.sequence(F.lit(0), F.lit(ALL)), gain)
    return F.aggregate(every, F.lit(0).cast("long"), lambda total, x: total + x)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    bits = F.lit([1 << n for n in range(len(FILTERS))])
    bit = lambda i: F.get(bits, F.ascii(F.substring(F.col("filter_order"), i, 1)) - ord("A"))
    places = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    earlier = F.aggregate(
        places, F.lit(0), lambda total, i: total + F.when(i < F.col("step"), bit(i)).otherwise(0)
    )
    count = lambda flag: lambda c: F.when(c[flag], c["n"]).otherwise(F.lit(0).cast("long"))
    rows = (
        cells(masks(docs), labels)
        .select(
            "part",
            _avoiding(lambda c: c["n"]).alias("alive"),
            _avoiding(count("good")).alias("good"),
            _avoiding(count("toxic")).alias("toxic"),
        )
        .select("*", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(places).alias("step"))
        .select("*", earlier.alias("before"), bit(F.col("step")).alias("bit"))
        .withColumn("after", F.col("before") + F.col("bit"))
    )
    lost = lambda name: F.get(name, F.col("before")) - F.get(name, F.col("after"))
    fails = F.get("alive", F.lit(0)) - F.get("alive", F.col("bit"))
    alone = F.get("alive", F.lit(ALL) - F.col("bit")) - F.get("alive", F.lit(ALL))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("alive", F.col("after")).alias("kept"),
        lost("alive").alias("removed"),
        (fails - lost("alive")).alias("redundant"),
        alone.alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        _shapley(F.col("bit")).alias("shapley"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good,
         bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), worded AS (
  SELECT d.*, f.first_id, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w
  FROM docs d JOIN firsts f USING (t)
), failed AS (
  SELECT doc_id, part, list_filter([
      CASE WHEN len(w) < 200 THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
      CASE WHEN doc_id > first_id THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM worded
), cells AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders
), tried AS (
  SELECT part, filter_order, step, filter_order[step] AS f, n, good, toxic,
         list_contains(fails, filter_order[step]) AS failing,
         len(fails) AS n_fails,
         len(list_filter(fails, lambda x: instr(filter_order[:step - 1], x) > 0)) > 0 AS gone
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND failing), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost
  FROM tried GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
