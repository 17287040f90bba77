"""The near-copy stage against all pairs, and the rows it decides on."""

from __future__ import annotations

import random

import numpy as np
from test_texts import AWKWARD

from stratavec.llm import near_copies, simhash


def linked(a, b):
    first, second = (a[0] ^ b[0]).bit_count(), (a[1] ^ b[1]).bit_count()
    return first <= near_copies.SURE or (
        first <= near_copies.NEAR and second <= near_copies.SECOND
    )


def plain_groups(prints):
    """Number of the group of every entry, by all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if linked(prints[i], prints[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def prints_of(texts):
    return [
        (simhash.fingerprint(t or ""), simhash.fingerprint(t or "", near_copies.SECOND_SEED))
        for t in texts
    ]


def test_one_of_each(spark, docs_of, monkeypatch):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    base = [[rnd.choice(words) for _ in range(150)] for _ in range(10)]
    items = [(10 * k, t) for k, t in enumerate(AWKWARD[:-1])]
    for k in range(200):
        copy = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 8)):
            copy[rnd.randrange(150)] = rnd.choice(words)
        items.append((2000 - k, " ".join(copy)))
    items += [(None, " ".join(base[0])), (None, "quite alone with no id"), (None, "quite alone with no id")]
    items += [(2000, "a text of its own under an id"), (2000, items[9][1]), (2000, items[9][1])]
    groups = plain_groups(prints_of([t for _, t in items]))
    best = {}
    for (doc, text), g in zip(items, groups):
        best.setdefault(g, set()).add((doc is None, doc or 0))
    want = sorted(min(b) for b in best.values())
    for tile, group in ((4096, 20000), (8, 16)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "GROUP_ROWS", group)
        kept = near_copies.one_of_each(docs_of(items))
        assert kept.columns == docs_of(items).columns
        rows = kept.collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == want
        # every row that stays is one that was there, from a group of its own
        place = {(d, t): g for (d, t), g in zip(items, groups)}
        assert len({place[r["doc_id"], r["text"]] for r in rows}) == len(rows)
    assert near_copies.one_of_each(docs_of(items).limit(0)).collect() == []


def test_rows_with_one_id(spark, docs_of):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "some other words here"),
            (None, "no id at all here"), (None, "no id at all here")]
    kept = near_copies.one_of_each(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [
        ("1", rows[0][1]), ("2", rows[2][1]), ("None", rows[3][1])
    ]


def test_forest_connects_what_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flip = lambda v, n: v ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    prints = [(b, b) for b in base]
    prints += [(flip(b, int(n)), flip(b, int(m))) for b in base for n, m in rng.integers(0, 14, (4, 2))]
    fp, other = (np.array([p[k] for p in prints], dtype=np.uint64) for k in range(2))
    pairs = near_copies.forest(fp, other)
    as_ints = [(int(a), int(b)) for a, b in prints]
    assert all(linked(as_ints[a], as_ints[b]) for a, b in pairs)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[find(a)] = find(b)
    want, got = plain_groups(as_ints), [find(i) for i in range(len(prints))]
    same = lambda groups: {tuple(i for i, g in enumerate(groups) if g == k) for k in groups}
    assert same(got) == same(want)
    assert len(pairs) == len(prints) - len(set(want))


def test_thresholds_of_the_wider_search():
    both = np.full((64, 64), 250.0) + np.eye(64) * 250
    for m in range(1, 6):
        groups = simhash.grouped_bits(simhash.correlations(1000, both), m)
        _, thresholds = simhash.allocated(groups, np.diag(both) / 1000, 1000, near_copies.NEAR)
        assert sum(thresholds) == near_copies.NEAR - m + 1
