"""The audit against its definition, tries against dictionaries."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from stratavec.llm import filter_audit
from stratavec.llm.text_trie import TextTrie, shared_length


def fails(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search("[#$%&*|]", text) else "")


def plain(docs, labels):
    """Every row by walking through all documents for every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        copy = i is not None and any(
            j is not None and j < i and (other or "") == (text or "") for j, other, _ in docs
        )
        rows.append((i, lang or "", fails(text or "") + ("E" if copy else "")))
    out = {}
    for part in {r[1] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(removed)
                out[part, order, step] = [
                    len(left),
                    len(removed),
                    sum(f in r[2] for r in gone),
                    sum(r[1] == part and r[2] == f for r in rows),
                    sum(r[0] in good for r in removed),
                    sum(r[0] in toxic for r in removed),
                ]
                gone += removed
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    prose = " ".join(f"w{k}" for k in range(230))
    parts = [prose, prose + " tail", "word " * 250, "LOUD ", "a#b ", "é🙂 ", "\x1c", "\t\n", ""]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 3))) for _ in range(n)]


@pytest.mark.parametrize("held", [filter_audit.HELD, 500])
def test_audit(spark, monkeypatch, held):
    # a small weight empties the tries all the time
    monkeypatch.setattr(filter_audit, "HELD", held)
    rnd = random.Random(7)
    docs = [(i, t, rnd.choice(["en", "de", None])) for i, t in enumerate(texts(1, 60))]
    docs += [(None, docs[0][1], "en"), (None, "", None), (None, None, "en"), (70, None, "fr")]
    docs += [docs[3], docs[3], (3, "other text under one id", "en"), (-5, docs[9][1], "de")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 60, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(
        [(*d, 0, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string"
    ).repartition(3)
    known = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, n string")
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.audit(frame, known).collect()}
    assert got == plain(docs, labels)
    assert filter_audit.audit(frame.limit(0), known).collect() == []


def test_trie():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7))) for _ in range(400)]
    trie, least = TextTrie(), {}
    for i, word in enumerate(words):
        trie.insert(word, -i % 97, ())
        least[word] = min(least.get(word, 999), -i % 97)
    found = {text: node for text, node in trie.terminals()}
    assert {t: n.least for t, n in found.items()} == least
    assert sum(len(n.rows) for n in found.values()) == len(words)
    # the trie is compressed: no inner node has one child and no text
    stack = [trie.root]
    while stack:
        node = stack.pop()
        stack += node.children.values()
        assert node is trie.root or node.rows is not None or len(node.children) > 1
    assert shared_length("abc", "xabd", 1) == 2 and shared_length("", "x", 0) == 0
    long = "z" * 500_000
    trie.insert(long + "a", 1, ())
    trie.insert(long + "b", 2, ())
    assert {t[-1] for t, _ in trie.terminals() if len(t) > 10} == {"a", "b"}
