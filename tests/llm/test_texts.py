"""Operators on texts, on small tables with awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from stratavec.llm import (
    bpe_prefix,
    html_cut,
    licenses,
    line_dedup,
    packing,
    quality_rules,
    simhash,
    subword_classifier,
)

AWKWARD = [
    None,
    "",
    " ",
    "\n\n\n",
    "a",
    "a b c d e",
    "a b c d e",
    "Ünï cödé “quotes”   \t\x1c and 日本語 🙂",
    "<|endoftext|> don't <|endoftext|>",
    "one two three " * 9000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_prefix.read_vocabulary()


def pieces_of_noise(n, seed):
    rnd = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'", "é", "日本", "🙂", " ", "12", "-", "ing"]
    parts += ["aaaa", "\x1c", "\xa0", "İ", "ƀ", "<|endoftext|>", "!!", "\x85"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_library(spark, docs_of, vocabulary):
    library = Tokenizer.from_str(vocabulary)
    texts = AWKWARD + pieces_of_noise(300, 1)
    got = {r["doc_id"]: r for r in bpe_prefix.round_trip(docs_of(texts)).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    rows = bpe_prefix.token_ids(docs_of(texts[:12])).collect()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]] or "").ids for r in rows)


def test_bpe_whole_table(spark, small, vocabulary):
    library = Tokenizer.from_str(vocabulary)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe_prefix.round_trip(docs).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def check_packing(rows, texts, library, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert by_doc.keys() == texts.keys()
    total = 0
    for doc, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        found = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in found] == packing.cuts(len(ids), capacity)
        for r in found:
            part = ids[r["start"] : r["start"] + r["length"]].tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
        total += len(ids)
    return len(by_sequence), -(-total // capacity)


def test_packing(spark, docs_of, small, vocabulary):
    library = Tokenizer.from_str(vocabulary)
    texts = AWKWARD + pieces_of_noise(200, 2)
    rows = packing.packed(docs_of(texts)).collect()
    used, bound = check_packing(rows, dict(enumerate(texts)), library, packing.CAPACITY)
    assert used == bound
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    used, bound = check_packing(packing.packed(docs).collect(), texts, library, packing.CAPACITY)
    assert used <= bound + 1
    assert packing.packed(docs.limit(0)).collect() == []
    twice = packing.packed(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3


@pytest.mark.parametrize("n", [1, 30, 400])
def test_bin_completion_uses_every_piece_once(n):
    rnd = random.Random(n)
    counts = Counter(rnd.randint(1, 100) for _ in range(n))
    plan = packing.bin_completion(dict(counts), 100, 500)
    used = Counter()
    for pattern, times in plan:
        assert sum(length * k for length, k in pattern) <= 100
        for length, k in pattern:
            used[length] += k * times
    assert used == counts
    assert sum(k for _, k in plan) <= sum(k for _, k in packing.best_fit(dict(counts), 100))
    assert packing.bin_completion({}, 100) == []


def test_bin_completion_beats_best_fit():
    # best fit pairs 6 with 4 and strands the threes
    counts = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}
    assert sum(k for _, k in packing.bin_completion(counts, 10)) == 3


def fewest(pieces, capacity):
    """Least number of bins, by trying everything."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= pieces[k]}):
            rest = list(rooms)
            rest.remove(room)
            place(k + 1, [*rest, room - pieces[k]])
        place(k + 1, [*rooms, capacity - pieces[k]])

    place(0, [])
    return best


def test_packing_is_least_for_few_pieces():
    rnd = random.Random(12)
    for _ in range(150):
        capacity = rnd.choice([10, 30, 100])
        low = rnd.randint(1, capacity // 2)
        pieces = [rnd.randint(low, capacity) for _ in range(rnd.randint(1, 10))]
        counts = dict(Counter(pieces))
        want = fewest(pieces, capacity)
        assert packing.lower_bound(counts, capacity) <= want
        assert sum(k for _, k in packing.bin_completion(counts, capacity)) == want, pieces


def test_fullest_filling():
    rnd = random.Random(13)
    for _ in range(200):
        counts = Counter(rnd.randint(1, 30) for _ in range(rnd.randint(0, 8)))
        room = rnd.randint(1, 60)
        items = list(counts.elements())
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        got = packing.fullest(room, counts, sorted(counts, reverse=True))
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in got)


def test_planted_packings():
    """Triples that fill a sequence, and pieces that go by threes or by twos."""
    rnd = random.Random(1)
    triples = []
    while len(triples) < 300:
        a, b = rnd.randint(500, 900), rnd.randint(500, 900)
        if 500 <= 2048 - a - b <= 900:
            triples += [a, b, 2048 - a - b]
    size = lambda counts: sum(k for _, k in packing.bin_completion(counts))
    assert size(dict(Counter(triples))) <= 1.04 * 100
    mixed = dict(Counter(rnd.randint(500, 900) for _ in range(600)))
    found = size(mixed)
    assert found <= 1.05 * packing.lower_bound(mixed, packing.CAPACITY)
    assert sum(k for _, k in packing.best_fit(mixed, packing.CAPACITY)) > 1.05 * found


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, linked):
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if linked(pairs[i][1], pairs[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(pairs))]


def test_simhash_components(spark, docs_of, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(words) for _ in range(120)] for _ in range(12)]
    items = [(10 * k, t) for k, t in enumerate(AWKWARD[:-1])]
    for k in range(160):
        copy = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            copy[rnd.randrange(120)] = rnd.choice(words)
        items.append((1000 - k, " ".join(copy)))
    items += [(None, " ".join(base[0])), (None, "alone with no id at all"), (1000, items[9][1])]
    for tile, group in ((4096, 20000), (8, 16)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "GROUP_ROWS", group)
        got = Counter(tuple(r) for r in simhash.near_duplicates(docs_of(items)).collect())
        prints = [(d, plain_fingerprint(t)) for d, t in items]
        roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= simhash.MAX_BITS)
        assert got == Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, roots))
    assert simhash.near_duplicates(docs_of(items).limit(0)).collect() == []


@pytest.mark.parametrize("m", range(1, 6))
def test_thresholds_obey_the_pigeonhole_rule(m):
    both = np.full((64, 64), 250.0) + np.eye(64) * 250
    groups = simhash.grouped_bits(simhash.correlations(1000, both), m)
    assert sorted(b for g in groups for b in g) == list(range(64))
    _, thresholds = simhash.allocated(groups, np.diag(both) / 1000, 1000)
    assert sum(thresholds) == simhash.MAX_BITS - m + 1 and min(thresholds) >= -1


def test_unequal_thresholds_find_every_link(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rnd.choice(62, 4, replace=False)) for b in base]
    frame = spark.createDataFrame([(int(x),) for x in [*base, *near]], "fp long")
    groups = [(list(range(0, 32)), 2), (list(range(32, 64)), 1)]
    rows = simhash.probes(frame, groups).toArrow()
    found = simhash._verified(rows).to_pylist()
    assert {frozenset((int(b), n)) for b, n in zip(base, near)} <= {
        frozenset((r["a"], r["b"])) for r in found
    }


def plain_line_dedup(items):
    order = sorted(range(len(items)), key=lambda i: (items[i][0] is not None, items[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        doc, text = items[i]
        if text is None:
            out[doc] = (None, 0, 0)
            continue
        lines, gone = text.split("\n"), set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if not "".join(window).strip(" "):
                continue
            if window in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(window)
        kept = [line for p, line in enumerate(lines) if p not in gone]
        out[doc] = ("\n".join(kept), len(lines), len(gone))
    return out


def test_line_dedup(spark, docs_of):
    rnd = random.Random(4)
    items = list(enumerate(AWKWARD))
    for k in range(60):
        items.append((100 + k, "\n".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 30)))))
    items.append((None, "a\nb\nc\nd\na\nb\nc"))
    got = {
        r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"])
        for r in line_dedup.deduplicated_lines(docs_of(items)).collect()
    }
    assert got == plain_line_dedup(items)
    same = line_dedup.shorten(docs_of([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in same) == [(1, "a\nb\nc")] * 2 + [(2, "")]
    assert line_dedup.shorten(docs_of(["x"]).limit(0)).collect() == []


def plain_statistics(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        i + k
        for i in range(len(words) - 2)
        if windows[tuple(words[i : i + 3])] > 1
        for k in range(3)
    }
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_rules(spark, docs_of):
    rnd = random.Random(9)
    clean = [
        " ".join("".join(rnd.choice("etaoin") for _ in range(rnd.randint(2, 8))) for _ in range(90)) + "."
        for _ in range(300)
    ]
    junk = [" ".join("#|*" * 3 for _ in range(80)) + str(k) for k in range(10)]
    texts = AWKWARD + clean + junk
    got = {r["doc_id"]: r for r in quality_rules.verdicts(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = plain_statistics(text)
        assert tuple(got[k][n] for n in quality_rules.BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[k]["base_failed"] == failed
        if text in junk:
            assert not got[k]["kept"]
        elif text in clean:
            assert got[k]["kept"]
    kept = quality_rules.keep_regular(docs_of(texts))
    assert kept.columns == docs_of(texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k in got if got[k]["kept"])
    assert quality_rules.keep_regular(docs_of(texts).limit(0)).collect() == []


def test_quality_rules_judge_small_languages_by_all_rows(spark):
    """Junk of a rare or null language is found by the estimate of the whole table."""
    rnd = random.Random(10)

    def clean():
        return " ".join("".join(rnd.choice("etaoin") for _ in range(rnd.randint(2, 8))) for _ in range(90)) + "."

    junk = [" ".join("#|*" * 3 + str(rnd.random()) for _ in range(80)) for _ in range(4)]
    rows = [(k, clean(), "en") for k in range(120)]
    rows += [(200 + k, clean(), "de") for k in range(20)] + [(300 + k, clean(), None) for k in range(5)]
    rows += [(1000 + k, t, lang) for k, (t, lang) in enumerate(zip(junk, ("de", None, "fr", "en")))]
    frame = spark.createDataFrame([(*r, "web") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.verdicts(frame).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [k for k in got if got[k]["kept"] != (k < 1000)] == []
    assert all(r["distance"] is not None for r in got.values())
    # with fewer rows in all there is nothing to estimate from
    few = quality_rules.verdicts(frame.filter("lang = 'de'")).collect()
    assert len(few) == 21 and all(r["kept"] and r["distance"] is None for r in few)


def test_covariance_fit_equals_plain_concentration(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, quality_rules.N_STATS)) * 0.3
    x[:60] += 5
    frame = spark.createDataFrame([("g", v.tolist()) for v in x], "grp string, x array<double>")
    fit = quality_rules.covariance_fits(frame).first()
    centre = np.median(x, axis=0)
    for _ in range(20):
        d = ((x - centre) ** 2).sum(axis=1)
        centre = x[np.argsort(d)[: int(0.75 * 400)]].mean(axis=0)
    assert np.allclose(fit["centre"], centre, atol=0.05)
    inverse = np.array(fit["inverse"]).reshape(quality_rules.N_STATS, -1)
    distance = np.einsum("ni,ij,nj->n", x - fit["centre"], inverse, x - fit["centre"])
    assert distance[:60].min() > quality_rules.chi2_quantile(0.99999, quality_rules.N_STATS)
    assert np.median(distance[60:]) < quality_rules.chi2_quantile(0.9, quality_rules.N_STATS)


def test_classifier(spark, docs_of, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = {r["doc_id"]: r for r in subword_classifier.classify(docs, labels).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [d for d in known if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(scored[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in scored)
    right = sum(scored[d]["predicted"] == known[d] for d in held)
    assert right / len(held) > 0.95
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in scored.values())
    few = docs_of(AWKWARD + [(None, "x")])
    out = subword_classifier.classify(few, labels).collect()
    assert len(out) == len(AWKWARD) + 1 and all(0 <= r["score"] <= 1 for r in out)
    none = subword_classifier.classify(few, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert subword_classifier.classify(few.limit(0), labels).collect() == []


def test_classifier_learns_from_other_documents(spark, small):
    """Documents of one class are judged by a model that has seen both."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    poor = docs.join(labels.filter("quality = 0"), "doc_id", "left_semi")
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    kept = lambda rows: subword_classifier.keep_good(rows, labels, docs).collect()
    assert len(kept(poor)) <= 0.1 * poor.count()
    assert len(kept(good)) >= 0.95 * sum(quality.values())
    # examples repeated under one id are one example
    twice = subword_classifier.keep_good(good, labels, docs.union(docs)).count()
    assert twice == len(kept(good))


def test_classifier_cuts_long_texts_at_words():
    text = "alpha beta gamma " * 40000
    whole = sum(len(subword_classifier._hashed(p)) for p in subword_classifier._stretches(text))
    assert whole == pytest.approx(len(subword_classifier._hashed(text)), abs=6)


def test_licenses(spark, docs_of):
    texts = AWKWARD + [
        "Released under the MIT License. MIT license, mit-license",
        "x\n\nLicensed under\nCC BY-NC 4.0.\n\ny",
        "nothing of a license here",
        "General Public\nLicense",
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(texts)).collect()}
    n = len(AWKWARD)
    first = got[n]
    assert (first["n_base"], first["first_word"], first["last_word"]) == (3, 3, 7)
    assert first["labels"] == first["base_labels"] == "mit" and first["score"] == 0
    assert got[n + 1]["score"] == 1.0
    assert got[n + 1]["labels"] == "cc-by-nc" and got[n + 1]["base_labels"] == ""
    assert got[n + 2]["labels"] == "" and got[n + 2]["score"] == 0
    assert got[n + 3]["base_labels"] == "gpl"
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None
    assert licenses.scan_licenses(docs_of(texts).limit(0)).collect() == []


def plain_matches(words):
    """Best containment of every template over all windows of a paragraph."""
    want = []
    for label, text, required, *barred in licenses.TEMPLATES:
        spelled = [w.decode() for w in licenses.template_words(text)]
        t, must, never = set(spelled), set(required.split()), set(" ".join(barred).split())
        size = licenses.window_of(len(spelled))
        found = [set(words[k : k + size]) for k, w in enumerate(words) if w in t | never]
        best = max((len(f & t) for f in found if must <= f and not never & f), default=0)
        if best / len(t) >= licenses.THRESHOLD:
            want.append((label, best / len(t)))
    return Counter(want)


def test_license_join_is_exact():
    rnd = random.Random(6)
    known = licenses.vocabulary(licenses.TEMPLATES)
    words = sorted(w.decode() for w in known) + ["x", "y", "z"] * 9
    index = licenses.TemplateIndex({w: rnd.randint(0, 50) for w in known})
    met = 0
    for _ in range(1500):
        text = licenses.template_words(rnd.choice(licenses.TEMPLATES)[1])
        block = [w.decode() for w in text if rnd.random() < 0.93]
        for _ in range(rnd.randint(0, len(block) // 3)):
            block.insert(rnd.randrange(len(block) + 1), rnd.choice(words))
        block = rnd.choices(words, k=rnd.randint(0, 30)) + block + rnd.choices(words, k=5)
        want = plain_matches(block)
        assert Counter(index.matches([w.encode() for w in block])) == want
        met += bool(want)
    assert met > 300


def test_license_families_do_not_mix(spark, docs_of):
    lines = {
        "Released under the Apache license.": "apache",
        "mit dem, released under the Apache license": "apache",
        "license the under released": "",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY 4.0.": "cc-by",
    }
    prose = "mit der und die in den von zu das mit sich des auf f\u00fcr ist im dem nicht"
    texts = list(lines) + [f"{prose}. {line} {prose}\n{prose}" for line in lines]
    got = licenses.scan_licenses(docs_of(texts)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == list(lines.values()) * 2


def test_license_whole_notices(spark, docs_of):
    """Every template is found in itself, wrapped over lines, in no other license's family."""
    texts = []
    for _, text, *_ in licenses.TEMPLATES:
        words = text.split()
        texts.append("\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)))
    got = licenses.scan_licenses(docs_of(texts)).orderBy("doc_id").collect()
    for r, (label, text, *_) in zip(got, licenses.TEMPLATES):
        extra = {"gpl"} if label in ("lgpl", "agpl") else set()  # by the base phrase
        assert set(r["labels"].split(",")) == {label} | extra, text
        assert r["score"] == 1.0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style>
<script>var t="</p>";</script></head><body class="page"><header>Site</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>A &amp; B</h1><p>First  line,<br>goes on.<p><b>Second</b> one.
<aside>Aside.</aside><div class="comments"><p>Reader says so.</p></div></article>
<form><input name=x>Send</form><div class=cookie-notice>We use cookies.</div>
<footer>&copy; me</footer></body></html>"""


def test_html(spark):
    rows = [(k, "u", PAGE, "x") for k in range(30)] + [
        (30, None, None, "x"),
        (31, "u", "", "x"),
        (32, "u", "<main><p>cut <b>off</b> here <a href='", "x"),
        (33, "u", "<div" * 3000 + "<article><p>deep</p></article>", "x"),
        (34, "u", "<div>" * 3000 + "<article><p>deep</p></article>", "x"),
        (34, "u", "<article><script>never closed <p>x", "x"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, _t string")
    got = html_cut.extract(frame).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["text"]) for r in got}
    assert (0, "A & B\n\nFirst line, goes on.\n\nSecond one.") in by
    assert {(30, ""), (31, ""), (32, "cut off here"), (34, "deep"), (34, "")} <= by
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_cut.extract(frame.limit(0)).collect() == []


def test_html_words_and_tags_can_be_outvoted(spark):
    """Ambiguous class words lose no article, unmarked link lists in one are cut out."""
    one, two = "A first sentence, which is long.", "The second sentence, no shorter than that."
    text = f"<h1>Title</h1><p>{one}</p><p>{two}</p>"
    menu = "".join(f"<li><a href=/s{k}>Section {k}</a></li>" for k in range(6))
    rest = f"<nav><ul>{menu}</ul></nav>%s<footer>&copy; me</footer>"
    links = "".join(f"<li><a href=/{k}>Read number {k}</a></li>" for k in range(4))
    pages = [
        f"<div class='content has-sidebar'>{text}</div>",
        f"<div class='page sticky-header'>{text}</div>",
        f"<div class='page sticky-header'><div id=with-sidebar><article>{text}</article></div></div>",
        f"<div class='has-sidebar'><main>{text}</main><div class=sidebar>{links}</div></div>",
        f"<article class='post related'>{text}</article>",
        f"<article><h1>Title</h1><p>{one}</p><ul>{links}</ul><p>{two}</p></article>",
        f"<article>{text}<div><ul>{links}</ul></div></article>",
    ]
    rows = [(-k, "u", rest % f"<article>{text}</article>") for k in range(1, 30)]
    rows += [(k, "u", rest % page) for k, page in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_cut.extract(frame).collect()}
    assert {k: t for k, t in got.items() if t != f"Title\n\n{one}\n\n{two}"} == {}


LONG = "A paragraph of quite ordinary length, with commas and marks, that goes on and then ends."
ARTICLE = f"<article><h1>Title</h1><p>{LONG}</p><p>{LONG} Again.</p></article>"
BESIDE = [
    "<footer>%s</footer>", "<aside>%s</aside>", "<nav>%s</nav>", "<header>%s</header>",
    "<form>%s</form>", "<div class=ad>%s</div>", "<div class=cookie-notice>%s</div>",
    "<div id=sidebar>%s</div>", "<div class=comments>%s</div>", "<div class=post-footer>%s</div>",
    "<section role=complementary>%s</section>", "<ul class=menu><li>%s</li></ul>",
]


@pytest.fixture(scope="module")
def fitted(spark, small):
    """Weights of the given pages."""
    return html_cut.fit(spark.read.parquet(f"{small}/pages.parquet"))


@pytest.mark.parametrize("element", BESIDE)
def test_html_paragraphs_of_boilerplate_stay_out(fitted, element):
    want = f"Title\n\n{LONG}\n\n{LONG} Again."
    other = element % f"<p>{LONG} Not this.</p>"
    plain = f"<div class=content>{ARTICLE[9:-10]}</div>"
    pages = [ARTICLE + other, other + ARTICLE, other + plain, f"<body class=page>{plain}{other}"]
    if "<header" not in element:  # an article's own header holds its title
        pages.append(ARTICLE.replace("</article>", other + "</article>"))
    for page in pages:
        assert html_cut.main_text(page, fitted) == want, page


def test_html_articles_in_forms_and_described_elements(fitted):
    want = f"Title\n\n{LONG}\n\n{LONG} Again."
    inner = ARTICLE[9:-10]
    for page in (
        f"<form action=x>{ARTICLE}</form>",
        f"<form id=page><div class=x>{inner}</div></form>",
        f"<div class=layout-right-sidebar>{inner}</div>",
        f"<div class=has-sidebar>{inner}</div>",
        f"<div class=site-header-fixed><main>{inner}</main></div>",
    ):
        assert html_cut.main_text(page, fitted) == want, page
    assert html_cut.main_text(f"<form><p>{LONG}</p><button>Send</button></form>", fitted) == ""


def test_html_article_keeps_tables_lists_and_formulas(fitted):
    page = (
        f"<article><h1>Title</h1><p>{LONG}</p><ul><li>One</li><li>Two small</li></ul>"
        "<table><tr><th>k</th><td>12</td></tr></table><dl><dt>Term</dt><dd>What</dd></dl>"
        "<p>See <math><mi>x</mi></math> and <object>that</object> there.</p>"
        "<ol><li><a href=/a>A link</a> and words that are not linked</li><li>b</li></ol>"
        "<ul><li><a href=/1>Read one</a></li><li><a href=/2>Read two</a></li></ul></article>"
    )
    blocks = html_cut.main_text(page, fitted).split("\n\n")
    assert blocks[:8] == ["Title", LONG, "One", "Two small", "k", "12", "Term", "What"]
    assert blocks[8:] == ["See x and that there.", "A link and words that are not linked", "b"]


def test_html_boilerplate_stays_boilerplate():
    """Boilerplate tags and names are not undone by words below."""
    low = lambda html: [b.meaning < 0 for b in html_cut.page_blocks(html)]
    assert low("<aside><article><p>x</p></article></aside>") == [True]
    assert low("<div class=comments><article class=comment-body><p>x</p></article></div>") == [True]
    assert low("<article class=comment><p>x</p></article>") == [True]
    assert low("<div class=comments><div class=content><p>x</p></div></div>") == [True]
    assert low("<article><p>x</p><div class=post-footer>y</div></article>") == [False, True]
    deep = html_cut.page_blocks("<div class=ad>" * 9 + "x")
    assert deep[0].meaning == -html_cut.OTHER_EVIDENCE


def test_minimum_cut_equals_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        n = rnd.randint(1, 7)
        odds = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.random()) for _ in range(n)]
        network = html_cut.FlowNetwork(n)
        for i, v in enumerate(odds):
            network.edge(n, i, v) if v > 0 else network.edge(i, n + 1, -v)
        for a, b, w in edges:
            if a != b:
                network.edge(a, b, w, w)

        def cost(main):
            out = sum(max(v, 0) for i, v in enumerate(odds) if i not in main)
            out += sum(max(-v, 0) for i, v in enumerate(odds) if i in main)
            return out + sum(w for a, b, w in edges if (a in main) != (b in main))

        best = min(cost({i for i in range(n) if m >> i & 1}) for m in range(1 << n))
        assert cost(network.source_side() - {n}) == pytest.approx(best)


def test_minimum_cut_of_a_page_with_many_blocks():
    """40,000 blocks of alternating look: the work is not a pass per block."""
    weights = np.zeros(html_cut.N_FEATURES)
    weights[:2] = -1.0, 2.0
    look = "<p>A long sentence, number %d, with marks. And more words after it, too.</p><div>l</div>"
    blocks = html_cut.page_blocks("".join(look % i for i in range(20_000)))
    assert len(blocks) == 40_000
    main = html_cut.labelled(blocks, weights)
    assert len(main) == 40_000 and main == html_cut.labelled(blocks, weights)
    # far from the ends the pattern repeats
    assert len({tuple(main[k : k + 2]) for k in range(1000, 39_000, 2)}) == 1
