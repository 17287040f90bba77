"""Small inputs with known results."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.defaults import FULL, SLIDING, Layout
from stratavec.functions import buckets, ids, naming, vectors
from stratavec.operators import (
    attention,
    gather,
    heads,
    rotary,
    sampling,
    sequences,
    statistics,
    tokens,
)
from stratavec.sources import corpus


def values(spark, name, items, expression, kind="bigint"):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, {name} {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    "size, positions, expected",
    [
        (128, [0, 1, 127, 128, 384], [7, 7, 7, 7, 8]),
        (4, [0, 3, 4, 12], [2, 2, 2, 3]),
        (130, [0, 200, 511], [8, 8, 9]),
        (1, [0, 1, 2, 2**21 - 2, 2**21 - 1], [0, 1, 1, 20, 21]),
    ],
)
def test_log_bucket(spark, size, positions, expected):
    assert values(spark, "p", positions, buckets.log_bucket(F.col("p"), size)) == expected


def test_uniform_bucket(spark):
    bucket = lambda size: buckets.uniform_bucket(F.col("p"), size)
    assert values(spark, "p", [0, 10, 49, 50, 120], bucket(50)) == [0, 0, 0, 1, 2]
    assert values(spark, "p", [256, 257, 258, 259], bucket(32)) == [8] * 4


def test_effective_bucket_size(spark):
    sizes = list(range(1, 600)) + [4096, 4097]
    got = values(spark, "s", sizes, buckets.effective_bucket_size(F.col("s")))
    assert got == [2 ** math.ceil(math.log2(s)) for s in sizes]
    assert 130 in sizes and got[sizes.index(130)] == 256
    assert [1 << buckets.floor_power(s) for s in sizes] == got


def lengths(spark, *counts):
    return spark.createDataFrame(list(enumerate(counts)), "example_id bigint, n_tokens int")


def test_empty_examples_give_no_rows(spark):
    rows = tokens.explode_positions(lengths(spark, 0, 2, 0))
    assert sorted((r.example_id, r.position) for r in rows.collect()) == [(1, 0), (1, 1)]


def offsets(spark, *starts):
    return spark.createDataFrame(
        list(enumerate(starts)), "row_ordinal bigint, start_positions array<bigint>"
    )


def placed(spark, counts, starts):
    frame = lengths(spark, *counts).withColumn("ordinal", F.col("example_id"))
    table = offsets(spark, *starts) if starts is not None else None
    rows = tokens.offset_positions(frame, table).orderBy("example_id").collect()
    return [list(r.positions) for r in rows]


@pytest.mark.parametrize(
    "counts, starts, expected",
    [
        ([2], [[10]], [[10, 11]]),
        ([3, 3], [[5, 6, 7]], [[5, 6, 7]] * 2),
        ([4, 4, 4], None, [[0, 1, 2, 3]] * 3),
        ([2, 2], [[9, 20, 30], [1, 2, 3]], [[9, 20], [1, 2]]),
        ([3, 3, 3], [[0], [7, 9]], [[0, 1, 2], [7, 9, 10], [7, 9, 10]]),
        ([1], [[4], [8], [9]], [[4]]),
    ],
)
def test_offset_positions(spark, counts, starts, expected):
    assert placed(spark, counts, starts) == expected


def test_token_strings(spark):
    text = spark.createDataFrame([(1, " A B\nC ")], "example_id bigint, text string")
    frame = tokens.tokenize(text, 10).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(2))))
    token = tokens.token_at(F.col("tokens"), F.col("position"))
    assert [r[0] for r in frame.orderBy("position").select(token).collect()] == ["A", "B", "C"]
    with pytest.raises(Exception, match="shorter than sequence"):
        frame.select(tokens.token_at(F.col("tokens"), F.lit(3))).collect()


def groups(spark, n, layers=(0,), kinds=("q",), example=1):
    frame = spark.createDataFrame([(example, n)], "example_id bigint, n_tokens int")
    return sampling.sequence_groups(frame, layers, kinds)


def test_probability_is_clamped(spark):
    log = sampling.sampler_by_name("log_uniform", 4.0, 1)
    assert sampling.sample_shared(groups(spark, 7), log).count() == 7
    uniform = sampling.sampler_by_name("uniform", 64.0, 32)
    assert sampling.sample_shared(groups(spark, 6), uniform).count() == 6


def test_row_cap(spark):
    every = sampling.sampler_by_name("all", bucket_size=32)
    rows = sampling.sample_shared(groups(spark, 4), every)
    assert sampling.cap_rows(rows, 1).count() == 1
    for no_cap in (None, 0, -1):
        assert sampling.cap_rows(rows, no_cap).count() == 4


def test_custom_predicate(spark):
    log = sampling.sampler_by_name("log_uniform", bucket_size=1)
    rows = sampling.sample_where(groups(spark, 401), log, lambda p, b: b == 0)
    assert [(r.position, r.bucket) for r in rows.collect()] == [(0, 0)]


MODEL = "model string, num_layers int, q_heads int, k_heads int, layer_types array<string>"


def test_head_sampling_with_grouped_keys(spark):
    models = spark.createDataFrame([("m", 3, 4, 2, [])], MODEL)
    rows = heads.with_sampled_heads(heads.with_candidates(models), 3)
    chosen = [(r.layer, r.head) for r in heads.explode_heads(rows, "selected_q").collect()]
    keys = {(r.layer, r.head) for r in heads.explode_heads(rows, "selected_k").collect()}
    assert len(set(chosen)) == 3
    assert keys == {(layer, head // 2) for layer, head in chosen}
    kinds = heads.selected_heads(rows).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"q": 3, "k": len(keys)}


def test_full_attention_candidates(spark):
    models = spark.createDataFrame([("m", 4, 4, 2, [SLIDING, FULL] * 2)], MODEL)
    rows = heads.with_sampled_heads(heads.with_candidates(models, full_attention_only=True), 8)
    assert {r.layer for r in heads.explode_heads(rows, "candidates").collect()} == {1, 3}
    summary = heads.head_sampling_summary(rows, 8).first()
    assert (summary.selected_q, summary.excluded_sliding, summary.full_layers) == (8, 8, 2)


def capture_grid(spark):
    """One row per layer, kind and head: layer 0 has window 64, layer 1 none."""
    rows = [
        (1, layer, head, kind, 64 if layer == 0 else None)
        for layer in (0, 1)
        for kind, n in (("q", 4), ("k", 2))
        for head in range(n)
    ]
    return spark.createDataFrame(
        rows, "example_id bigint, layer int, head int, kind string, sliding_window int"
    )


def names(rows):
    name = naming.config_name(F.col("layer"), F.col("head"), F.col("kind"))
    return {r[0] for r in rows.select(name).collect()}


def test_filters(spark):
    grid = capture_grid(spark)
    assert names(heads.filter_layers_heads(grid, Layout(), {1}, {0})) == {"l01h00q", "l01h00k"}
    selected = spark.createDataFrame(
        [(0, 1, "q"), (0, 2, "q"), (0, 0, "k"), (0, 1, "k")], "layer int, head int, kind string"
    )
    assert names(heads.filter_selected_heads(grid, selected)) == {
        "l00h01q", "l00h02q", "l00h00k", "l00h01k",
    }
    assert {n[:3] for n in names(heads.filter_full_attention(grid))} == {"l01"}
    assert {n[-1] for n in names(heads.filter_kind(grid, queries=False))} == {"k"}
    assert heads.filter_kind(grid, False, False).count() == 0


def test_layout_from_config(spark):
    configs = [
        ('{"num_hidden_layers": 2, "num_attention_heads": 4}', (2, 4, 4)),
        ('{"num_hidden_layers": "2", "num_attention_heads": 4, "num_key_value_heads": 2}', (2, 4, 2)),
        # no field-wise mixing: the root lacks heads, the nested part wins whole
        ('{"num_hidden_layers": 9, "llm_config": {"num_hidden_layers": 2, "num_attention_heads": 8}}', (2, 8, 8)),
        # breadth first: decoder_config at depth one before anything at depth two
        (
            '{"text_config": {"llm_config": {"num_hidden_layers": 5, "num_attention_heads": 5}},'
            ' "decoder_config": {"num_hidden_layers": 3, "num_attention_heads": 3}}',
            (3, 3, 3),
        ),
        # an explicit null key count disqualifies the candidate
        (
            '{"num_hidden_layers": 9, "num_attention_heads": 9, "num_key_value_heads": null,'
            ' "text_config": {"num_hidden_layers": 1, "num_attention_heads": 2}}',
            (1, 2, 2),
        ),
    ]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(configs)], "model int, config string")
    rows = heads.head_layout(frame).orderBy("model").collect()
    assert [(r.num_layers, r.q_heads, r.k_heads) for r in rows] == [c[1] for c in configs]


def test_id_hash_and_wrap(spark):
    texts = ["id-a", "42", "naïve", ""]
    expected = [
        int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True)
        for t in texts
    ]
    assert values(spark, "s", texts, ids.blake2b_id(F.col("s")), "string") == expected
    numbers = [2**31, 2**32 + 7, -1, 2**63 - 1, -(2**63), 5]
    assert values(spark, "n", numbers, ids.wrap_int32(F.col("n"))) == [-(2**31), 7, -1, -1, 0, 5]


def test_id_of_each_type(spark):
    check = lambda items, kind, type_: values(
        spark, "x", items, ids.normalize_example_id(F.col("x"), type_), kind
    )
    assert check([True, False], "boolean", T.BooleanType()) == [1, 0]
    assert check([3.0, -2.0], "double", T.DoubleType()) == [3, -2]
    md5 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    assert check([2.5, 1e30], "double", T.DoubleType()) == [md5("2.5"), md5("1.0E30")]
    assert check(["42"], "string", T.StringType()) == [md5("42")]


def test_config_names_with_three_digits(spark):
    frame = spark.createDataFrame([(100, 7, "q")], "layer int, head int, kind string")
    name = naming.config_name(F.col("layer"), F.col("head"), F.col("kind"))
    row = frame.select(name.alias("c")).select("c", *naming.config_parts(F.col("c"))).first()
    assert tuple(row) == ("l100h07q", 100, 7, "q")


def one_vector(spark, items):
    return spark.createDataFrame([(list(map(float, items)), 3)], "v array<float>, position int")


def test_rotations_keep_length_and_match_formula(spark):
    frame = one_vector(spark, [1, 2, 3, 4])
    halves, pairs = frame.select(
        vectors.rotate_halves(F.col("v"), F.col("position"), 4, 10000.0),
        vectors.rotate_pairs(F.col("v"), F.col("position"), 4, 2, 10000.0),
    ).first()
    a, b = 3.0, 3.0 * 10000.0 ** (-0.5)
    assert halves == pytest.approx(
        [
            math.cos(a) - 3 * math.sin(a),
            2 * math.cos(b) - 4 * math.sin(b),
            3 * math.cos(a) + math.sin(a),
            4 * math.cos(b) + 2 * math.sin(b),
        ]
    )
    assert pairs == pytest.approx(
        [math.cos(a) - 2 * math.sin(a), 2 * math.cos(a) + math.sin(a), 3, 4]
    )


def test_both_ways_to_rotate_agree(spark):
    """Fixed base written out, base from a column as a loop over the entries."""
    items = [float((7 * i) % 11 - 5) for i in range(16)]
    frame = one_vector(spark, items).withColumn("theta", F.lit(10000.0) + F.rand() * 0)
    for fixed, looped in (
        [vectors.rotate_halves(F.col("v"), F.col("position"), 16, t) for t in (10000.0, F.col("theta"))],
        [vectors.rotate_pairs(F.col("v"), F.col("position"), 16, 8, t) for t in (10000.0, F.col("theta"))],
    ):
        a, b = frame.select(fixed, looped).first()
        assert a == pytest.approx(b)
        assert sum(x * x for x in a) == pytest.approx(sum(x * x for x in items))


def test_vector_formulas(spark):
    frame = one_vector(spark, [3, 4])
    norm, plus, scale, cap = frame.select(
        vectors.rms_norm(F.col("v"), [1.0, 0.5], 0.0),
        vectors.rms_norm(F.col("v"), [1.0, 0.5], 0.0, one_plus_weight=True),
        vectors.query_scale(F.lit(600), 0.1, 256),
        vectors.soft_cap(F.lit(30.0), 50.0),
    ).first()
    rms = math.sqrt(12.5)
    assert norm == pytest.approx([3 / rms, 2 / rms])
    assert plus == pytest.approx([6 / rms, 6 / rms])
    assert scale == pytest.approx(1 + 0.1 * math.log(3))
    assert cap == pytest.approx(50 * math.tanh(0.6))


def test_window_conflict(spark):
    layers = spark.createDataFrame([(0, 64), (1, None)], "layer int, sliding_window int")
    rows = capture_grid(spark).drop("sliding_window")
    tagged = gather.tag_sliding_window(rows, layers)
    assert gather.window_conflicts(tagged).count() == 0
    assert gather.window_conflicts(tagged.unionByName(
        tagged.filter("layer = 1").withColumn("sliding_window", F.lit(8))
    )).count() == 2


def test_batch_encoder(spark):
    import numpy as np

    rows = spark.createDataFrame(
        [("ab", 1, "q", 0), ("c", 2, "k", 5)],
        "token_str string, layer int, kind string, position int",
    )
    model = lambda text, layer, kind, position: np.array(
        [[len(t), l, p] for t, l, p in zip(text, layer, position)]
    )
    got = gather.BatchEncoder(model).encode(rows).orderBy("layer").collect()
    assert [list(r.flat) for r in got] == [[2.0, 1.0, 0.0], [1.0, 2.0, 5.0]]


def test_sequence_encoder(spark):
    import numpy as np

    rows = spark.createDataFrame(
        [(7, 1, "q", 2, "x"), (7, 0, "k", 0, "y"), (8, 1, "q", 1, "z")],
        "example_id long, layer int, kind string, position int, note string",
    )
    examples = spark.createDataFrame(
        [(7, ["a", "bb", "ccc"]), (8, ["d", "ee"]), (9, [])],
        "example_id long, tokens array<string>",
    )
    # depends on the token before
    model = lambda words, layer, kind, at: np.array(
        [[len(words[p]), len(words[p - 1]) if p else 0, layer] for p in at]
    )
    got = sequences.SequenceEncoder(model, examples).encode(rows)
    assert got.columns == [*rows.columns, "flat"]
    assert {r.note: r.flat for r in got.collect()} == {
        "x": [3.0, 2.0, 1.0], "y": [1.0, 0.0, 0.0], "z": [2.0, 1.0, 1.0]
    }
    with pytest.raises(Exception, match="without tokens"):
        sequences.SequenceEncoder(model, examples.filter("example_id = 8")).encode(rows).collect()


def test_softmax_of_far_apart_logits(spark):
    logits = {0: [0.0], 1: [1.0, 2.0], 2: [-900.0, 900.0, 899.0], 3: [249.0, 251.0], 4: [3000.0] * 3}
    frame = spark.createDataFrame(
        [(1, 0, 0, q, z) for q, zs in logits.items() for z in zs],
        "example_id bigint, layer int, head int, q_position int, logit double",
    )
    for row in attention.softmax_terms(frame).collect():
        zs = logits[row.q_position]
        assert row["shift"] == max(zs) and row["n_keys"] == len(zs)
        assert row["total"] == pytest.approx(sum(math.exp(z - max(zs)) for z in zs))
        assert row["weighted_logit"] == pytest.approx(sum(z * math.exp(z - max(zs)) for z in zs))


def test_card_lines(spark):
    first = spark.createDataFrame([(2, 1)], "bucket int, n_rows bigint")
    later = spark.createDataFrame([(5, 1)], "bucket int, n_rows bigint")
    ledger = statistics.add_to_ledger(statistics.add_to_ledger(None, first), later)
    row = statistics.bucket_line(ledger.withColumn("branch", F.lit("b")), "branch").first()
    assert (row.bucket_line, row.n_rows) == ("b2=1, b5=1", 2)
    # a config written again by a second session is counted twice
    twice = statistics.add_to_ledger(ledger, later).filter("bucket = 5").first()
    assert twice.n_rows == 2
    shown = values(spark, "x", ["64.0", "1.5", None, "abc"], statistics.plain_number(F.col("x")), "string")
    assert shown == ["64", "1.5", "unknown", "abc"]


def test_take_and_ordinals(spark):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("key")).repartition(5)
    assert {r.key for r in corpus.corpus_take(frame, "key", 10).collect()} == set(range(10))
    numbered = corpus.with_ordinal(frame, "key").collect()
    assert all(r.key == r.ordinal for r in numbered) and len(numbered) == 1000
    assert corpus.with_ordinal(frame.limit(0), "key").count() == 0


def test_take_beyond_the_topk_limit(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TOPK_LIMIT", 5)
    frame = spark.range(100).withColumnRenamed("id", "key").repartition(4)
    assert {r.key for r in corpus.corpus_take(frame, "key", 30).collect()} == set(range(30))


def test_rotary_capture(spark):
    """Layer 0 rotates, layer 1 does not; only queries are scaled."""
    capture = spark.createDataFrame(
        [(layer, kind, 4, [1.0, 0.0]) for layer in (0, 1) for kind in ("q", "k")],
        "layer int, kind string, position int, vector array<float>",
    )
    layers = spark.createDataFrame(
        [(0, 10000.0, True), (1, 10000.0, False)], "layer int, rope_theta double, use_rope boolean"
    )
    layout = Layout(q_heads=1, k_heads=1, head_dim=2, layer_types=(FULL, FULL))
    for rotary_dim in (None, 2):  # one pair only: both pairings agree
        turned = rotary.rotate_capture(capture, layers, layout, rotary_dim)
        scaled = rotary.scale_queries(turned, 0.5, 2)
        got = {(r.layer, r.kind): list(r.vector) for r in scaled.collect()}
        factor = 1 + 0.5 * math.log(3)
        turn = [math.cos(4), math.sin(4)]
        assert got[(0, "k")] == pytest.approx(turn)
        assert got[(0, "q")] == pytest.approx([factor * x for x in turn])
        assert got[(1, "k")] == [1.0, 0.0]
        assert got[(1, "q")] == pytest.approx([factor, 0.0])


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc", "csv", "table"])
def test_corpus_formats(spark, tmp_path, fmt):
    texts = [(1, "a b"), (2, "c"), (3, "")]
    frame = spark.createDataFrame(texts, "name int, body string")
    path = str(tmp_path / "corpus")
    if fmt == "table":
        path = "corpus_view"
        frame.createOrReplaceTempView(path)
    else:
        frame.write.format(fmt).option("emptyValue", "").save(path)
    schema = "name int, body string" if fmt in ("json", "csv") else None
    rows = corpus.scan_corpus(spark, path, "name", "body", fmt, schema=schema)
    assert rows.columns == ["example_id", "text"]
    assert sorted((r.example_id, r.text or "") for r in rows.collect()) == texts


@pytest.mark.parametrize("dim", [15, 16, 17, 64, 128])
def test_width_contract(spark, dim):
    """Every vector function takes exactly the stated width, wide or narrow."""
    from stratavec.functions import vectors as V

    even = dim - dim % 2
    calls = {
        "dot": lambda v: V.dot(v, v, dim),
        "halves": lambda v: V.rotate_halves(v, F.lit(3), even, 10000.0),
        "pairs": lambda v: V.rotate_pairs(v, F.lit(3), even, even // 2 // 2 * 2, 10000.0),
        "norm": lambda v: V.rms_norm(v, [1.0] * dim, 1e-6),
    }
    values = [((i * 7) % 5 - 2) / 2 for i in range(dim + 1)]
    frame = spark.createDataFrame([(values,)], "v array<float>")
    for name, call in calls.items():
        width = even if name in ("halves", "pairs") else dim
        out = frame.select(call(F.slice("v", 1, width)).alias("o")).first()["o"]
        if name == "dot":
            assert out == pytest.approx(sum(x * x for x in values[:dim]))
        elif name == "norm":
            assert len(out) == dim
        else:
            assert sum(x * x for x in out) == pytest.approx(sum(x * x for x in values[:even]))
        for wrong in (width - 1, width + 1):
            if wrong <= len(values):
                with pytest.raises(Exception, match="entries expected"):
                    frame.select(call(F.slice("v", 1, wrong)).alias("o")).collect()
    angle = [3 * 10000.0 ** (-2 * i / even) for i in range(even // 2)]
    got = frame.select(calls["halves"](F.slice("v", 1, even)).alias("o")).first()["o"]
    for i, a in enumerate(angle):
        x, y = values[i], values[i + even // 2]
        assert got[i] == pytest.approx(x * math.cos(a) - y * math.sin(a), abs=1e-9)
        assert got[i + even // 2] == pytest.approx(y * math.cos(a) + x * math.sin(a), abs=1e-9)


def test_flat_vector_of_another_width_is_an_error(spark):
    frame = spark.createDataFrame([([1.0] * 40,)], "flat array<float>")
    with pytest.raises(Exception, match="64 entries expected"):
        gather.split_heads(frame, 4, 16).collect()


def test_missing_vector_is_an_error(spark):
    sampled = spark.createDataFrame([(1, 0, "q", 0), (1, 0, "q", 5)], "example_id long, layer int, kind string, position int")
    known = spark.createDataFrame([(1, 0, "q", 0, [1.0])], "example_id long, layer int, kind string, position int, vector array<float>")
    with pytest.raises(Exception, match="no vector for"):
        gather.gather_vectors(sampled, known).collect()
    gaps = spark.createDataFrame([(0, [1.0] * 64), (2, [1.0] * 64), (5, [1.0] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="vector ids must be"):
        gather.LookupEncoder.over(gaps)


def test_layer_with_two_rows_is_an_error(spark):
    rows = spark.createDataFrame([(1,)], "layer int")
    layers = spark.createDataFrame([(1, 4), (1, 5)], "layer int, sliding_window int")
    with pytest.raises(Exception, match="more than one row for layer 1"):
        rows.join(rotary.bounded_layers(layers, "sliding_window"), "layer").collect()


def test_deeply_nested_layout_and_whole_floats(spark):
    inner = '{"num_hidden_layers": 2.0, "num_attention_heads": 4, "num_key_value_heads": 2}'
    config = '{"text_config": {"llm_config": {"decoder_config": %s}}}' % inner
    row = heads.head_layout(spark.createDataFrame([("m", config)], "model string, config string")).first()
    assert (row["num_layers"], row["q_heads"], row["k_heads"]) == (2, 4, 2)


def test_causal_tiles_match_brute_force(spark):
    layout = Layout(q_heads=2, k_heads=1, head_dim=2, layer_types=(FULL,))
    n, tile = 23, 4
    rows = [(1, 0, h, "q", p, [float(p), 1.0]) for h in range(2) for p in range(n)]
    rows += [(1, 0, 0, "k", p, [1.0, float(p)]) for p in range(n + 6)]
    capture = spark.createDataFrame(rows, "example_id long, layer int, head int, kind string, position int, vector array<float>")
    q, k = attention.query_side(capture, layout), attention.key_side(capture)
    got = {(r["head"], r["q_position"], r["k_position"]): r["logit"] for r in attention.causal_pairs(q, k, layout, tile=tile).collect()}
    want = {(h, a, b): (a + b) / math.sqrt(2) for h in range(2) for a in range(n) for b in range(a + 1)}
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x]) for x in want)
