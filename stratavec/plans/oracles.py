"""The registered queries as DuckDB SQL, to check the Spark results.

Shared steps are named common table expressions; ``_sql`` adds those a query
needs, in order.
"""

from __future__ import annotations

from itertools import product

from stratavec import defaults as D

# written out, not imported, so that a wrong value in the code cannot hide
MULTIPLIER = 73244475
NESTED_FIELDS = ("text_config", "language_config", "llm_config", "decoder_config")
KNOWN_KEYS = (
    "source_dataset",
    "dataset_name",
    "dataset_split",
    "attention_scope",
    "sampling_strategy",
    "sampling_min_bucket_size",
    "sampling_bucket_size",
    "distributed_world_size",
)
RMS_WEIGHTS = [0.5 + i / 16 for i in range(16)]

SIZE = D.SETTINGS.bucket_size
POWER = (SIZE - 1).bit_length()
DIM = D.LAYOUT.head_dim
SLIDING_SET = "(1, 3)"
MASK = 2147483647


def _r4(value: str) -> str:
    return f"(CASE WHEN round({value}, 4) = 0 THEN 0.0::DOUBLE ELSE round({value}, 4) END)"


def _seeds(digest: str) -> str:
    return (
        f"('0x' || substr({digest}, 1, 7))::BIGINT AS s1, "
        f"('0x' || substr({digest}, 8, 7))::BIGINT AS s2"
    )


def _draws(prefix: str, source: str, columns: str) -> dict[str, str]:
    """Steps that turn rows with s1, s2 and position into rows with a draw u."""
    return {
        f"{prefix}_m": f"SELECT {columns}, s2, xor(s1, position) AS m FROM {source}",
        f"{prefix}_x": f"SELECT {columns}, xor((xor(m, m >> 16) * {MULTIPLIER}) & {MASK}, s2) AS x FROM {prefix}_m",
        f"{prefix}_y": f"SELECT {columns}, (xor(x, x >> 16) * {MULTIPLIER}) & {MASK} AS y FROM {prefix}_x",
        prefix: f"SELECT {columns}, xor(y, y >> 16) / 2147483648.0::DOUBLE AS u FROM {prefix}_y",
    }


LOG_BUCKET = f"greatest(length(ltrim(bin(position + 1), '0')) - 1, {POWER})"
GROUP = "example_id, layer, kind"


def _sampled(source: str, strategy: str) -> str:
    columns = f"{GROUP}, position::INT AS position"
    if strategy == "uniform":
        return f"SELECT {columns}, (position // {SIZE})::INT AS bucket FROM {source} WHERE u < 1.0::DOUBLE / {SIZE}"
    if strategy == "all":
        return f"SELECT {columns}, (position // {SIZE})::INT AS bucket FROM {source}"
    return (
        f"SELECT {columns}, {LOG_BUCKET}::INT AS bucket FROM {source} "
        f"WHERE u < least(1.0::DOUBLE, 1.0::DOUBLE / (1::BIGINT << {LOG_BUCKET}))"
    )


def _capture(prefix: str, sampled: str) -> dict[str, str]:
    """Steps from sampled positions to rows of head vectors."""
    return {
        f"{prefix}_tok": (
            f"SELECT s.*, t.tokens[s.position + 1] AS token_str, "
            f"CASE WHEN layer IN {SLIDING_SET} THEN {D.LAYOUT.sliding_window} END::INT AS sliding_window "
            f"FROM {sampled} s JOIN tok t USING (example_id)"
        ),
        f"{prefix}_key": (
            f"SELECT *, ('0x' || substr(digest, 1, 15))::BIGINT "
            f"% (SELECT count(*) FROM embeddings) AS vec_id, "
            f"('0x' || substr(digest, 16, 7))::BIGINT % 2 * 32 AS k_from FROM "
            f"(SELECT *, md5(concat_ws('|', token_str, layer, kind)) AS digest FROM {prefix}_tok)"
        ),
        f"{prefix}_enc": (
            f"SELECT k.*, CASE WHEN kind = 'q' THEN e.embedding::DOUBLE[] "
            f"ELSE (e.embedding::DOUBLE[])[k_from + 1 : k_from + 32] "
            f"END AS flat FROM {prefix}_key k LEFT JOIN embeddings e USING (vec_id)"
        ),
        f"{prefix}_head": (
            f"SELECT *, unnest(range(CASE WHEN kind = 'q' THEN {D.LAYOUT.q_heads} "
            f"ELSE {D.LAYOUT.k_heads} END))::INT AS head FROM {prefix}_enc"
        ),
        prefix: (
            f"SELECT {GROUP}, head, position, bucket, token_str, sliding_window, "
            f"printf('l%02dh%02d%s', layer, head, kind) AS config, "
            f"flat[head * {DIM} + 1 : head * {DIM} + {DIM}] AS v FROM {prefix}_head"
        ),
    }


def _json_paths(depth: int = 2) -> list[str]:
    paths = ["$"]
    for d in range(1, depth + 1):
        paths += ["$." + ".".join(p) for p in product(NESTED_FIELDS, repeat=d)]
    return paths


def _layout_columns() -> str:
    """First usable candidate as a struct, and the first long enough type list."""
    layouts = []
    for path in _json_paths():
        number = lambda f: f"TRY_CAST(json_extract_string(config, '{path}.{f}') AS INT)"
        n_layers, q = number("num_hidden_layers"), number("num_attention_heads")
        k = (
            f"(CASE WHEN json_type(config, '{path}.num_key_value_heads') IS NULL "
            f"THEN {q} ELSE {number('num_key_value_heads')} END)"
        )
        layouts.append(
            f"CASE WHEN {n_layers} > 0 AND {q} > 0 AND {k} > 0 "
            f"THEN {{'n': {n_layers}, 'q': {q}, 'k': {k}}} END"
        )
    return f"coalesce({', '.join(layouts)})"


def _types_column() -> str:
    lists = [
        f"CASE WHEN json_array_length(config, '{p}.layer_types') >= num_layers "
        f"THEN CAST(json_extract(config, '{p}.layer_types') AS VARCHAR[]) END"
        for p in _json_paths()
    ]
    return f"coalesce({', '.join(lists)}, CAST([] AS VARCHAR[]))"


_BODY = '"num_hidden_layers": %d, "num_attention_heads": %d, "num_key_value_heads": %d, "layer_types": [%s]'
_BARE = '"num_hidden_layers": %d, "num_attention_heads": %d, "layer_types": [%s]'

CTES: dict[str, str] = {
    "tok": (
        "SELECT doc_id AS example_id, lang, "
        "regexp_extract_all(text, '\\S+') AS tokens FROM documents"
    ),
    "lens": "SELECT example_id, len(tokens) AS n FROM tok WHERE len(tokens) > 0",
    "pos": "SELECT example_id, unnest(range(n)) AS position FROM lens",
    "layers": "SELECT unnest(range(4))::INT AS layer",
    "kinds": "SELECT unnest(['q', 'k']) AS kind",
    "grp": f"SELECT example_id, n, layer, kind, md5(concat_ws('|', 0, {GROUP})) AS h FROM lens, layers, kinds",
    "seeded": f"SELECT {GROUP}, n, {_seeds('h')} FROM grp",
    "spots": f"SELECT {GROUP}, s1, s2, unnest(range(n)) AS position FROM seeded",
    **_draws("drawn", "spots", f"{GROUP}, position"),
    "uni": _sampled("drawn", "uniform"),
    "log": _sampled("drawn", "log"),
    "every": _sampled("drawn", "all"),
    # draw of the row cap
    "cap_seed": f"SELECT *, md5(concat_ws('|', 0, {GROUP}, 'cap')) AS h FROM uni",
    "cap_spot": f"SELECT {GROUP}, position, bucket, {_seeds('h')} FROM cap_seed",
    **_draws("cap_drawn", "cap_spot", f"{GROUP}, position, bucket"),
    # draw per head
    "hgrp": (
        "SELECT *, md5(concat_ws('|', 0, example_id, layer, kind, head)) AS h FROM "
        f"(SELECT {GROUP}, n, unnest(range(CASE WHEN kind = 'q' THEN {D.LAYOUT.q_heads} "
        f"ELSE {D.LAYOUT.k_heads} END))::INT AS head FROM lens, layers, kinds)"
    ),
    "hspots": f"SELECT *, unnest(range(n)) AS position FROM (SELECT {GROUP}, head, n, {_seeds('h')} FROM hgrp)",
    **_draws("hdrawn", "hspots", f"{GROUP}, head, position"),
    **_capture("cap", "uni"),
    **_capture("caplog", "log"),
    "heads": (
        "SELECT 'q' AS kind, unnest(range(4))::INT AS head UNION ALL "
        "SELECT 'k', unnest(range(2))::INT"
    ),
    # head selection of the default layout
    "picked": (
        "SELECT layer, head FROM layers, (SELECT unnest(range(4))::INT AS head) "
        f"ORDER BY md5(concat_ws('|', 0, 'default', layer, head)), layer, head LIMIT {D.HEAD_SAMPLE}"
    ),
    "selected": (
        "SELECT layer, head, 'q' AS kind FROM picked UNION "
        "SELECT layer, head // 2, 'k' FROM picked"
    ),
    # attention sides
    "qs": f"SELECT example_id, layer, head, (head // {D.LAYOUT.queries_per_key})::INT AS key_head, position AS q_position, v AS qv FROM cap WHERE kind = 'q'",
    "ks": "SELECT example_id, layer, head AS key_head, position AS k_position, v AS kv FROM cap WHERE kind = 'k'",
    # runs of tokens without a full stop
    "stops": (
        "SELECT example_id, position, NOT contains(token, '.') AS flag FROM (SELECT example_id, "
        "unnest(tokens) AS token, unnest(range(len(tokens))) AS position FROM tok)"
    ),
    "tokruns": (
        "SELECT example_id, position, sum(opens) OVER (PARTITION BY example_id ORDER BY position "
        "ROWS UNBOUNDED PRECEDING) AS run, flag FROM (SELECT *, (flag AND NOT coalesce(lag(flag) OVER "
        "(PARTITION BY example_id ORDER BY position), false))::INT AS opens FROM stops)"
    ),
    "inrun": "SELECT example_id, position, run FROM tokruns WHERE flag",
    "runpairs": (
        "SELECT q.*, k.k_position, k.kv, rq.run AS q_run, rk.run AS k_run FROM qs q "
        "LEFT JOIN inrun rq ON rq.example_id = q.example_id AND rq.position = q.q_position "
        "JOIN ks k ON q.example_id = k.example_id AND q.layer = k.layer AND q.key_head = k.key_head "
        "LEFT JOIN inrun rk ON rk.example_id = k.example_id AND rk.position = k.k_position"
    ),
    "pairs": (
        "SELECT q.example_id, q.layer, q.head, q.key_head, q_position, k_position, "
        f"list_dot_product(qv, kv) * pow({DIM}::DOUBLE, -0.5) AS logit FROM qs q JOIN ks k "
        "ON q.example_id = k.example_id AND q.layer = k.layer AND q.key_head = k.key_head "
        "AND k_position <= q_position"
    ),
    # model catalogue
    "shapes": (
        "SELECT p_partkey AS model, 3 + p_size % 6 AS n_layers, 1 + p_partkey % 3 AS n_keys, "
        "1 + p_size % 4 AS grp, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS short_by FROM part"
    ),
    "bodies": (
        "SELECT model, "
        f"printf('{_BODY}', n_layers, n_keys * grp, n_keys, types) AS body, "
        f"printf('{_BARE}', n_layers, n_keys * grp, types) AS bare FROM ("
        "SELECT *, array_to_string([CASE WHEN (i + model) % 3 = 0 THEN '\"full_attention\"' "
        "ELSE '\"sliding_attention\"' END for i in range(n_layers - short_by)], ', ') AS types FROM shapes)"
    ),
    "configs": (
        "SELECT model, CASE model % 6 WHEN 0 THEN '{' || body || '}' "
        "WHEN 1 THEN '{\"num_hidden_layers\": 1, \"text_config\": {' || body || '}}' "
        "WHEN 2 THEN '{\"language_config\": {' || bare || '}}' "
        "WHEN 3 THEN '{\"num_hidden_layers\": \"auto\", \"num_attention_heads\": 8, \"llm_config\": {' || body || '}}' "
        "WHEN 4 THEN '{\"text_config\": {\"num_hidden_layers\": 3, \"num_attention_heads\": 0, \"decoder_config\": {' || body || '}}}' "
        "ELSE '{\"num_hidden_layers\": 9, \"num_attention_heads\": 8, \"num_key_value_heads\": null, \"decoder_config\": {' || body || '}}' "
        "END::JSON AS config FROM bodies"
    ),
    "found": f"SELECT model, config, {_layout_columns()} AS l FROM configs",
    "laid": "SELECT model, config, l.n AS num_layers, l.q AS q_heads, l.k AS k_heads FROM found",
    "models": f"SELECT model, num_layers, q_heads, k_heads, {_types_column()} AS types FROM laid",
    "mlayers": "SELECT model, num_layers, q_heads, k_heads, types, unnest(range(num_layers))::INT AS layer FROM models",
    "mflags": f"SELECT *, coalesce(types[layer + 1] = '{D.SLIDING}', false) AS sliding FROM mlayers",
    "mgrid": "SELECT model, layer, sliding, q_heads // k_heads AS grp, unnest(range(q_heads))::INT AS head FROM mflags",
    "mcand": "SELECT * FROM mgrid WHERE NOT sliding",
    "mrank": (
        "SELECT *, row_number() OVER (PARTITION BY model ORDER BY "
        "md5(concat_ws('|', 0, model, layer, head)), layer, head) AS rn FROM mcand"
    ),
    "mq": f"SELECT model, layer, head, grp FROM mrank WHERE rn <= {D.HEAD_SAMPLE}",
    "mk": "SELECT DISTINCT model, layer, (head // grp)::INT AS head FROM mq",
    # branches
    "branched": "SELECT 'uniform' AS branch, * FROM cap UNION ALL SELECT 'log', * FROM caplog",
    # conversations
    "flags": "SELECT conv_id, turn, role, role = 'user' AS flag FROM conversations",
    "starts": (
        "SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER (PARTITION BY conv_id ORDER BY turn), false) "
        "THEN 1 ELSE 0 END AS opens FROM flags"
    ),
    "runs": (
        "SELECT conv_id, turn, role, CASE WHEN flag THEN sum(opens) OVER (PARTITION BY conv_id ORDER BY turn "
        "ROWS UNBOUNDED PRECEDING) - 1 ELSE -1 END::INT AS run_group FROM starts"
    ),
}


def _needed(text: str) -> set[str]:
    """Names of the common table expressions a text mentions, transitively."""
    import re

    names: set[str] = set()
    todo = [text]
    while todo:
        for word in set(re.findall(r"\b[a-z_]+\b", todo.pop())):
            if word in CTES and word not in names:
                names.add(word)
                todo.append(CTES[word])
    return names


def _sql(text: str) -> str:
    used = _needed(text)
    steps = [f"{name} AS ({CTES[name]})" for name in CTES if name in used]
    return f"WITH {', '.join(steps)} {text}" if steps else text


def _digest(v: str, dim: int = DIM) -> str:
    weights = f"[(i + 1)::DOUBLE for i in range({dim})]"
    return (
        f"{_r4(f'{v}[1]')} AS first_value, {_r4(f'{v}[{dim}]')} AS last_value, "
        f"{_r4(f'list_dot_product({v}, {weights})')} AS weighted_sum"
    )


KEY = "example_id, layer, head, kind, position"
SPAN = (
    "count(*) AS n_rows, min(position)::{t} AS first_position, max(position)::{t} AS last_position"
)
POSITION_SUM = "count(*) AS n_rows, sum(position)::BIGINT AS position_sum"
STORED_COUNTS = (
    f"config, {POSITION_SUM}, count(sliding_window) AS n_windows, count(token_str) AS n_tokens"
)
STORED_ROWS = f"config, example_id, position, bucket, sliding_window, token_str, {_digest('v')}"
LOGIT_ROWS = (
    "example_id, layer, head, q_position, count(*) AS n_keys, "
    f"{_r4('max(logit)')} AS max_logit, {_r4('min(logit)')} AS min_logit, "
    f"{_r4('sum(logit)')} AS sum_logit"
)
HEAD_KEYS = f"SELECT {KEY}, bucket FROM cap"


def _length_class() -> str:
    return "CASE WHEN n_chars >= 5000 THEN 'long' WHEN n_chars >= 1500 THEN 'medium' ELSE 'short' END"


def _md5_id(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _wrap(value: str) -> str:
    return f"(xor({value} & 4294967295, 2147483648) - 2147483648)::INT"


def _angle(i: str, dim: int, theta: str) -> str:
    return f"(position * pow({theta}, -2.0::DOUBLE * ({i}) / {dim}))"


def _halves(theta: str) -> str:
    half = DIM // 2
    low = _angle("i", DIM, theta)
    high = _angle(f"i - {half}", DIM, theta)
    return (
        f"[CASE WHEN i < {half} THEN v[i + 1] * cos({low}) - v[i + {half + 1}] * sin({low}) "
        f"ELSE v[i + 1] * cos({high}) + v[i - {half - 1}] * sin({high}) END for i in range({DIM})]"
    )


def _interleaved(rotary: int, theta: str) -> str:
    angle = _angle("i // 2", rotary, theta)
    return (
        f"[CASE WHEN i >= {rotary} THEN v[i + 1] "
        f"WHEN i % 2 = 0 THEN v[i + 1] * cos({angle}) - v[i + 2] * sin({angle}) "
        f"ELSE v[i + 1] * cos({angle}) + v[i] * sin({angle}) END for i in range({DIM})]"
    )


def _rms(weights: list[float]) -> str:
    factors = ", ".join(f"{w}::DOUBLE" for w in weights)
    scale = f"sqrt(list_dot_product(v, v) / {DIM} + {D.RMS_EPS}::DOUBLE)"
    return f"[v[i + 1] / {scale} * ([{factors}])[i + 1] for i in range({DIM})]"


def _vector_query(out: str, where: str = "") -> str:
    return f"SELECT {KEY}, {_digest('o')} FROM (SELECT {KEY}, {out} AS o FROM cap {where})"


def _window_query(condition: str) -> str:
    return (
        "SELECT q.example_id, q.layer, q.head, q.key_head, q_position, k_position, "
        f"{_r4(f'list_dot_product(qv, kv) * pow({DIM}::DOUBLE, -0.5)')} AS logit "
        "FROM qs q JOIN ks k ON q.example_id = k.example_id AND q.layer = k.layer "
        f"AND q.key_head = k.key_head AND {condition} WHERE q.layer IN {SLIDING_SET}"
    )


# fixed values: start words and message order of the hash (RFC 7693)
_BLAKE2B_START = (
    0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1,
    0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179,
)
_BLAKE2B_ORDER = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3),
    (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13),
    (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11),
    (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)


def _blake2b_steps() -> str:
    """384 steps ``[p, q, s, z, r]``: p grows by q and message word z, then s is
    xor-ed with p and turned by r.  Places 1 .. 16 are the state, 17 .. 32 the message."""
    corners = [(i, 4 + i, 8 + i, 12 + i) for i in range(4)]
    corners += [(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4)]
    steps = []
    for turn in range(12):
        order = _BLAKE2B_ORDER[turn % len(_BLAKE2B_ORDER)]
        for k, (a, b, c, d) in enumerate(corners):
            x, y = order[2 * k] + 17, order[2 * k + 1] + 17
            steps += [(a + 1, b + 1, d + 1, x, 32), (c + 1, d + 1, b + 1, 0, 24)]
            steps += [(a + 1, b + 1, d + 1, y, 16), (c + 1, d + 1, b + 1, 0, 63)]
    return ", ".join(str(list(s)) for s in steps)


def _blake2b_id(value: str) -> str:
    """Signed little-endian 8-byte hash of a string of at most 128 bytes."""
    whole = "18446744073709551616::HUGEINT"
    first = list(_BLAKE2B_START)
    first[0] ^= 0x01010008
    own = [str(w) for w in first] + [str(w) for w in _BLAKE2B_START]
    # counter of bytes, and the mark of the last block
    own[12] = f"xor({own[12]}::HUGEINT, octet_length(encode({value}))::HUGEINT)"
    own[14] = str(_BLAKE2B_START[6] ^ (2**64 - 1))
    padded = f"rpad(hex(encode({value})), 256, '0')"
    word = "concat(" + ", ".join(f"h[i * 16 + {2 * b + 1} : i * 16 + {2 * b + 2}]" for b in range(7, -1, -1)) + ")"
    message = (
        f"list_transform(range(16), lambda i: list_transform([{padded}], "
        f"lambda h: ('0x' || {word})::UBIGINT::HUGEINT)[1])"
    )
    at = lambda k: f"v[e[{k}]::BIGINT]"
    grown = f"({at(1)} + {at(2)} + CASE WHEN e[4] > 0 THEN {at(4)} ELSE 0 END)"
    turned = f"(t >> e[5]::INT) + ((t << (64 - e[5]::INT)) % {whole})"
    step = (
        f"list_transform([{grown} % {whole}], lambda g: list_transform([xor({at(3)}, g)], "
        f"lambda t: list_transform(v, lambda w, i: CASE WHEN i = e[1] THEN g WHEN i = e[3] "
        f"THEN {turned} ELSE w END))[1])[1]"
    )
    state = f"list_concat([{', '.join(x + '::HUGEINT' for x in own)}], {message})"
    done = f"list_reduce([{_blake2b_steps()}]::HUGEINT[][], lambda v, e: {step}, {state})"
    mixed = f"list_transform([{done}], lambda v: xor(xor({first[0]}::HUGEINT, v[1]), v[9]))[1]"
    return (
        f"list_transform([{mixed}], lambda x: CASE WHEN x >= 9223372036854775808::HUGEINT "
        f"THEN x - {whole} ELSE x END)[1]::BIGINT"
    )


def _run_query(condition: str) -> str:
    return (
        f"SELECT {LOGIT_ROWS} FROM (SELECT *, list_dot_product(qv, kv) * pow({DIM}::DOUBLE, -0.5) "
        f"AS logit FROM runpairs WHERE {condition} OR q_run = k_run) GROUP BY 1, 2, 3, 4"
    )


WINDOW = D.LAYOUT.sliding_window
_STARTS = (
    "SELECT item_id AS row_ordinal, range(item_id * 10, item_id * 10 + length(text) % 700 + 1) AS s "
    "FROM benchmark"
)
_TEXTS: dict[str, str] = {
    "corpus_scan": "SELECT doc_id AS example_id, length(text) AS n_chars, md5(text) AS digest FROM documents",
    "corpus_take": f"SELECT doc_id AS example_id, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT {D.MAX_SAMPLES}",
    "long_subset": f"SELECT doc_id AS example_id, {_length_class()} AS length, n_chars FROM documents WHERE {_length_class()} = 'long'",
    "project_id_text": f"SELECT doc_id AS id, text FROM documents WHERE {_length_class()} = 'long'",
    "subset_counts": f"SELECT count(*) AS rows_before, count(*) FILTER ({_length_class()} = 'long') AS rows_after FROM documents",
    "ordinal_example_id": "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS example_id FROM documents",
    "normalize_example_id": (
        f"SELECT doc_id, n_chars AS as_long, {_md5_id('concat($id-$, doc_id)')} AS as_string, "
        f"{_md5_id('doc_id::VARCHAR')} AS as_digits, "
        f"CASE WHEN n_chars % 4 = 0 THEN n_chars // 4 ELSE {_md5_id('(n_chars / 4.0::DOUBLE)::VARCHAR')} END AS as_double, "
        "(lang = 'en')::BIGINT AS as_boolean FROM documents"
    ).replace("$", "'"),
    "example_id_int32": (
        f"SELECT doc_id, i AS id64, {_wrap('i')} AS id32, {_wrap('(-i)')} AS id32_negative "
        f"FROM (SELECT doc_id, {_md5_id('concat($id-$, doc_id)')} AS i FROM documents)"
    ).replace("$", "'"),
    "row_target": f"SELECT least(count(*), {D.MAX_SAMPLES}) AS row_target FROM documents",
    "batch_profile": (
        "SELECT o // 64 AS batch_no, count(*) AS n_rows, min(c) AS min_chars, avg(c) AS avg_chars, max(c) AS max_chars "
        "FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS o, length(text) AS c FROM documents) GROUP BY 1"
    ),
    "corpus_stream": "SELECT doc_id AS example_id, length(text) AS n_chars, md5(text) AS digest FROM documents",
    "tokenize_truncate": (
        "SELECT doc_id AS example_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM "
        f"(SELECT doc_id, list_slice(regexp_extract_all(text, '\\S+'), 1, {D.SHORT_LENGTH}) AS t FROM documents)"
    ),
    "valid_lengths": f"SELECT example_id, least(n, {D.SHORT_LENGTH})::INT AS n_tokens FROM lens",
    "valid_length_profile": (
        "SELECT o // 64 AS batch_no, min(n)::INT AS min_tokens, max(n)::INT AS max_tokens FROM "
        "(SELECT row_number() OVER (ORDER BY example_id) - 1 AS o, len(tokens) AS n FROM tok) GROUP BY 1"
    ),
    "explode_positions": f"SELECT example_id, {SPAN.format(t='INT')}, sum(position)::BIGINT AS position_sum FROM pos GROUP BY 1",
    "offset_positions": (
        f"WITH starts_at AS ({_STARTS}), nums AS (SELECT example_id, len(tokens) AS n, row_number() OVER (ORDER BY example_id) - 1 AS o FROM tok), "
        "fit AS (SELECT example_id, n, s FROM nums JOIN starts_at ON row_ordinal = least(o, (SELECT max(row_ordinal) FROM starts_at)) WHERE n > 0), "
        "placed AS (SELECT example_id, unnest([CASE WHEN i < len(s) THEN s[i + 1] ELSE s[len(s)] + (i - len(s) + 1) END for i in range(n)]) AS position FROM fit) "
        f"SELECT example_id, {SPAN.format(t='BIGINT')}, sum(position)::BIGINT AS position_sum FROM placed GROUP BY 1"
    ),
    "token_strings": f"SELECT {GROUP}, position, token_str FROM cap_tok",
    "bucket_log": f"SELECT example_id, {LOG_BUCKET}::INT AS bucket, {SPAN.format(t='INT')} FROM pos GROUP BY 1, 2",
    "bucket_uniform": f"SELECT example_id, (position // {SIZE})::INT AS bucket, {SPAN.format(t='INT')} FROM pos GROUP BY 1, 2",
    "bucket_all": f"SELECT example_id, (position // {SIZE})::INT AS bucket, {SPAN.format(t='INT')} FROM pos GROUP BY 1, 2",
    "effective_min_bucket": (
        "SELECT doc_id, n_chars AS requested, CASE WHEN n_chars = 1 THEN 1 "
        "ELSE 1::BIGINT << length(ltrim(bin(n_chars - 1), '0')) END::BIGINT AS effective FROM documents"
    ),
    "bucket_widths": (
        "SELECT b::INT AS bucket, 1::BIGINT << b AS width, least(1.0::DOUBLE, 1.0::DOUBLE / (1::BIGINT << b)) AS keep_probability, "
        f"count(*) AS n_positions FROM (SELECT {LOG_BUCKET} AS b FROM pos) GROUP BY b"
    ),
    "sample_log_uniform": "SELECT * FROM log",
    "sample_uniform": "SELECT * FROM uni",
    "sample_all": f"SELECT {GROUP}, bucket, {POSITION_SUM} FROM every GROUP BY ALL",
    "seeded_draw": f"SELECT {GROUP}, count(*) AS n_rows, min(u) AS min_u, max(u) AS max_u, sum(u) AS sum_u FROM drawn GROUP BY ALL",
    "sample_shared_mask": f"SELECT example_id, layer, head, kind, position, bucket FROM uni JOIN heads USING (kind)",
    "sample_per_head": (
        f"SELECT {GROUP}, head, position::INT AS position, (position // {SIZE})::INT AS bucket "
        f"FROM hdrawn WHERE u < 1.0::DOUBLE / {SIZE}"
    ),
    "cap_rows": (
        f"SELECT {GROUP}, position, bucket FROM cap_drawn QUALIFY row_number() OVER "
        f"(PARTITION BY {GROUP} ORDER BY u, position) <= {D.ROW_CAP}"
    ),
    "sampler_by_name": (
        f"SELECT strategy, {GROUP}, {POSITION_SUM} FROM (SELECT 'log_uniform' AS strategy, * FROM log "
        "UNION ALL SELECT 'uniform', * FROM uni UNION ALL SELECT 'all', * FROM every) GROUP BY ALL"
    ),
    "custom_sampler": (
        f"SELECT {GROUP}, position::INT AS position, (position // {SIZE})::INT AS bucket "
        f"FROM pos, layers, kinds WHERE position % {SIZE} = 0"
    ),
    "head_layout": "SELECT model, num_layers, q_heads, k_heads, len(types)::INT AS n_types FROM models",
    "sliding_layers": "SELECT model, layer FROM mflags WHERE sliding",
    "head_candidates": "SELECT model, layer, head FROM mcand",
    "sample_heads": "SELECT model, layer, head FROM mq",
    "key_heads_for_queries": "SELECT model, layer, head FROM mk",
    "head_sampling_summary": (
        f"SELECT model, {D.HEAD_SAMPLE}::INT AS requested_q, "
        "(SELECT count(*) FROM mq WHERE mq.model = m.model)::INT AS selected_q, "
        "(SELECT count(*) FROM mk WHERE mk.model = m.model)::INT AS selected_k, "
        "num_layers, q_heads, k_heads, s::INT AS sliding_layers, (num_layers - s)::INT AS full_layers, "
        "(s * q_heads)::INT AS excluded_sliding FROM models m JOIN "
        "(SELECT model, sum(sliding::INT)::INT AS s FROM mflags GROUP BY 1) USING (model)"
    ),
    "filter_layers_heads": f"{HEAD_KEYS} WHERE layer IN (1, 2) AND head = 1",
    "filter_selected_heads": f"{HEAD_KEYS} SEMI JOIN selected USING (layer, head, kind)",
    "filter_full_attention": f"{HEAD_KEYS} WHERE sliding_window IS NULL",
    "filter_kind": f"{HEAD_KEYS} WHERE kind = 'k'",
    "batch_encode": (
        f"SELECT {GROUP}, position, vec_id, len(flat)::INT AS n_values, {_r4('flat[1]')} AS first_value, "
        f"{_r4('flat[-1]')} AS last_value, "
        f"{_r4('list_dot_product(flat, [(i + 1)::DOUBLE for i in range(len(flat))])')} AS weighted_sum "
        "FROM cap_enc"
    ),
    "encode_sequences": (
        "WITH spelled AS (SELECT example_id, unnest(tokens) AS word, unnest(range(len(tokens))) AS position FROM tok), "
        "told AS (SELECT example_id, position, length(word) AS own, lag(length(word), 1, 0) OVER w AS previous, "
        "sum(length(word)) OVER w AS total FROM spelled WINDOW w AS (PARTITION BY example_id ORDER BY position)) "
        f"SELECT {GROUP}, position, "
        + ", ".join(
            f"({x} * (layer + 1) + (kind = 'k')::INT)::DOUBLE AS {x}_length"
            for x in ("own", "previous", "total")
        )
        + " FROM uni JOIN told USING (example_id, position)"
    ),
    "split_heads": (
        f"SELECT vec_id, head, {_digest('v')} FROM (SELECT vec_id, head, f[head * {DIM} + 1 : head * {DIM} + {DIM}] AS v "
        "FROM (SELECT vec_id, embedding::DOUBLE[] AS f, unnest(range(4))::INT AS head FROM embeddings))"
    ),
    "gather_vectors": f"SELECT {KEY}, {_digest('v')} FROM cap SEMI JOIN selected USING (layer, head, kind)",
    "vectors_float32": (
        "SELECT vec_id, min(x) AS min_value, max(x) AS max_value, count(x) AS n_values FROM "
        "(SELECT vec_id, (unnest(embedding)::DOUBLE / 3.0::DOUBLE)::FLOAT::DOUBLE AS x FROM embeddings) GROUP BY 1"
    ),
    "sliding_window_tag": f"SELECT {GROUP}, position, bucket, sliding_window FROM cap_tok",
    "config_name": (
        "SELECT printf('l%02dh%02d%s', layer, head, kind) AS config, count(*) AS n_rows "
        "FROM uni JOIN heads USING (kind) GROUP BY 1"
    ),
    "merge_batches": (
        f"SELECT {GROUP}, {POSITION_SUM} FROM (SELECT * FROM uni UNION ALL SELECT * FROM log "
        "UNION ALL SELECT * FROM uni) GROUP BY ALL"
    ),
    "rotate_half_split": _vector_query(_halves(f"{D.ROPE_THETA}::DOUBLE")),
    "rotate_interleaved_partial": _vector_query(_interleaved(DIM // 2, f"{D.ROPE_THETA}::DOUBLE")),
    "rotate_by_layer_type": _vector_query(
        f"CASE WHEN layer = 3 THEN v WHEN layer IN {SLIDING_SET} THEN "
        f"{_halves(f'{D.SLIDING_ROPE_THETA}::DOUBLE')} ELSE {_halves(f'{D.ROPE_THETA}::DOUBLE')} END"
    ),
    "query_position_scale": (
        f"SELECT {KEY}, {_digest('o')} FROM (SELECT {KEY}, [x * (1 + {D.QUERY_SCALE_BETA}::DOUBLE * "
        f"ln(1.0::DOUBLE + position // {D.QUERY_SCALE_LENGTH})) for x in r] AS o FROM "
        f"(SELECT {KEY}, {_halves(f'{D.ROPE_THETA}::DOUBLE')} AS r FROM cap WHERE kind = 'q'))"
    ),
    "head_rms_norm": _vector_query(_rms(RMS_WEIGHTS)),
    "head_rms_norm_one_plus": _vector_query(_rms([1.0 + w for w in RMS_WEIGHTS])),
    "run_visible_pairs": _run_query("k_position <= q_position"),
    "run_visible_window_pairs": _run_query(
        f"(k_position <= q_position AND q_position - k_position < {WINDOW})"
    ),
    "attention_logits": f"SELECT {LOGIT_ROWS} FROM pairs GROUP BY 1, 2, 3, 4",
    "causal_pairs": (
        "SELECT example_id, layer, head, q_position, count(*) AS n_keys, min(k_position) AS first_key, "
        "max(k_position) AS nearest_key FROM pairs GROUP BY 1, 2, 3, 4"
    ),
    "sliding_window_pairs": _window_query(
        f"k_position <= q_position AND q_position - k_position < {WINDOW}"
    ),
    "sliding_window_pairs_bidirectional": _window_query(
        f"abs(q_position - k_position) < {WINDOW}"
    ),
    "attention_softmax": (
        "SELECT example_id, layer, head, q_position, count(*) AS n_keys, "
        f"{_r4('max(w)')} AS max_weight, {_r4('any_value(lse)')} AS log_sum_exp, "
        f"{_r4('-sum(w * ln(w))')} AS entropy FROM (SELECT *, exp(logit - lse) AS w FROM "
        "(SELECT *, m + ln(sum(exp(logit - m)) OVER r) AS lse FROM "
        "(SELECT *, max(logit) OVER r AS m FROM pairs WINDOW r AS (PARTITION BY example_id, layer, head, q_position)) "
        "WINDOW r AS (PARTITION BY example_id, layer, head, q_position))) GROUP BY 1, 2, 3, 4"
    ),
    "logit_softcap": (
        f"SELECT {LOGIT_ROWS} FROM (SELECT * REPLACE ({D.SOFTCAP}::DOUBLE * tanh(logit / {D.SOFTCAP}::DOUBLE) AS logit) "
        "FROM pairs) GROUP BY 1, 2, 3, 4"
    ),
    "run_groups": "SELECT * FROM runs",
    "run_group_spans": (
        "SELECT *, CASE WHEN run_group >= 0 THEN min(turn) OVER w END AS run_start, "
        "CASE WHEN run_group >= 0 THEN max(turn) OVER w END AS run_end FROM runs "
        "WINDOW w AS (PARTITION BY conv_id, run_group)"
    ),
    "write_capture": f"SELECT {STORED_ROWS} FROM cap",
    "overwrite_configs": (
        f"SELECT {STORED_COUNTS} FROM (SELECT * FROM cap WHERE layer NOT IN (0, 1) UNION ALL "
        "SELECT * FROM caplog WHERE layer IN (0, 1)) GROUP BY config"
    ),
    "append_rows": (
        f"SELECT {STORED_COUNTS} FROM (SELECT * FROM cap UNION ALL SELECT * FROM caplog "
        "UNION ALL SELECT * FROM caplog) GROUP BY config"
    ),
    "token_column_policy": (
        f"SELECT {STORED_COUNTS} FROM (SELECT config, position, sliding_window, token_str FROM cap UNION ALL "
        "SELECT config, position, sliding_window, NULL FROM caplog) GROUP BY config"
    ),
    "one_model_guard": (
        "SELECT branch, min(m) AS first_model, max(m) AS other_model, count(DISTINCT m) AS n_models FROM "
        "(SELECT source AS branch, 'model-a' AS m FROM documents UNION ALL "
        "SELECT source, CASE WHEN lang = 'en' THEN 'model-a' ELSE 'model-' || lang END FROM documents) "
        "GROUP BY 1 HAVING count(DISTINCT m) > 1"
    ),
    "bucket_counts": "SELECT bucket, count(*) AS n_rows FROM uni JOIN heads USING (kind) GROUP BY 1",
    "bucket_counts_ledger": (
        "SELECT bucket, count(*) AS n_rows FROM (SELECT * FROM uni UNION ALL SELECT * FROM log "
        "UNION ALL SELECT * FROM log) JOIN heads USING (kind) GROUP BY 1"
    ),
    "list_configs": "SELECT DISTINCT config, layer, head, kind FROM cap",
    "dataset_card_stats": (
        "SELECT branch, n_configs, config_list, bucket_line, n_rows, 'model-a' AS model, "
        "'unknown' AS source_dataset, '' AS dataset_name, 'all' AS dataset_split, "
        "'all_attention' AS attention_scope, branch AS sampling_strategy, "
        "CASE WHEN branch = 'log' THEN '64' END AS min_bucket_size, "
        "CASE WHEN branch = 'uniform' THEN '64' END AS bucket_size, '2' AS world_size FROM "
        "(SELECT branch, count(*) AS n_configs, string_agg(config, ', ' ORDER BY config) AS config_list FROM "
        "(SELECT DISTINCT branch, config FROM branched) GROUP BY 1) JOIN "
        "(SELECT branch, string_agg('b' || bucket || '=' || n, ', ' ORDER BY bucket) AS bucket_line, sum(n)::BIGINT AS n_rows FROM "
        "(SELECT branch, bucket, count(*) AS n FROM branched GROUP BY ALL) GROUP BY 1) USING (branch)"
    ),
    "extra_metadata": (
        "SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY key) - 1)::INT AS ordinal, key, value, "
        "'- `' || key || '`: `' || value || '`' AS line FROM ("
        + " UNION ALL ".join(
            f"SELECT doc_id AS run_id, '{key}' AS key, {value} AS value FROM documents"
            for key, value in (
                ("source_dataset", "source"),
                ("dataset_split", "lang"),
                ("sampling_strategy", "'uniform'"),
                ("sampling_bucket_size", "'64'"),
                ("text_chars", "n_chars::VARCHAR"),
                ("dataset_branch", "lang || '-' || source"),
                ("avg_quarter", "(n_chars / 4.0::DOUBLE)::VARCHAR"),
            )
        )
        + ") WHERE key NOT IN ("
        + ", ".join(f"'{k}'" for k in KNOWN_KEYS)
        + ")"
    ),
    "run_metadata": (
        "SELECT doc_id AS run_id, 'source_dataset' AS key, source AS value FROM documents UNION ALL "
        "SELECT doc_id, 'dataset_split', lang FROM documents UNION ALL "
        "SELECT doc_id, 'sampling_bucket_size', CASE WHEN lang = 'en' THEN '32' ELSE '64' END FROM documents UNION ALL "
        "SELECT doc_id, 'sampling_strategy', 'uniform' FROM documents"
    ),
    "read_config": f"SELECT {STORED_ROWS} FROM cap WHERE config = 'l01h02q'",
    "read_config_prefix": f"SELECT {STORED_ROWS} FROM caplog WHERE config LIKE 'l00h00%'",
    "publish_branch": (
        f"SELECT branch, {STORED_COUNTS} FROM branched WHERE branch = 'log' OR sliding_window IS NULL GROUP BY branch, config"
    ),
    "reset_root": f"SELECT {STORED_COUNTS} FROM cap WHERE sliding_window IS NULL GROUP BY config",
    "capture_counters": (
        "SELECT count(*) AS captured_rows, count(DISTINCT (example_id, layer, kind)) AS captured_payloads, "
        "count(DISTINCT config) AS captured_configs FROM cap"
    ),
    "capture_run": (
        "SELECT branch, 'model-a' AS model_name, branch AS sampling_strategy, bucket, count(*) AS n_rows "
        "FROM branched GROUP BY branch, bucket"
    ),
    "capture_run_sampled": (
        "SELECT bucket, count(*) AS n_rows, 'random_query' AS strategy, '0' AS seed, "
        "'6' AS requested_query_heads, "
        "(SELECT count(*) FROM selected WHERE kind = 'q')::VARCHAR AS selected_query_heads, "
        "(SELECT count(*) FROM selected WHERE kind = 'k')::VARCHAR AS selected_key_heads, "
        "'4' AS num_layers, '4' AS num_query_heads, '2' AS num_key_heads, "
        "'0' AS full_attention_only, '2' AS sliding_layer_count, '2' AS full_layer_count, "
        "'0' AS sliding_candidates_excluded "
        "FROM cap SEMI JOIN selected USING (layer, head, kind) GROUP BY bucket"
    ),
    "session_rows": (
        f"SELECT {STORED_COUNTS} FROM (SELECT * FROM cap WHERE layer NOT IN (0, 1) UNION ALL "
        "SELECT * FROM caplog WHERE layer IN (0, 1) UNION ALL SELECT * FROM caplog) GROUP BY config"
    ),
    "session_counts": (
        "SELECT bucket, sum(s)::BIGINT AS n_stored, count(*) AS n_written FROM "
        "(SELECT bucket, (layer NOT IN (0, 1))::INT AS s FROM cap UNION ALL "
        "SELECT bucket, 1 FROM caplog WHERE layer IN (0, 1) UNION ALL "
        "SELECT bucket, 1 FROM caplog) GROUP BY bucket"
    ),
    "corpus_stream_take": (
        f"SELECT doc_id AS example_id, md5(text) AS digest FROM documents LIMIT {D.MAX_SAMPLES}"
    ),
    "source_ordinal": (
        "SELECT row_number() OVER () - 1 AS example_id, md5(text) AS digest FROM documents"
    ),
    "source_take": (
        "SELECT row_number() OVER () - 1 AS example_id, md5(text) AS digest FROM documents "
        f"LIMIT {D.MAX_SAMPLES}"
    ),
    "stream_session": (
        "SELECT 'live' AS branch, 'model-a' AS model_name, bucket, count(*) AS n_rows "
        "FROM cap GROUP BY bucket"
    ),
    "stream_capture": f"SELECT {STORED_ROWS} FROM cap",
}
_TEXTS["normalize_example_id_blake2b"] = (
    "SELECT doc_id, n_chars AS as_long, "
    + ", ".join(
        (
            _blake2b_id("concat('id-', doc_id)") + " AS as_string",
            _blake2b_id("doc_id::VARCHAR") + " AS as_digits",
            "CASE WHEN n_chars % 4 = 0 THEN n_chars // 4 ELSE "
            + _blake2b_id("(n_chars / 4.0::DOUBLE)::VARCHAR") + " END AS as_double",
        )
    )
    + ", (lang = 'en')::BIGINT AS as_boolean FROM documents"
)
_TEXTS["custom_sampler_udf"] = _TEXTS["custom_sampler"]
_TEXTS["gather_from_store"] = _TEXTS["gather_vectors"]
_TEXTS["encode_in_row"] = _TEXTS["stream_sequences"] = _TEXTS["encode_sequences"]
_TEXTS["stream_bucket_counts"] = _TEXTS["bucket_counts"]


def _build(text: str) -> str:
    if text.startswith("WITH "):  # own steps after the shared ones
        used = _needed(text)
        steps = [f"{name} AS ({CTES[name]})" for name in CTES if name in used]
        return f"WITH {', '.join(steps)}, {text[5:]}"
    return _sql(text)


ORACLES: dict[str, str] = {name: _build(text) for name, text in _TEXTS.items()}
