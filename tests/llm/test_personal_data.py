"""Personal data against a plain version, and on texts made to be awkward."""

from __future__ import annotations

import hashlib
import random
import re

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from stratavec.llm import personal_data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text: str | None) -> dict:
    spans = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            if valid(kind, m.group()):
                spans.append((m.start(), number, kind, m.end()))
    listed = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))
    counts = {f"n_{k}": sum(s[2] == k for s in spans) for k in BASE}
    return {**counts, "base_sha256": hashlib.sha256(listed.encode()).hexdigest(), "listed": listed}


def noise(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    parts = ["a", "b.c", "@", ".", "-", "+", "+1", " ", "(", ")", "1", "22", "255", "256", "007"]
    parts += ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "é", "🙂", "\n"]
    parts += ["x@y.zz", "1.2.3.4", "+1 (017) 555-7713", "GB82 WEST 1234 5698 7654 32", "%_", "٣"]
    parts += ["card", " phone ", "078-05-1120", " ssn ", "555-123-4567", "DE89370400440532013000"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


AWKWARD = [
    None,
    "",
    "a@b.c+x@d.e@f.g",
    "@a.b x@.a x@a. x@a.b.",
    "1.2.3.4.5.6.7.8.9 0300.1.1.1 0255.000.1.1",
    "🙂🙂 é x@y.zz 🙂 1.2.3.4",
    "+1 (017) 555-7713 +12 +1-2 +123456789012345 +1234567890123456 +1234567890 ()",
    "4111 1111 1111 1111 4111-1111  4111111111111111 41111111111111111111",
]


def test_base_spans(spark, docs_of):
    texts = AWKWARD + noise(600, 3)
    got = {r["doc_id"]: r for r in personal_data.personal_data(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = plain(text)
        spans = [s for s in got[k]["spans"].split(",") if s.split(":")[0] in BASE]
        assert ",".join(spans) == want["listed"], text
        assert {c: got[k][c] for c in want if c != "listed"} == {
            c: v for c, v in want.items() if c != "listed"
        }


@pytest.mark.parametrize("seed", [5, 6])
def test_same_as_sql_on_noise(spark, docs_of, seed):
    rows = list(enumerate(AWKWARD + noise(400, seed))) + [(None, "x@y.zz"), (3, "x@y.zz"), (3, "x@y.zz")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    mine = compare.spark_rows(personal_data.personal_data(docs_of(rows)))
    assert compare.difference(mine, compare.duck_rows(con, personal_data.ORACLE)) is None


def test_checksums_and_context_decide(spark, docs_of):
    texts = {
        "my iban GB82 WEST 1234 5698 7654 32 is": "iban:8:35",
        "my iban GB82 WEST 1234 5698 7654 33 is": "",
        "DE89370400440532013000": "iban:0:22",
        "XDE89370400440532013000": "",
        "ssn 078-05-1120": "ssn:4:15",
        "number 078-05-1120": "",
        "ssn 000-05-1120": "",
        "call 555-123-4567 now": "local_phone:5:17",
        "row 555-123-4567 now": "",
        "call +1 (017) 555-7713": "phone:5:22",
    }
    got = personal_data.personal_data(docs_of(list(texts))).orderBy("doc_id").collect()
    assert [r["spans"] for r in got] == list(texts.values())
    card = "order 4111111111111111", "visa 4111111111111111"
    low, high = (r["scores"] for r in personal_data.personal_data(docs_of(list(card))).orderBy("doc_id").collect())
    assert (low, high) == ("50", "100")


def test_long_texts(spark, docs_of):
    n = 200_000
    texts = ["a" * n, "1" * n, "x@a" + ".a" * n, "1 " * n, "+1" * n, "x@y.zz " * 20_000, "é" * n + "x@y.zz"]
    got = {r["doc_id"]: r for r in personal_data.personal_data(docs_of(texts)).collect()}
    assert [got[k]["n_email"] for k in range(7)] == [0, 0, 1, 0, 0, 20_000, 1]
    assert got[2]["spans"] == f"email:0:{3 + 2 * n}" and got[6]["spans"] == f"email:{n}:{n + 6}"
    assert got[5]["spans"].endswith(f"email:{7 * 19_999}:{7 * 19_999 + 6}")


def test_running_totals(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        widths = spark.range(1).select(F.lit(list(range(n))).cast("array<int>").alias("w"))
        got = widths.select(personal_data.running_totals(F.col("w"))).first()[0]
        assert got == [sum(range(i)) for i in range(n)]


def test_native_and_empty(spark, docs_of, small):
    plan = personal_data.personal_data(spark.read.parquet(f"{small}/documents.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
    assert personal_data.personal_data(docs_of(["x"]).limit(0)).collect() == []
