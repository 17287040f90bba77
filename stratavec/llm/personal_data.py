"""Personal data in texts: proposed by patterns, confirmed by checksums, scored by context.

Every kind of personal data has a regular expression that proposes spans and a
validator that confirms them: digit counts, the Luhn sum of card numbers, the
mod-97 sum of bank account numbers.  Words near a span raise or lower its score.
The *base* kinds (``email``, ``ip``, ``card``, ``phone``) are kept whenever they are
valid, whatever their score; the added ones (``iban``, ``ssn``, ``local_phone``) only
from a score of ``THRESHOLD``, so that one without a checksum needs a word that tells.
DataFrame functions only, one row at a time, no shuffle.

A text is cut at the matches of a pattern; the lengths of what lies between them and
of the matches add up to the positions, and the ends of the pieces are the context.
So the work is linear in the text, and a text full of matches costs no more than a
few hundred additions for each (``running_totals``).  Patterns start where a run of
their characters starts and never give characters back, so a long run is read once.

Defined cases: a null text is an empty one, without spans; positions are code points,
counted from 0, ends exclusive; matches of one kind do not overlap, a match that is
not valid is dropped and not tried again from another place; spans of different kinds
may overlap; repeated rows and rows without an id are rows of their own; other columns
have no influence; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 60
# code points on each side of a span in which words count
CONTEXT = 40
RAISE, LOWER = 30, 20
# lengths added up at a time
TOTALS_CHUNK = 128

Test = Callable[[Column], Column]


def _with(value: Column, build: Test) -> Column:
    """``build(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), build), 0)


def running_totals(widths: Column) -> Column:
    """Sum of the entries before each entry of an array of whole numbers."""
    add = lambda total, x: total + x
    upto = lambda part, n: F.aggregate(F.slice(part, 1, n), F.lit(0), add)
    before = lambda part: F.transform(part, lambda _, i: upto(part, i))

    def build(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), add))
        return _with(
            _with(sums, before),
            lambda offsets: F.flatten(
                F.transform(
                    chunks,
                    lambda c, k: F.transform(before(c), lambda x: x + F.get(offsets, k)),
                )
            ),
        )

    starts = F.sequence(F.lit(1), F.size(widths), F.lit(TOTALS_CHUNK))
    cut = F.transform(starts, lambda s: F.slice(widths, s, F.lit(TOTALS_CHUNK)))
    return F.when(F.size(widths) == 0, F.array().cast("array<int>")).otherwise(_with(cut, build))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""

    def summed(backwards: Column) -> Column:
        def weighed(i: Column) -> Column:
            digit = F.substring(backwards, i + 1, 1).cast("int")
            return F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

        places = F.sequence(F.lit(0), F.length(backwards) - 1)
        return F.aggregate(F.transform(places, weighed), F.lit(0), lambda total, x: total + x)

    return _with(F.reverse(digits), summed) % 10 == 0


def mod_97(account: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end."""

    def remainder(text: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            code = F.ascii(F.substring(text, i, 1))
            digit = total * 10 + code - 48
            return F.when(code < 58, digit).otherwise(total * 100 + code - 55) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)

    return _with(F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4)), remainder)


def _octets(match: Column) -> Column:
    return match.rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|\z)){4}\z")


def _card(match: Column) -> Column:
    return _with(_digits(match), lambda d: F.length(d).between(14, 19) & luhn(d))


def _account(match: Column) -> Column:
    return _with(
        F.translate(match, " ", ""), lambda a: F.length(a).between(15, 34) & (mod_97(a) == 1)
    )


def _social(match: Column) -> Column:
    return ~match.rlike(r"\A(?:000|666|9)|-00-|0000\z")


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``hint`` holds for every text with a valid match and is cheap; ``before`` and
    ``after`` are patterns that may not touch the match; ``near`` and ``against`` are
    words that raise and lower the ``score``.
    """

    name: str
    pattern: str
    hint: Test
    valid: Test
    score: int
    near: str
    against: str | None = None
    before: str | None = None
    after: str | None = None
    base: bool = False


_CODE = "order|invoice|isbn|serial|part|version|release|section|chapter|page"
_CALL = "phone|telephone|tel|call|mobile|cell|fax|whatsapp|sms|contact"
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m: F.lit(True),
        80,
        "email|e-mail|mail|write|contact|reach",
        base=True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        _octets,
        60,
        "ip|address|host|server|login|client|visitor",
        _CODE,
        base=True,
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
        _card,
        70,
        "card|visa|mastercard|amex|credit|debit|pay|payment|expires|cvv",
        _CODE,
        base=True,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        lambda m: F.length(_digits(m)).between(10, 15),
        70,
        _CALL,
        _CODE,
        base=True,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
        _account,
        80,
        "iban|account|bank|transfer|pay|payment",
        _CODE,
        before=r"[A-Za-z0-9]\z",
        after=r"\A[A-Za-z0-9]",
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        _social,
        40,
        "ssn|social security|taxpayer|security number",
        _CODE,
        before=r"[A-Za-z0-9+.-]\z",
        after=r"\A[A-Za-z0-9-]",
    ),
    Kind(
        "local_phone",
        r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}",
        lambda t: t.rlike(r"[0-9]\)?[ .-][0-9]{3,4}[ .-][0-9]{3}"),
        lambda m: F.length(_digits(m)).between(9, 12),
        40,
        _CALL,
        _CODE,
        before=r"(?:[A-Za-z+.(-]|[0-9)][ ]?)\z",
        after=r"\A(?:[A-Za-z0-9]|[ .-][0-9])",
    ),
)


def _said(context: Column, words: str) -> Column:
    return context.rlike(f"(?:\\A|[^a-z])(?:{words})(?:[^a-z]|\\z)")


def _proposed(text: Column, kind: Kind, number: int) -> Column:
    """Valid spans of one kind in a text, with their scores; null where none can be."""
    pattern = F.lit(kind.pattern)

    def placed(matches: Column, pieces: Column) -> Column:
        widths = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))

        def span(m: Column, i: Column, totals: Column) -> Column:
            start = F.get(totals, i) + F.length(F.get(pieces, i))
            return F.struct(
                start.alias("start"),
                F.lit(number).alias("kind_no"),
                (start + F.length(m)).alias("end"),
                F.lit(kind.name).alias("kind"),
                m.alias("match"),
                F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("left"),
                F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("right"),
            )

        return _with(
            running_totals(widths),
            lambda totals: F.transform(matches, lambda m, i: span(m, i, totals)),
        )

    def holds(s: Column) -> Column:
        tests = [kind.valid(s["match"])]
        if kind.before is not None:
            tests.append(~s["left"].rlike(kind.before))
        if kind.after is not None:
            tests.append(~s["right"].rlike(kind.after))
        return reduce(and_, tests)

    def scored(s: Column) -> Column:
        def build(context: Column) -> Column:
            score = F.lit(kind.score) + F.when(_said(context, kind.near), RAISE).otherwise(0)
            if kind.against is not None:
                score = score - F.when(_said(context, kind.against), LOWER).otherwise(0)
            return F.struct(
                s["start"].alias("start"),
                s["kind_no"].alias("kind_no"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
                F.lit(kind.base).alias("base"),
                F.least(score, F.lit(100)).alias("score"),
            )

        return _with(_lower(F.concat_ws(" ", s["left"], s["right"])), build)

    found = _with(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda matches: F.when(
            F.size(matches) > 0,
            _with(F.split(text, kind.pattern, -1), lambda pieces: placed(matches, pieces)),
        ),
    )
    spans = F.transform(F.filter(found, holds), scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.when(kind.hint(text), spans)


SPAN = "struct<start:int,kind_no:int,end:int,kind:string,base:boolean,score:int>"


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with an array of ``(start, kind_no, end, kind, base, score)``, by start
    and then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast(f"array<{SPAN}>")
    every = [F.coalesce(_proposed(whole, kind, n), empty) for n, kind in enumerate(KINDS)]
    return docs.withColumn(name, F.array_sort(F.concat(*every)))


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans with their scores."""
    found = with_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _oracle_kind(kind: Kind, number: int) -> str:
    """The same spans in SQL; possessive forms and look-behinds only save work there."""
    plain = kind.pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace("(?<![0-9])", "")
    plain = plain.replace("++", "+")
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    account = "replace(m, ' ', '')"
    valid = {
        "ip": r"regexp_matches(m, '\A(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|\z)){4}\z')",
        "card": f"""len({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(len({digits})),
            lambda i: CASE WHEN i % 2 = 0 THEN reverse({digits})[i + 1]::INT
              ELSE reverse({digits})[i + 1]::INT * 2
                - CASE WHEN reverse({digits})[i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0""",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
        "local_phone": f"len({digits}) BETWEEN 9 AND 12",
        "iban": f"""len({account}) BETWEEN 15 AND 34 AND list_reduce(list_transform(
            range(len({account})), lambda i: ascii(({account}[5:] || {account}[:4])[i + 1])),
            lambda t, c: CASE WHEN c < 58 THEN t * 10 + c - 48 ELSE t * 100 + c - 55 END % 97,
            0) = 1""",
        "ssn": r"NOT regexp_matches(m, '\A(?:000|666|9)|-00-|0000\z')",
    }.get(kind.name, "true")
    tests = [valid]
    if kind.before is not None:
        tests.append(f"NOT regexp_matches(l, '{kind.before}')")
    if kind.after is not None:
        tests.append(f"NOT regexp_matches(r, '{kind.after}')")
    said = lambda words: f"regexp_matches(c, '(?:\\A|[^a-z])(?:{words})(?:[^a-z]|\\z)')"
    score = f"{kind.score} + CASE WHEN {said(kind.near)} THEN {RAISE} ELSE 0 END"
    if kind.against is not None:
        score += f" - CASE WHEN {said(kind.against)} THEN {LOWER} ELSE 0 END"
    lower = (
        "translate(l || ' ' || r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )
    return f"""
  SELECT nr, {number} AS kind_no, '{kind.name}' AS kind, {str(kind.base).lower()} AS base, s,
         s + length(m) AS e, least({score}, 100) AS score
  FROM (
    SELECT *, {lower} AS c FROM (
      SELECT nr, m, right(p[i], {CONTEXT}) AS l, left(p[i + 1], {CONTEXT}) AS r,
             length(array_to_string(list_transform(range(1, i),
               lambda k: p[k] || ms[k]), '') || p[i]) AS s
      FROM (
        SELECT nr, p, ms, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m
        FROM (SELECT nr, string_split_regex(t, '{plain}') AS p,
                     regexp_extract_all(t, '{plain}') AS ms FROM texts)))
    WHERE {' AND '.join(tests)})"""


ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS t FROM documents
), proposed AS ({" UNION ALL ".join(_oracle_kind(k, n) for n, k in enumerate(KINDS))}
), spans AS (
  SELECT *, kind || ':' || s || ':' || e AS span FROM proposed
  WHERE base OR score >= {THRESHOLD}
), listed AS (
  SELECT nr,
         {", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)},
         coalesce(string_agg(span, ',' ORDER BY s, kind_no) FILTER (WHERE base), '') AS base_spans,
         string_agg(span, ',' ORDER BY s, kind_no) AS spans,
         string_agg(score::VARCHAR, ',' ORDER BY s, kind_no) AS scores
  FROM spans GROUP BY nr
)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)},
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(scores, '') AS scores
FROM texts LEFT JOIN listed USING (nr)
"""
