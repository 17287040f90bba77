"""Quality rules: fixed rules, then robust multivariate outliers.

Each text becomes a vector of transformed statistics.  For every language and
source a minimum-covariance-determinant estimate of centre and scatter is found,
and texts far from it in Mahalanobis distance are rejected.

The estimate concentrates over *all* rows: a step needs, per group, the sums of
the ``h`` rows nearest to the current centre.  Rows are put into fine bins of
their distance, and counts, sums and cross products per bin are partial
aggregates, so a group of any size is a few thousand rows after the shuffle.
Several starts run side by side, each until its determinant no longer falls; the one
with the smallest determinant wins.

Defined cases: a null text has no words (and fails the word count); null
languages and sources are groups of their own; rows of a group with fewer than
``MIN_GROUP`` rows that pass the fixed rules are judged by the estimate of their
whole language, where that is as small by the estimate of all rows, and by the
fixed rules alone only if fewer than ``MIN_GROUP`` rows of the whole table pass
them.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import stored, text_struct

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# share of a group's rows that must be regular
COVERAGE = 0.75
MIN_GROUP = 60
# a group goes on while a step lowers the logarithm of its determinant by more than this
SETTLED = 1e-4
# a rejected vector lies beyond this quantile of its group's distances
CUTOFF_QUANTILE = 1 - 1e-9
# bins of distance per doubling
BINS_PER_DOUBLING = 32
# the group of all rows; names of languages and sources start otherwise
EVERY = "*"
# differences smaller than these are never what rejects a text
SCALES = (0.05, 0.015, 0.03, 0.03, 0.10)
N_STATS = len(SCALES)

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = b".,;:!?"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STRUCT = pa.struct([(n, pa.int64()) for n in BASE] + [("x", pa.list_(pa.float64()))])


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    seq = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pair = seq[:-1] * len(number) + seq[1:]
    if len(number) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * len(number) + seq[2:]
    else:
        key = pair[:-1] * len(number) + seq[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def text_statistics(text: str) -> tuple:
    """The five counts of the fixed rules and the transformed vector."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on exactly space and \t \n \v \f \r
    n_words = len(words)
    removed = lambda marks: len(raw) - len(raw.translate(None, marks))
    word_chars = len(text) - removed(_SPACE)
    symbols = removed(_SYMBOLS)
    filled = [line for line in raw.split(b"\n") if line.strip()]
    dup_lines = len(filled) - len(set(filled))
    repeats = repeated_words(words)
    chars, total = max(word_chars, 1), max(n_words, 1)
    vector = [
        math.log((word_chars + 1) / (n_words + 1)),
        math.sqrt(symbols / chars),
        math.sqrt(removed(_UPPER) / chars),
        math.sqrt(removed(_MARKS) / chars),
        math.sqrt(repeats / total),
    ]
    return n_words, word_chars, symbols, dup_lines, repeats, vector


statistics = text_struct(text_statistics, _STRUCT)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds ``_q``, the struct of statistics, and ``_failed``."""
    rows = docs.withColumn("_q", statistics(F.col("text")))
    return rows.withColumn("_failed", base_failed(F.col("_q.n_words"), F.col("_q.n_repeat_words")))


def _key(name: str) -> Column:
    # null is told apart from every string
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def chi2_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty approximation."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    c = 2 / (9 * k)
    return k * (1 - c + low * math.sqrt(c)) ** 3


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(N_STATS) for j in range(i, N_STATS)]


def _moments() -> list[Column]:
    x = [F.get("x", i) for i in range(N_STATS)]
    sums = [F.sum(x[i]) for i in range(N_STATS)]
    cross = [F.sum(x[i] * x[j]) for i, j in _pairs()]
    return [F.count("*").alias("n"), F.array(*sums, *cross).alias("m")]


def _distance(x: Column, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; null without a centre."""
    d = [F.get(x, i) - F.get(centre, i) for i in range(N_STATS)]
    terms = [
        d[i] * d[j] * F.get(inverse, i * N_STATS + j) * (1 if i == j else 2) for i, j in _pairs()
    ]
    total = sum(terms[1:], terms[0])
    return F.when(total < 0, 0.0).otherwise(total)


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + F.lit(1e-9)) * BINS_PER_DOUBLING).cast("int")


_FIT = (
    "grp string, start int, centre array<double>, inverse array<double>, log_det double, "
    "reach double, n long"
)
_FIT_ARROW = pa.schema(
    [
        ("grp", pa.string()),
        ("start", pa.int32()),
        ("centre", pa.list_(pa.float64())),
        ("inverse", pa.list_(pa.float64())),
        ("log_det", pa.float64()),
        ("reach", pa.float64()),
        ("n", pa.int64()),
    ]
)


def _estimate(count: float, sums: np.ndarray, cross: np.ndarray) -> tuple:
    centre = sums / count
    scatter = np.zeros((N_STATS, N_STATS))
    for (i, j), value in zip(_pairs(), cross):
        scatter[i, j] = scatter[j, i] = value / count - centre[i] * centre[j]
    # the floor keeps statistics that are constant in a group from deciding alone
    scatter = scatter + np.diag(np.square(SCALES))
    return centre, np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])


def _concentrate(bins: pa.Table) -> pa.Table:
    """One group and start: the nearest ``COVERAGE`` of the rows, by whole bins."""
    bins = bins.sort_by("bin")
    moments = bins["m"].combine_chunks().flatten().to_numpy().reshape(len(bins), -1)
    total = np.cumsum(bins["n"].to_numpy())
    upto = int(np.searchsorted(total, math.ceil(COVERAGE * total[-1]))) + 1
    near = moments[:upto].sum(axis=0)
    centre, inverse, log_det = _estimate(
        float(total[upto - 1]), near[:N_STATS], near[N_STATS:]
    )
    reach = 2.0 ** ((bins["bin"][upto - 1].as_py() + 1) / BINS_PER_DOUBLING)
    row = {
        "grp": bins["grp"][0].as_py(),
        "start": bins["start"][0].as_py(),
        "centre": centre.tolist(),
        "inverse": inverse.ravel().tolist(),
        "log_det": log_det,
        "reach": reach,
        "n": int(total[-1]),
    }
    return pa.Table.from_pylist([row], schema=_FIT_ARROW)


def _classical(groups: pd.DataFrame) -> pd.DataFrame:
    """Start 0 from mean and covariance, start 1 from medians and spreads."""
    out = []
    for row in groups.itertuples(index=False):
        moments = np.asarray(row.m)
        centre, inverse, log_det = _estimate(row.n, moments[:N_STATS], moments[N_STATS:])
        low, mid, high = np.array([list(v) for v in row.q]).T
        spread = np.maximum((high - low) / 1.349, np.array(SCALES))
        out.append((row.grp, 0, centre.tolist(), inverse.ravel().tolist(), log_det, 0.0, row.n))
        diagonal = np.diag(1 / np.square(spread)).ravel().tolist()
        out.append((row.grp, 1, mid.tolist(), diagonal, math.inf, 0.0, row.n))
    return pd.DataFrame(out, columns=["grp", "start", "centre", "inverse", "log_det", "reach", "n"])


def _starts(rows: DataFrame) -> DataFrame:
    quartiles = F.array(
        *[F.percentile_approx(F.get("x", i), [0.25, 0.5, 0.75], 1000) for i in range(N_STATS)]
    )
    groups = rows.groupBy("grp").agg(*_moments(), quartiles.alias("q"))
    return groups.mapInPandas(lambda it: (_classical(g) for g in it if len(g)), _FIT)


def covariance_fits(rows: DataFrame) -> DataFrame:
    """Best estimate per group of ``rows(grp, x)``: one row per group.

    ``inverse`` is scaled so that the distance which holds ``COVERAGE`` of the
    group has its chi-square value.
    """
    going, settled, step = stored(_starts(rows), "mcd"), [], 0
    while going.head(1):
        bins = (
            rows.join(going.select("grp", "start", "centre", "inverse"), "grp")
            .withColumn("bin", _bin(_distance(F.col("x"), F.col("centre"), F.col("inverse"))))
            .groupBy("grp", "start", "bin")
            .agg(*_moments())
        )
        new = bins.groupBy("grp", "start").applyInArrow(_concentrate, _FIT)
        before = going.select("grp", "start", F.col("log_det").alias("_before"))
        # a determinant cannot fall for ever: every step lowers it by so much, or is the last
        falls = F.col("log_det") < F.col("_before") - F.lit(SETTLED)
        fits = stored(
            new.join(before, ["grp", "start"]).withColumn("_falls", falls), f"mcd-{step}"
        )
        settled.append(fits.filter(~F.col("_falls")))
        going, step = fits.filter("_falls").drop("_before", "_falls"), step + 1
    if not settled:
        settled = [going.withColumns({"_before": F.lit(0.0), "_falls": F.lit(False)})]
    best = reduce(DataFrame.unionByName, settled).groupBy("grp").agg(
        F.min_by(F.struct("centre", "inverse", "reach", "n"), F.struct("log_det", "start")).alias("f")
    )
    unit = chi2_quantile(COVERAGE, N_STATS)
    # distances of the fit times this have the chi-square value at the coverage
    factor = F.lit(unit) / F.greatest("f.reach", F.lit(unit))
    return best.select(
        "grp",
        F.col("f.centre").alias("centre"),
        F.transform("f.inverse", lambda v: v * factor).alias("inverse"),
        F.col("f.n").alias("n_rows"),
    )


def _with_groups(rows: DataFrame) -> DataFrame:
    language, source = _key("lang"), _key("source")
    # levels and lengths keep names of different groups apart, whatever is in them
    return (
        rows.withColumn("_all", F.concat(F.lit("language "), language))
        .withColumn(
            "_own",
            F.concat(F.lit("source "), F.length(language).cast("string"), language, source),
        )
        .withColumn("_every", F.lit(EVERY))
    )


def judged(table: DataFrame) -> DataFrame:
    """Adds ``_distance`` and ``_kept`` to a stored table of ``with_statistics``.

    Only its narrow columns are read for the estimates; the verdict is a join
    with one row per group, so texts are not shuffled.
    """
    narrow = _with_groups(
        table.filter(~F.col("_failed")).select("lang", "source", F.col("_q.x").alias("x"))
    )
    rows = narrow.select(F.explode(F.array("_own", "_all", "_every")).alias("grp"), "x")
    fits = stored(covariance_fits(stored(rows, "quality-vectors")), "quality-fits")
    usable = fits.filter(F.col("n_rows") >= MIN_GROUP)
    side = lambda key: usable.select(
        F.col("grp").alias(key), F.struct("centre", "inverse").alias(f"{key}_fit")
    )
    cutoff = chi2_quantile(CUTOFF_QUANTILE, N_STATS)
    return (
        _with_groups(table)
        .join(side("_own"), "_own", "left")
        .join(side("_all"), "_all", "left")
        .join(F.broadcast(side("_every")), "_every", "left")
        .withColumn("_fit", F.coalesce("_own_fit", "_all_fit", "_every_fit"))
        .withColumn("_distance", _distance(F.col("_q.x"), F.col("_fit.centre"), F.col("_fit.inverse")))
        .withColumn(
            "_kept", ~F.col("_failed") & F.coalesce(F.col("_distance") <= cutoff, F.lit(True))
        )
        .drop("_own", "_all", "_every", "_own_fit", "_all_fit", "_every_fit", "_fit")
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts, fixed rules and verdict of every document."""
    slim = with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text")
    out = judged(stored(slim, "quality-statistics"))
    return out.select(
        "doc_id",
        *[F.col(f"_q.{name}").alias(name) for name in BASE],
        F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_distance").alias("distance"),
    )


def keep_regular(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged.

    Texts are stored once beside their statistics, so they are read again for
    the verdict instead of being shuffled or analysed twice.
    """
    # the row travels as a struct, so none of its columns can clash with ours
    whole = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", "text")
    out = judged(stored(with_statistics(whole).drop("text"), "quality-documents"))
    return out.filter("_kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
