"""Robust multivariate outliers among documents: minimum covariance determinant by language and source.

Each text is a vector of transformed statistics.  Per group the estimate starts
from deterministic robust guesses (medians with median deviations, and the
scatter of spatial signs about the medians) and takes concentration steps: keep
the share of rows with the smallest Mahalanobis distances, estimate mean and
covariance from those, repeat until the determinant falls no more.  The better
start wins, is scaled to the median of the distances and reweighted once.

Every step is an aggregate over all rows with a handful of sums per group, so a
group that holds a third of the table is pre-aggregated like any other.  Only
matrices of a few numbers per group are inverted in Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import frames, stored
from storyloom.llm.stats import text_counts

#: Statistic and the least spread that is believed of it.  The squares are added to the diagonal of every
#: covariance: a statistic that is zero in most clean texts would otherwise leave no spread at all.
FLOORS = {"length": 0.04, "symbols": 0.04, "repeats": 0.06, "capitals": 0.015, "points": 0.015}
#: Share of a group's rows that estimates rest on.
SHARE = 0.6
#: Rows from which a group has an estimate of its own; smaller ones take their language's, then that of all.
LEAST = 200
#: Mahalanobis distance beyond which a text is rejected.
CUTOFF = 15.0
#: Concentration steps at most; they usually settle sooner.
STEPS = 12
#: Parts in which the rows of a group meet its estimate, so that no task has a large group alone.
SALTS = 8


def _count(name: str) -> Column:
    return F.col("_s_" + name).cast("double")


def vector() -> list[Column]:
    """The transformed statistics of counted texts: square roots steady the spread of shares."""
    words, chars = F.greatest(_count("n_words"), F.lit(1.0)), _count("word_chars")
    return [F.log((chars + 1) / (words + 1)), F.sqrt(_count("n_symbols") / words), F.sqrt(_count("n_repeat_words") / words),
            F.sqrt(_count("n_upper") / (chars + 1)), F.sqrt(_count("n_points") / (chars + 1))]


def base_failed() -> Column:
    return (F.col("_s_n_words") < 50) | (100 * F.col("_s_n_repeat_words") > 50 * F.col("_s_n_words"))


def _chi2(p: int, z: float) -> float:
    """Quantile of the chi-square distribution at the normal quantile z (Wilson and Hilferty's cube)."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def _groups() -> list[Column]:
    """The three groups of a row, finest first."""
    lang, source = F.coalesce(F.col("_lang"), F.lit("")), F.coalesce(F.col("_source"), F.lit(""))
    return [F.concat_ws("\x1f", F.lit("s"), lang, source), F.concat_ws("\x1f", F.lit("l"), lang), F.lit("all")]


def _distance(p: int) -> Column:
    terms = []
    for i in range(p):
        for j in range(i, p):
            part = (F.col(f"x{i}") - F.col("m")[i]) * (F.col(f"x{j}") - F.col("m")[j]) * F.col("w")[i * p + j]
            terms.append(part if i == j else 2 * part)
    return sum(terms[1:], terms[0])


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c.startswith("x")]), F.lit(SALTS)).cast("int"))


def _meet(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Salted rows beside what their group has: one row a group, repeated for every salt."""
    return rows.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], how)


def _sums(p: int) -> list[Column]:
    return [F.count("*").cast("double").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]]


_FIT = "_group string, _start int, m array<double>, w array<double>, logdet double"


def _matrices(p: int, floors: np.ndarray):
    """Sums of each group to its mean, inverse covariance and log determinant."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                mean = np.array([row[f"s{i}"] for i in range(p)]) / row["n"]
                cov = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / row["n"]
                cov = (cov - np.outer(mean, mean)) * row.get("scale", 1.0) + np.diag(floors ** 2)
                mean = np.array(row["centre"]) if "centre" in row else mean
                out.append((row["_group"], row["_start"], mean.tolist(), np.linalg.inv(cov).ravel().tolist(),
                            float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["_group", "_start", "m", "w", "logdet"])
    return work


def fit(counted: DataFrame, share: float = SHARE, least: int = LEAST, steps: int = STEPS) -> DataFrame:
    """Centre and inverse covariance of every group that needs one, from counted texts (``_lang``, ``_source``, counts).

    Texts that fail the base rules are left out.  A table without any good text
    gives no estimate, and then nothing is rejected.
    """
    p, floors = len(FLOORS), np.array(list(FLOORS.values()))
    rows = counted.where(~base_failed()).select(F.array(*_groups()).alias("levels"),
                                                *[c.alias(f"x{i}") for i, c in enumerate(vector())])
    sizes = rows.select(F.explode("levels").alias("_group")).groupBy("_group").agg(F.count("*").alias("_n"))
    needed = stored(sizes.where((F.col("_n") >= least) | (F.col("_group") == "all")).select("_group"), "groups")
    xs = [f"x{i}" for i in range(p)]
    members = _salted(rows.select(F.explode("levels").alias("_group"), *xs))
    members = stored(_meet(members, needed, ["_group"]), "members")

    middle = members.groupBy("_group").agg(*[F.percentile_approx(x, 0.5).alias(f"c{i}") for i, x in enumerate(xs)])
    apart = _meet(members, stored(middle, "middle"), ["_group"]).select(
        "_group", F.array(*[f"c{i}" for i in range(p)]).alias("centre"), *[(F.col(x) - F.col(f"c{i}")).alias(x) for i, x in enumerate(xs)])
    spread = stored(apart.groupBy("_group", "centre").agg(
        *[(F.percentile_approx(F.abs(x), 0.5) * 1.4826).alias(f"d{i}") for i, x in enumerate(xs)]), "spread")
    zero = F.lit(0.0)
    plain = spread.select("_group", F.lit(0).alias("_start"), "centre", F.lit(1.0).alias("n"), F.lit(1.0).alias("scale"),
                          *[zero.alias(f"s{i}") for i in range(p)],
                          *[(F.col(f"d{i}") ** 2 if i == j else zero).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)])
    norm = F.sqrt(sum([(F.col(x) / f) ** 2 for x, f in zip(xs, floors)], zero))
    signs = apart.select("_group", "centre", *[F.when(norm > 0, F.col(x) / norm).otherwise(0.0).alias(x) for x in xs])
    signs = signs.groupBy("_group", "centre").agg(*_sums(p)).select(
        "_group", F.lit(1).alias("_start"), "centre", "n", F.lit(float(p)).alias("scale"), *[zero.alias(f"s{i}") for i in range(p)],
        *[f"s{i}_{j}" for i in range(p) for j in range(i, p)])
    found = stored(frames(plain.unionByName(signs), _matrices(p, floors), _FIT), "fit")

    both = members.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1))))
    key, before = ["_group", "_start"], None
    for _ in range(steps):
        far = _meet(both, found, key).select(*key, "_salt", *xs, _distance(p).alias("d"))
        limit = stored(far.groupBy(*key).agg(F.percentile_approx("d", share, 10000).alias("q")), "limit")
        near = _meet(far, limit, key).where("d <= q")
        found = stored(frames(near.groupBy(*key).agg(*_sums(p)), _matrices(p, floors), _FIT), "fit")
        now = found.agg(F.sum("logdet")).first()[0]
        if before is not None and now is not None and abs(now - before) < 1e-4 * max(1.0, abs(before)):
            break
        before = now
    best = stored(found.groupBy("_group").agg(F.min_by(F.struct("m", "w"), F.struct("logdet", "_start")).alias("b")).select("_group", "b.*"), "fit")

    def scaled(fits: DataFrame) -> DataFrame:
        """Covariances stretched so that the median distance is what normal data would have."""
        far = _meet(members, fits, ["_group"]).select("_group", _distance(p).alias("d"))
        by = far.groupBy("_group").agg((F.percentile_approx("d", 0.5, 10000) / _chi2(p, 0.0)).alias("by"))
        return fits.join(by, "_group").select("_group", "m", F.transform("w", lambda v: v / F.greatest("by", F.lit(1.0))).alias("w"))
    first = stored(scaled(best), "fit")
    near = _meet(members, first, ["_group"]).where(_distance(p) <= _chi2(p, 1.96))
    again = near.groupBy("_group").agg(*_sums(p)).withColumn("_start", F.lit(0))
    return stored(scaled(stored(frames(again, _matrices(p, floors), _FIT).select("_group", "m", "w"), "fit")), "fit")


def judge(counted: DataFrame, fits: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counted texts with ``_failed`` (base rules), ``_distance`` and ``_kept``.

    A row takes the estimate of its source within its language, else of its
    language, else of all rows; where there is none it is kept on the base rules alone.
    """
    p = len(FLOORS)
    names = counted.columns
    table = fits.select(F.col("_group").alias("g"), F.struct("m", "w").alias("f"))
    out = counted.select("*", *[c.alias(f"x{i}") for i, c in enumerate(vector())], F.array(*_groups()).alias("_levels"))
    for level in range(3):
        mine = table.select(F.col("g").alias(f"_g{level}"), F.col("f").alias(f"_f{level}"))
        out = out.join(mine, F.col("_levels")[level] == F.col(f"_g{level}"), "left")
    chosen = F.coalesce("_f0", "_f1", "_f2")
    out = out.select(*names, *[f"x{i}" for i in range(p)], chosen["m"].alias("m"), chosen["w"].alias("w"))
    out = out.select(*names, base_failed().alias("_failed"), F.sqrt(F.greatest(_distance(p), F.lit(0.0))).alias("_distance"))
    return out.withColumn("_kept", ~F.col("_failed") & F.coalesce(F.col("_distance") <= cutoff, F.lit(True)))


def counted(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Counts of every text beside ``keep``; null language and source are groups of their own."""
    named = docs.select(*keep, F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    return text_counts(named, [*keep, "_lang", "_source"], "_text")
