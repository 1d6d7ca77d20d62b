"""Feature selection, frozen scaling and fused-table quality."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators.features import FUSED_KEYS, FUSED_TARGET, numeric_columns
from roadweave.operators.moments import Moments, moments

CORRELATION_LIMIT = 0.95


def candidates(df: DataFrame, target: str, keys: tuple[str, ...] = FUSED_KEYS) -> list[str]:
    """Numeric columns that are neither key nor target, in column order."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is missing")
    found = numeric_columns(df, [*keys, "source_date", target])
    if not found:
        raise ValueError("no numeric feature column")
    return found


def fill_for_model(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Features: null -> 0. Target: null -> its mean (a scalar subquery)."""
    mean = df.agg(F.avg(target)).scalar()
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features},
            target: F.coalesce(F.col(target).cast("double"), mean),
        }
    )


def correlation_matrix(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Pearson matrix in one distributed pass; constant columns give NaN.

    Only the (columns x columns) matrix reaches the driver.
    """
    return moments(df, features).correlations()


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """Upper triangle of the matrix as rows; null where a column is constant."""
    m = correlation_matrix(df, features)
    rows = []
    for i, a in enumerate(features):
        for j in range(i + 1, len(features)):
            rows.append((a, features[j], None if math.isnan(m[i][j]) else float(m[i][j])))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def uncorrelated(
    features: list[str], matrix: list[list[float]], limit: float = CORRELATION_LIMIT
) -> list[str]:
    """Drop a column correlated above ``limit`` with any earlier one (dropped or not)."""
    kept = []
    for j, name in enumerate(features):
        if not any(abs(matrix[i][j]) > limit for i in range(j)):
            kept.append(name)
    return kept


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """F statistic of the linear regression of ``target`` on each single feature, from one pass."""
    rows = moments(df, features, target).f_scores()
    return df.sparkSession.createDataFrame(rows, "feature string, r double, f_score double")


def k_best(found: Moments, features: list[str], k: int) -> list[str]:
    """The ``k`` features of highest F, in column order; all when there are at most ``k``."""
    if len(features) <= k:
        return list(features)
    scored = {name: (r, f) for name, r, f in found.f_scores()}

    def score(c: str) -> float:
        r, f = scored[c]
        if r is None:
            return -math.inf
        return math.inf if f is None else f

    best = sorted(features, key=score, reverse=True)[:k]
    return [c for c in features if c in set(best)]


@dataclass(frozen=True)
class FrozenFeatures:
    """Selected features with the mean and population sd they are scaled by."""

    target: str
    names: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]

    def transform(self, df: DataFrame, keep: tuple[str, ...] = FUSED_KEYS) -> DataFrame:
        """Keys, target and scaled features; features a table lacks count as 0."""
        have = set(df.columns)
        scaled = []
        for c, mean, sd in zip(self.names, self.means, self.sds, strict=True):
            value = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
            scaled.append(((value - F.lit(mean)) / F.lit(sd)).alias(c))
        keys = [c for c in (*keep, self.target) if c in have]
        return df.select(*keys, *scaled)

    def save(self, spark, path: str) -> None:
        rows = list(
            zip(range(len(self.names)), self.names, self.means, self.sds, strict=True)
        )
        spark.createDataFrame(rows, "position int, feature string, mean double, sd double").withColumn(
            "target", F.lit(self.target)
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> FrozenFeatures:
        rows = spark.read.parquet(path).orderBy("position").collect()
        return FrozenFeatures(
            rows[0]["target"],
            tuple(r["feature"] for r in rows),
            tuple(r["mean"] for r in rows),
            tuple(r["sd"] for r in rows),
        )


def fit_scaler(df: DataFrame, features: list[str], target: str) -> FrozenFeatures:
    """Mean and population sd of every feature (null counts as 0); sd 0 scales by 1."""
    found = moments(df, features)
    means = tuple(float(m) for m in found.means)
    sds = tuple(float(d) or 1.0 for d in found.deviations)
    return FrozenFeatures(target, tuple(features), means, sds)


def select_features(
    df: DataFrame,
    target: str = FUSED_TARGET,
    k: int = 20,
    keys: tuple[str, ...] = FUSED_KEYS,
) -> list[str]:
    """Numeric candidates, minus near-duplicates, cut to the ``k`` best by F."""
    names = candidates(df, target, keys)
    found = moments(df, names, target)  # correlations and F come from one scan
    return k_best(found, uncorrelated(names, found.correlations()), k)


def fit_on_first_day(
    fused: DataFrame, target: str = FUSED_TARGET, k: int = 15, date: str = "date"
) -> FrozenFeatures:
    """Select and scale on the earliest usable date; the result is applied to every date.

    A date is usable with at least three rows, the fewest an F statistic needs.
    """
    per_date = fused.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    first = per_date.agg(
        F.coalesce(F.min(F.when(F.col("n") >= 3, F.col(date))), F.min(date))
    ).first()[0]
    day = fused.where(F.col(date) == F.lit(first))
    return fit_scaler(day, select_features(day, target, k), target)


def fused_quality(df: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """Per group: rows, complete rows %, target sd and range, feature spread, score."""
    complete = F.lit(True)
    for c in [c for c in df.columns if c not in by]:
        complete = complete & F.col(c).isNotNull()
    sds = [F.stddev_samp(F.col(c).cast("double")).alias(f"_sd{i}") for i, c in enumerate(features)]
    row = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("record_count"),
        (F.avg(complete.cast("int")) * 100).alias("data_completeness"),
        F.stddev_samp(target).alias("target_std"),
        (F.max(target) - F.min(target)).alias("target_range"),
        *sds,
    )
    spread = F.array_compact(F.array(*[F.col(f"_sd{i}") for i in range(len(features))]))
    total = F.aggregate(spread, F.lit(0.0), lambda acc, x: acc + x)
    out = row.select(
        *by,
        "record_count",
        F.lit(len(features)).alias("feature_count"),
        "data_completeness",
        "target_std",
        "target_range",
        F.try_divide(total, F.size(spread)).alias("feature_variance"),
        F.size(F.filter(spread, lambda s: s < 0.01)).alias("low_variance_features"),
    )
    return out.withColumn(
        "quality_score",
        F.least(F.lit(30.0), F.col("data_completeness") * 0.3)
        + F.least(F.lit(25.0), F.col("record_count") / 100.0 * 25)
        + F.least(F.lit(20.0), F.col("feature_count") / 15.0 * 20)
        + F.least(F.lit(15.0), F.coalesce("target_std", F.lit(0.0)) / 10.0 * 15)
        + F.least(F.lit(10.0), F.coalesce("feature_variance", F.lit(0.0)) * 100),
    )
