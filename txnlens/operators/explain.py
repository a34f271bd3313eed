"""Additive contributions of a linear model and the tables built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_contributions(df: DataFrame, key: str, coefs: dict[str, float], means: DataFrame) -> DataFrame:
    """Exact additive contributions ``coef * (x - mean)`` in long form; ``means`` has one row."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.lit(float(w)) * (F.col(c) - means.select(c).scalar())).alias("contribution"))
        for c, w in coefs.items()])
    return df.select(key, F.explode(cells).alias("x")).select(key, "x.*")


def feature_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def margins(df: DataFrame, key: str, coefs: dict[str, float], intercept: float) -> DataFrame:
    score = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for c, w in coefs.items()])
    return df.select(key, (F.lit(float(intercept)) + score).alias("margin"))


def additivity_violations(long: DataFrame, margin: DataFrame, key: str, base: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """Rows whose base value plus contributions misses the margin."""
    sums = long.groupBy(key).agg(F.sum("contribution").alias("total"))
    gap = F.abs(base.scalar() + F.col("total") - F.col("margin"))
    return sums.join(margin, key).where(gap > tolerance)


def top_contributors(long: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k largest positive and k largest negative contributions of every row, ranked by size."""
    signed = long.where(F.col("contribution") != 0).withColumn(
        "direction", F.when(F.col("contribution") > 0, "risk").otherwise("mitigating"))
    size = F.desc(F.abs("contribution"))
    per_sign = Window.partitionBy(key, "direction").orderBy(size, "feature")
    kept = signed.withColumn("_rn", F.row_number().over(per_sign)).where(F.col("_rn") <= k).drop("_rn")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(size, "feature")))


def global_importance(long: DataFrame, top: int = 15) -> DataFrame:
    return long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(
        F.desc("importance"), "feature").limit(top)


def contribution_points(long: DataFrame, key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """The same ``n`` rows for every feature, in hash order, with min-max scaled values (0 for a constant feature).

    The rows are chosen once as a top-n over keys, so no feature gathers all its rows in one task.
    """
    u = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    keys = long.select(key).distinct().withColumn("_u", u).orderBy("_u", key).limit(n).select(key)
    picked = long.join(keys, key, "left_semi")
    spans = picked.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return picked.join(F.broadcast(spans), "feature").withColumn("scaled", scaled).drop("_lo", "_hi")


def example_cases(df: DataFrame, key: str, threshold: float, order: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """The first true positive, missed fraud and false alarm."""
    hit = F.col(p) >= threshold
    outcome = F.when(hit & (F.col(y) == 1), "TP").when(~hit & (F.col(y) == 1), "FN").when(hit, "FP")
    rows = df.withColumn("outcome", outcome).where(F.col("outcome").isNotNull())
    first = F.min(F.struct(*order, key, p))
    return rows.groupBy("outcome").agg(first.alias("r")).select("outcome", F.col(f"r.{key}").alias(key), F.col(f"r.{p}").alias(p))
