"""Fitted per-entity state and descriptive aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.encoders import grouped_quantiles
from txnlens.operators.ordered import Chunks
from txnlens.roles import MICROS, Roles


def label_totals(df: DataFrame, key: str, label: str = "y") -> DataFrame:
    return df.groupBy(key).agg(F.sum(label).cast("long").alias("label_sum"), F.count(F.lit(1)).alias("n"))


def entity_state(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """End-of-table statistics of every entity: what a later row needs to continue its history."""
    x = F.col(roles.amount).cast("double")
    return df.groupBy(roles.entity).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"), F.max(x).alias("max"),
        F.max(roles.ts).alias("last_ts"))


def merged_state(parts: Sequence[DataFrame], roles: Roles = Roles()) -> DataFrame:
    """One state table from those of consecutive tables."""
    return reduce(DataFrame.unionByName, parts).groupBy(roles.entity).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"), F.max("max").alias("max"),
        F.max("last_ts").alias("last_ts"))


def entity_recent(df: DataFrame, span_s: int = 86_400, roles: Roles = Roles()) -> DataFrame:
    """Rows within the span of their entity's newest row, in long form so that no entity becomes one cell."""
    newest = df.groupBy(F.col(roles.entity).alias("_entity")).agg(F.max(roles.ts).alias("_newest"))
    joined = df.join(newest, F.col(roles.entity).eqNullSafe(F.col("_entity")))
    return joined.where(F.col(roles.ts) >= F.col("_newest") - span_s * MICROS).select(
        roles.entity, roles.ts, roles.id, roles.amount)


def fit_prior(df: DataFrame, label: str = "y") -> DataFrame:
    return df.agg(F.avg(label).alias("prior"))


def known_entities(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("known_entities"))


def state_age(state: DataFrame, now_micros: Column, produced: str = "last_ts") -> DataFrame:
    """Seconds between ``now`` and the newest entry of a state table."""
    return state.agg(((now_micros - F.max(produced)) / float(MICROS)).alias("age_seconds"))


def missing_profile(df: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """Share of nulls per column, with its family; one pass for all columns."""
    cols = [(f, c) for f, cs in families.items() for c in cs]
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for _, c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(c).alias("column"), F.col(c).alias("null_share")) for f, c in cols])).alias("x")).select("x.*")


def missing_by_family(profile: DataFrame) -> DataFrame:
    return profile.groupBy("family").agg(
        F.count(F.lit(1)).alias("columns"), F.avg("null_share").alias("null_share"),
        F.sum((F.col("null_share") > 0.5).cast("int")).cast("long").alias("over_50"),
        F.sum((F.col("null_share") > 0.9).cast("int")).cast("long").alias("over_90"))


def describe_by(df: DataFrame, group: str, col: str, chunks: Chunks = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of a column for every group, null among them."""
    basic = df.groupBy(group).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    at = grouped_quantiles(df, group, col, [0.25, 0.5, 0.75], chunks).groupBy(F.col(group).alias("_group")).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return basic.join(at, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def rate_by(df: DataFrame, keys: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Fraud rate, rows, share of the table and mean amount by key."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(roles.label).cast("long").alias("frauds"), F.avg(roles.label).alias("fraud_rate"),
        F.avg(roles.amount).alias("mean_amount")).withColumn("share", F.col("n") / n)


def rate_pivot(df: DataFrame, rows: str, cols: str, values: Sequence[object], prefix: str, label: str = "y") -> DataFrame:
    """Fraud rate by rows x columns; the column values are given, so no extra pass finds them."""
    out = df.groupBy(rows).pivot(cols, list(values)).agg(F.avg(label))
    return out.select(rows, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])


def entity_profile(df: DataFrame, min_rows: int = 5, roles: Roles = Roles()) -> DataFrame:
    return df.groupBy(roles.entity).agg(
        F.count(F.lit(1)).alias("n"), F.avg(roles.amount).alias("mean_amount"), F.max(roles.amount).alias("max_amount"),
        F.stddev_samp(roles.amount).alias("std_amount"), F.avg(roles.label).alias("fraud_rate")).where(F.col("n") >= min_rows)


def round_amount_rate(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return df.groupBy(roles.label).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(roles.amount) % 1.0 == 0).cast("int")).alias("round_rate"))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int, by: str) -> DataFrame:
    """Rows per equal-width bin and group; values outside the range fall into the end bins."""
    position = F.floor((F.col(col) - low) / ((high - low) / bins))
    b = F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def corr_with_label(df: DataFrame, cols: Sequence[str], label: str = "y") -> DataFrame:
    """Absolute Pearson correlation of each column with the label, ranked over the column list."""
    wide = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(label).cast("double"))).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "column", "abs_corr")
    rank = F.row_number().over(Window.orderBy(F.desc("abs_corr"), "column"))
    return long.withColumns({
        "rank": rank, "strong": (F.col("abs_corr") > 0.1).cast("int"), "weak": (F.col("abs_corr") < 0.01).cast("int")})


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of a fixed column list, all in one aggregation."""
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")


def corr_block(df: DataFrame, vector: str) -> DataFrame:
    """Pearson correlation of every column pair of a wide numeric block, nulls as zero.

    One distributed pass builds the d x d matrix (339 columns: 115 thousand numbers), whose size does not
    depend on the rows.
    """
    block = df.select(array_to_vector(F.transform(F.col(vector), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))).alias("v"))
    matrix = Correlation.corr(block, "v").first()[0].toArray()
    d = matrix.shape[0]
    rows = [(i, j, float(matrix[i, j])) for i in range(d) for j in range(i + 1, d)]
    return df.sparkSession.createDataFrame(rows, "a int, b int, corr double")


def redundant_share(pairs: DataFrame, cut: float = 0.8) -> DataFrame:
    high = (F.abs("corr") > cut).cast("int")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum(high).cast("long").alias("redundant"), F.avg(high).alias("share"))


def label_distribution(df: DataFrame, label: str = "y") -> DataFrame:
    pos, neg = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return df.agg(neg.alias("n_neg"), pos.alias("n_pos"), F.avg(label).alias("fraud_rate"),
                  F.when(pos > 0, neg / pos).alias("imbalance_ratio"))


def stream_counters(scored: DataFrame) -> DataFrame:
    """Operation counters of a scored table; ``decision``, ``error``, ``duplicate``, ``out_of_order``, ``partial``."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scored.agg(
        F.count(F.lit(1)).alias("processed"), count(F.col("decision") == "FRAUD").alias("alerts"),
        count(F.col("error") == 1).alias("errors"), count(F.col("duplicate") == 1).alias("duplicates"),
        count(F.col("out_of_order") == 1).alias("out_of_order"), count(F.col("partial") == 1).alias("partial_sequences"))


def top_categories(df: DataFrame, col: str, k: int = 10, label: str = "y") -> DataFrame:
    """The k most frequent values with their fraud rate."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("fraud_rate")).orderBy(F.desc("n"), col).limit(k)
