"""Schema and row checks, projections to a trained schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions import fixed


def validate_schema(df: DataFrame, required: Sequence[str], label: str, forbidden: Sequence[str] = ()) -> DataFrame:
    """``(rule, subject, violations)``: missing and forbidden columns, labels outside {0, 1}."""
    bad = F.sum(F.when(~F.col(label).isin(0, 1), 1).otherwise(0)) if label in df.columns else F.lit(0)
    checks = [("required", c, F.lit(int(c not in df.columns)).cast("long")) for c in required]
    checks += [("forbidden", c, F.lit(int(c in df.columns)).cast("long")) for c in forbidden]
    checks.append(("label", label, F.coalesce(F.col("_bad"), F.lit(0)).cast("long")))
    return df.agg(bad.alias("_bad")).select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(s).alias("subject"), n.alias("violations")) for r, s, n in checks])).alias("x")).select("x.*")


def reject_reason(id_: str, ts: str, amount: str, entity: str) -> Column:
    """First broken row rule, null for a valid row."""
    key = F.trim(F.col(id_).cast("string"))
    when = F.col(ts).try_cast("double")
    money = F.col(amount).try_cast("double")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return (
        F.when(key.isNull() | (F.length(key) < 1) | (F.length(key) > fixed.MAX_ID_LENGTH), "id")
        .when(when.isNull() | ~finite(when) | (when < 0), "ts")
        .when(money.isNull() | ~finite(money) | (money <= 0) | (money > fixed.MAX_AMOUNT), "amount")
        .when(F.col(entity).try_cast("long").isNull(), "entity"))


def split_valid(df: DataFrame, id_: str, ts: str, amount: str, entity: str) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("reason", reject_reason(id_, ts, amount, entity))
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def drop_non_features(df: DataFrame, drop: Sequence[str], ts: str = "t") -> DataFrame:
    """Drop configured columns; time stays for ordering even when it is listed."""
    return df.drop(*[c for c in drop if c != ts])


def align(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exactly the trained columns in their order; a missing one is an error, extras go."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing trained columns: {missing}")
    return df.select(*features)


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every column of the schema in its order, absent ones as typed nulls."""
    return df.select(*[
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Strings to numbers plus ``corrupt``: filled cells that are not numbers make the row an error."""
    bad = reduce(lambda a, b: a + b, [
        (F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("int") for c in cols])
    return df.withColumn("corrupt", bad).withColumns({c: F.col(c).try_cast("double") for c in cols})


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_counts(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """Filled rows of each selected column."""
    wide = df.agg(*[F.count(c).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "filled").withColumn("kind", F.lit(kind))


def missing_features(reference: Sequence[str], current: Sequence[str]) -> list[str]:
    return sorted(set(reference) - set(current))


def cast_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast back to a reference schema; an integer target is refused where a value is fractional.

    One aggregation checks all columns. A refused column keeps its type, as a verdict row would say.
    """
    whole = [f for f in schema.fields if f.name in df.columns and isinstance(f.dataType, T.IntegralType)]
    fractional = lambda c: F.max(F.when(F.col(c).cast("double") != F.round(F.col(c).cast("double")), 1).otherwise(0))
    refused = df.agg(*[fractional(f.name).alias(f.name) for f in whole]).first() if whole else {}
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        keep = f in whole and refused[f.name] == 1
        out.append(F.col(f.name) if keep else F.col(f.name).cast(f.dataType))
    return df.select(*out)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive digest of the content."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).cast("string").alias("digest"))
