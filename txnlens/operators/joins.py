"""Joins. Sides are left to adaptive execution, which broadcasts below its size limit and splits skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_side(df: DataFrame, side: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Optional side table; rows without a match keep nulls."""
    return df.join(side, on, "left")


def match_rate(df: DataFrame, side: DataFrame) -> DataFrame:
    """Rows of both tables and the share of rows that have side data."""
    n, m = df.agg(F.count(F.lit(1)).alias("n")), side.agg(F.count(F.lit(1)).alias("m")).scalar()
    return n.select(F.col("n").alias("rows"), m.alias("side_rows"), (m / F.col("n")).alias("match_rate"))


def apply_map(df: DataFrame, state: DataFrame, key: str, default: dict[str, Column | float | str]) -> DataFrame:
    """Fitted lookup: ``state`` holds ``key`` and value columns; unseen keys take the defaults."""
    values = [c for c in state.columns if c != key]
    out = df.join(state, key, "left")
    filled = {}
    for c in values:
        if c in default:
            fill = default[c] if isinstance(default[c], Column) else F.lit(default[c])
            filled[c] = F.coalesce(F.col(c), fill)
    return out.withColumns(filled)


def rows_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def unseen_keys(fitted: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``other`` that the fitted table does not know."""
    return other.select(key).distinct().join(fitted.select(key).distinct(), key, "left_anti")


def attach_labels(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return rows.join(labels, key)
