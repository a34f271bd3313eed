"""Chronological splits. Rows are compared with the boundary row, so the table itself is never ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from txnlens.functions.rowwise import unit_hash
from txnlens.operators.ordered import Chunks, rows_at
from txnlens.roles import Roles


def cut_rows(df: DataFrame, order: Sequence[str], shares: Sequence[float], chunks: Chunks = None) -> list[Row | None]:
    """The fitted boundaries: for each share the row at position ``int(n * share)``."""
    n = df.count()
    return rows_at(df, order, [int(n * share) for share in shares], chunks)


def at_or_after(order: Sequence[str], cut: Row | None) -> Column:
    """True for rows not before the boundary row; nobody when the boundary is past the end."""
    if cut is None:
        return F.lit(False)
    out = F.lit(True)
    for c in reversed(order):
        out = (F.col(c) > F.lit(cut[c])) | ((F.col(c) == F.lit(cut[c])) & out)
    return out


def time_split(df: DataFrame, ratio: float = 0.8, roles: Roles = Roles(), chunks: Chunks = None) -> DataFrame:
    """``split`` = train for the first ``int(n * ratio)`` rows by time, else test."""
    (cut,) = cut_rows(df, roles.order, [ratio], chunks)
    return df.withColumn("split", F.when(at_or_after(roles.order, cut), "test").otherwise("train"))


def time_split3(
    df: DataFrame, train: float = 0.7, val: float = 0.1, roles: Roles = Roles(), chunks: Chunks = None
) -> DataFrame:
    """Train, validation and test by time. The second cut is ``int(n * (train + val))`` in floating point."""
    first, second = cut_rows(df, roles.order, [train, train + val], chunks)
    late, held_out = at_or_after(roles.order, second), at_or_after(roles.order, first)
    return df.withColumn("split", F.when(late, "test").when(held_out, "val").otherwise("train"))


def tail_fraction(df: DataFrame, share: float = 0.15, roles: Roles = Roles(), chunks: Chunks = None) -> DataFrame:
    """Mark the last part by time as internal validation."""
    (cut,) = cut_rows(df, roles.order, [1 - share], chunks)
    return df.withColumn("is_tail", at_or_after(roles.order, cut).cast("int"))


def split_stats(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(roles.label).alias("fraud_rate"),
        F.min(roles.ts).alias("first_ts"),
        F.max(roles.ts).alias("last_ts"),
    )


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Splits under one another with their name; the columns must agree."""
    frames = list(parts.items())
    width = set(frames[0][1].columns)
    for name, frame in frames:
        if set(frame.columns) != width:
            raise ValueError(f"columns of split {name} differ")
    out = frames[0][1].withColumn("split", F.lit(frames[0][0]))
    for name, frame in frames[1:]:
        out = out.unionByName(frame.withColumn("split", F.lit(name)))
    return out


def partition_violations(df: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Ids that are not in exactly one of the parts, or not in the table."""
    seen = df.select(key, F.lit(1).alias("in_table"), F.lit(0).alias("in_part"))
    for part in parts:
        seen = seen.unionByName(part.select(key, F.lit(0).alias("in_table"), F.lit(1).alias("in_part")))
    sums = seen.groupBy(key).agg(F.sum("in_table").alias("in_table"), F.sum("in_part").alias("in_part"))
    return sums.where((F.col("in_table") != 1) | (F.col("in_part") != 1))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, in hash order."""
    u = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed).cast("string")))
    return df.withColumn("_u", u).orderBy("_u", key).limit(n).drop("_u")


def sample_entities(df: DataFrame, share: float, entity: str, seed: int = 42) -> DataFrame:
    """All rows of a reproducible share of the entities; a filter, so nothing moves."""
    return df.where(unit_hash(entity, F.lit(seed)) < share)
