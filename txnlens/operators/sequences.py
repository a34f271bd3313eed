"""Per-entity sequences of the last rows, padded on the left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.operators.ordered import Chunks, history
from txnlens.operators.windows import last_k
from txnlens.roles import Roles

SEQUENCE_LENGTH = 10


def build_sequences(
    df: DataFrame, features: Sequence[str], roles: Roles = Roles(), n: int = SEQUENCE_LENGTH,
    max_rows: int | None = None, chunks: Chunks = None,
) -> DataFrame:
    """``seq`` (n vectors, zeros first) and ``mask`` (1 = real) from the last n rows including the row itself."""
    if max_rows is not None:
        df = df.orderBy(*roles.order).limit(max_rows)
    item = F.array(*[F.col(c).cast("float") for c in features])
    out = history(df, [roles.entity], roles.order, item, n, "seq", True, chunks)
    pad = F.lit(n) - F.size("seq")
    zeros = F.array(*[F.lit(0.0).cast("float")] * len(features))
    return out.withColumns({
        "mask": F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), F.size("seq"))),
        "seq": F.concat(F.array_repeat(zeros, pad), F.col("seq"))})


def sequences_across(
    df: DataFrame, features: Sequence[str], split: str, wanted: str, roles: Roles = Roles(), n: int = SEQUENCE_LENGTH,
    chunks: Chunks = None,
) -> DataFrame:
    """Sequences of one split with history from the earlier ones.

    Earlier splits contribute only their last n - 1 rows per entity, which is all a window can reach.
    """
    earlier = {"train": [], "val": ["train"], "test": ["train", "val"]}[wanted]
    own = df.where(F.col(split) == wanted)
    if not earlier:
        return build_sequences(own, features, roles, n, chunks=chunks)
    context = last_k(df.where(F.col(split).isin(earlier)), n - 1, roles)
    return build_sequences(own.unionByName(context), features, roles, n, chunks=chunks).where(F.col(split) == wanted)


def static_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def cardinalities(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Largest code + 1 of every categorical column."""
    wide = df.agg(*[(F.max(c) + 1).cast("int").alias(c) for c in codes])
    return wide.unpivot([], list(codes), "column", "cardinality")


def partial_sequence_count(seqs: DataFrame, n: int = SEQUENCE_LENGTH) -> DataFrame:
    """Rows whose history is shorter than n."""
    real = F.aggregate("mask", F.lit(0), lambda acc, x: acc + x)
    return seqs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(real < n, 1).otherwise(0)).alias("partial_sequences"))


def sequence_feature_cols(df: DataFrame, roles: Roles = Roles(), static: Sequence[str] = ()) -> list[str]:
    """Numeric columns for sequences: no cohort, trailing-window or distance columns, no keys, label or time."""
    left_out = ("uid_", "tx_count_10min", "tx_count_1h", "tx_count_24h", "amt_24h", "dist")
    keys = {roles.id, roles.entity, roles.ts, roles.label, *static}
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, t in df.dtypes if t in numeric and c not in keys and not c.startswith(left_out)]
