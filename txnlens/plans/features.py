"""The feature compositions, as chained DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import fixed, rowwise
from txnlens.operators import encoders, windows
from txnlens.operators.ordered import Chunks
from txnlens.operators.splits import time_split3
from txnlens.roles import Roles

Step = Callable[[DataFrame], DataFrame]


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run user-defined feature steps in order."""
    for step in steps:
        df = df.transform(step)
    return df


def causal_steps(roles: Roles, domains: tuple[str, str], deltas: Sequence[str], counts: Sequence[str],
                 presence: dict[str, str], chunks: Chunks = None, device: tuple[str, str, str] | None = None) -> list[Step]:
    """Features without fitted state; all per-entity ones share one shuffle and one sort.

    ``device`` names the agent, device and resolution columns, where the table has them.
    """
    first = [lambda df: rowwise.device_features(df, *device)] if device else []
    return [
        *first,
        lambda df: rowwise.temporal_features(df, roles.ts),
        lambda df: rowwise.amount_features(df, roles.amount),
        lambda df: rowwise.pair_match_features(df, *domains),
        lambda df: rowwise.row_summary(df, deltas, "D", "d"),
        lambda df: rowwise.row_summary(df, counts, "C", "c"),
        lambda df: windows.velocity_features(df, roles, chunks=chunks),
        lambda df: rowwise.presence_flags(df, presence),
        lambda df: rowwise.interactions(df, roles.amount),
    ]


def features_full(df: DataFrame, roles: Roles, combo: Sequence[str], uid: Callable[[DataFrame], DataFrame], age: str,
                  scope: str, target_keys: Sequence[str], label_cols: Sequence[str], raw_cols: Sequence[str],
                  steps: Sequence[Step], lag_s: int, chunks: Chunks = None, freq_cols: Sequence[str] = (),
                  block: Sequence[str] = (), components: int = 30) -> DataFrame:
    """Null counts, split, causal features, then every fitted encoder: fit on train rows, applied to all.

    The columns of ``block`` are replaced by at most ``components`` components fitted on the train rows.

    Target encoding is one pass over the whole ordered table, so later splits continue from earlier ones and
    every label respects the lag across split borders.
    """
    base = uid(time_split3(rowwise.null_count_features(df, raw_cols), roles=roles, chunks=chunks))
    # Every fit reads the raw train rows only, never the growing feature table.
    train = base.where(F.col("split") == "train")
    in_scope = F.expr(scope)
    cut = encoders.fit_quantile(train.where(in_scope), roles.amount, chunks=chunks).first()["cut"]
    rate = train.agg(F.coalesce(F.avg(roles.label), F.lit(0.035)).alias("rate")).first()["rate"]
    out = apply_steps(base, steps)
    out = windows.target_encode_lagged(out, target_keys, F.lit(rate), lag_s, roles, fixed.TARGET_PRIOR_WEIGHT, chunks)
    out = rowwise.scoped_gradient(out, roles.amount, in_scope, F.lit(cut).cast("double"), "dist")
    for c in freq_cols:
        out = encoders.apply_frequency(out, encoders.frequency(train, c), c)
    out = encoders.combo_frequency(train, out, combo)
    out = encoders.apply_cohorts(train, out, "uid", roles.amount, age)
    for c in label_cols:
        out = encoders.apply_labels(out, encoders.fit_labels(train, c, chunks), c)
    if block:
        cells = F.array(*[F.col(c).cast("double") for c in block])
        stages = encoders.fit_pca(train.select(cells.alias("_block")), "_block", components)
        out = encoders.apply_pca(out.withColumn("_block", cells).drop(*block), stages, "_block")
    return encoders.impute(out, skip=[roles.label, "uid", "split"])
