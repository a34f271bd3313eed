"""Strictly backward-looking per-entity features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions import fixed
from txnlens.operators.ordered import Chunks, before, by_heat, global_rank, plan_chunks, prior
from txnlens.roles import MICROS, Roles


def expanding_columns(roles: Roles, n: Column, total: Column, squares: Column, largest: Column) -> dict[str, Column]:
    """The expanding features as expressions over the running sufficient statistics."""
    x = F.col(roles.amount)
    total = F.coalesce(total, F.lit(0.0))
    squares = F.coalesce(squares, F.lit(0.0))
    mean = F.when(n > 0, total / n).otherwise(0.0)
    var = F.when(n > 1, (squares - total * total / n) / (n - 1)).otherwise(0.0)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return {
        "tx_count": n,
        "tx_sum": total,
        "mean_amount": mean,
        "max_amount": F.coalesce(largest, F.lit(0.0)),
        "std_amount": std,
        "amount_vs_mean_ratio": F.when(mean > 0, x / mean).otherwise(1.0),
        "amount_zscore": F.when(std > 0, (x - mean) / (std + 1e-6)).otherwise(0.0),
    }


_STATS = ["_n", "_s", "_q", "_mx", "_last"]


def _with_running_stats(df: DataFrame, roles: Roles, carried: DataFrame | None, chunks: Chunks) -> DataFrame:
    x = F.col(roles.amount).cast("double")
    out = prior(df, [roles.entity], roles.order, {
        "_n": ("count", F.lit(1)), "_s": ("sum", x), "_q": ("sum", x * x),
        "_mx": ("max", x), "_last": ("max", F.col(roles.ts)),
    }, chunks)
    if carried is None:
        return out
    joined = with_carried(out, carried, roles.entity)
    return joined.withColumns({
        "_n": F.col("_n") + F.coalesce("c_n", F.lit(0)),
        "_s": F.coalesce("_s", F.lit(0.0)) + F.coalesce("c_sum", F.lit(0.0)),
        "_q": F.coalesce("_q", F.lit(0.0)) + F.coalesce("c_sum_sq", F.lit(0.0)),
        "_mx": F.greatest("_mx", "c_max"),
        "_last": F.greatest("_last", "c_last_ts"),
    }).drop("c_n", "c_sum", "c_sum_sq", "c_max", "c_last_ts")


def with_carried(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Attach each row's carried entity totals; the missing entity is a group of its own."""
    renamed = state.select(F.col(key).alias("_state_key"), *[F.col(c).alias(f"c_{c}") for c in state.columns if c != key])
    return df.join(renamed, F.col(key).eqNullSafe(F.col("_state_key")), "left").drop("_state_key")


def entity_expanding(
    df: DataFrame, roles: Roles = Roles(), carried: DataFrame | None = None, chunks: Chunks = None
) -> DataFrame:
    """Count, sum, mean, max, deviation, ratio and z-score against the entity's earlier rows."""
    out = _with_running_stats(df, roles, carried, chunks)
    return out.withColumns(expanding_columns(roles, *[F.col(c) for c in _STATS[:4]])).drop(*_STATS)


def gap_columns(ts: Column, last: Column) -> dict[str, Column]:
    """Seconds since the previous row, -1 without one or when the row is backdated."""
    gap = (ts - last) / float(MICROS)
    clean = F.when(gap >= 0, gap).otherwise(fixed.HISTORY_FILL)
    return {"since_last": clean, "since_last_log": F.when(clean > 0, F.log1p(clean)).otherwise(fixed.HISTORY_FILL)}


def time_since_last(
    df: DataFrame, roles: Roles = Roles(), carried: DataFrame | None = None, chunks: Chunks = None
) -> DataFrame:
    out = prior(df, [roles.entity], roles.order, {"_last": ("max", F.col(roles.ts))}, chunks)
    last = F.col("_last")
    if carried is not None:
        out = with_carried(out, carried.select(roles.entity, "last_ts"), roles.entity)
        last = F.greatest("_last", "c_last_ts")
    return out.withColumns(gap_columns(F.col(roles.ts), last)).drop("_last", "c_last_ts")


def _trailing(df: DataFrame, roles: Roles, spans_s: dict[str, int], with_sum: bool, n: str, total: str,
              chunks: Chunks) -> DataFrame:
    """Columns ``_wn_<span>`` and ``_ws_<span>``: rows and amount inside each trailing span.

    The span's content is what the running count and sum had reached before the row, less what they had
    reached before the span began.
    """
    measures = {"_bn": ("count", F.lit(1))} | ({"_bs": ("sum", F.col(roles.amount).cast("double"))} if with_sum else {})
    micros = {name: s * MICROS for name, s in spans_s.items()}
    df = before(df, [roles.entity], roles.ts, roles.id, measures, micros, chunks)
    out = {f"_wn_{s}": F.col(n) - F.col(f"_bn_{s}") for s in micros}
    if with_sum:
        out |= {f"_ws_{s}": F.coalesce(total, F.lit(0.0)) - F.col(f"_bs_{s}") for s in micros}
    return df.withColumns(out).drop(*[f"{m}_{s}" for m in measures for s in micros])


def _running(df: DataFrame, roles: Roles, with_sum: bool, chunks: Chunks) -> DataFrame:
    total = {"_ps": ("sum", F.col(roles.amount).cast("double"))} if with_sum else {}
    return prior(df, [roles.entity], roles.order, {"_pn": ("count", F.lit(1)), **total}, chunks)


def trailing_counts(
    df: DataFrame, roles: Roles = Roles(), spans_s: dict[str, int] = fixed.TRAILING_SPANS_S,
    strict: bool = False, chunks: Chunks = None,
) -> DataFrame:
    """Earlier rows of the entity with ``ts >= t - span``; ``strict`` leaves out rows at ``t`` itself."""
    def run(d: DataFrame, plan: Chunks) -> DataFrame:
        out = _trailing(_running(d, roles, False, plan), roles, spans_s, False, "_pn", "_ps", plan)
        return out.withColumns({f"tx_count_{s}": F.col(f"_wn_{s}") for s in spans_s}).drop(
            "_pn", *[f"_wn_{s}" for s in spans_s])

    out = by_heat(df, [roles.entity], roles.order, run, chunks)
    if not strict:
        return out
    same = prior(out, [roles.entity, roles.ts], [roles.id], {"_same": ("count", F.lit(1))})
    return same.withColumns({f"tx_count_{s}": F.col(f"tx_count_{s}") - F.col("_same") for s in spans_s}).drop("_same")


def trailing_mean(
    df: DataFrame, roles: Roles = Roles(), span: str = "24h", span_s: int = 86_400, chunks: Chunks = None
) -> DataFrame:
    """Mean amount of the entity's rows inside the trailing span, 0 without any."""
    def run(d: DataFrame, plan: Chunks) -> DataFrame:
        out = _trailing(_running(d, roles, True, plan), roles, {span: span_s}, True, "_pn", "_ps", plan)
        mean = F.when(F.col(f"_wn_{span}") > 0, F.col(f"_ws_{span}") / F.col(f"_wn_{span}")).otherwise(0.0)
        return out.withColumn(f"amt_{span}_mean", mean).drop("_pn", "_ps", f"_wn_{span}", f"_ws_{span}")

    return by_heat(df, [roles.entity], roles.order, run, chunks)


def ratio_of_means(short: Column, long: Column) -> Column:
    return F.when((short > 0) & (long > 0), short / long).otherwise(1.0)


def short_long_ratio(df: DataFrame, roles: Roles = Roles(), chunks: Chunks = None) -> DataFrame:
    """Trailing-day mean against the lifetime mean of the entity."""
    out = by_heat(df, [roles.entity], roles.order, lambda d, plan: entity_expanding(
        trailing_mean(d, roles, chunks=plan), roles, chunks=plan), chunks)
    return out.withColumn("amt_24h_vs_mean_ratio", ratio_of_means(F.col("amt_24h_mean"), F.col("mean_amount")))


def velocity_features(
    df: DataFrame, roles: Roles = Roles(), carried: DataFrame | None = None, recent: DataFrame | None = None,
    chunks: Chunks = None,
) -> DataFrame:
    """All per-entity features in one pass: expanding, gap, trailing counts, trailing mean and ratio.

    To continue an earlier table, ``carried`` holds its ``entity_state`` and ``recent`` its rows of the last day.
    """
    rows = df
    if recent is not None:
        rows = df.withColumn("_new", F.lit(True)).unionByName(
            recent.select(roles.entity, roles.ts, roles.id, roles.amount).withColumn("_new", F.lit(False)), allowMissingColumns=True)
    return by_heat(rows, [roles.entity], roles.order, lambda d, plan: _velocity(d, roles, carried, plan), chunks)


def _velocity(df: DataFrame, roles: Roles, carried: DataFrame | None, chunks: Chunks) -> DataFrame:
    day, spans = "24h", fixed.TRAILING_SPANS_S
    if carried is None and "_new" not in df.columns:
        # The running count and sum serve the trailing windows too.
        out = _trailing(_with_running_stats(df, roles, None, chunks), roles, spans, True, "_n", "_s", chunks)
    else:
        out = _trailing(_running(df, roles, True, chunks), roles, spans, True, "_pn", "_ps", chunks).drop("_pn", "_ps")
        if "_new" in df.columns:
            out = out.where("_new").drop("_new")
        out = _with_running_stats(out, roles, carried, chunks)
    out = out.withColumns({
        **expanding_columns(roles, *[F.col(c) for c in _STATS[:4]]),
        **gap_columns(F.col(roles.ts), F.col("_last")),
    }).drop(*_STATS)
    out = out.withColumns({f"tx_count_{s}": F.col(f"_wn_{s}") for s in spans})
    mean = F.when(F.col(f"_wn_{day}") > 0, F.col(f"_ws_{day}") / F.col(f"_wn_{day}")).otherwise(0.0)
    out = out.withColumn("amt_24h_mean", mean)
    out = out.withColumn("amt_24h_vs_mean_ratio", ratio_of_means(F.col("amt_24h_mean"), F.col("mean_amount")))
    return out.drop(*[f"_w{m}_{s}" for m in "ns" for s in spans])


def smoothed(hits: Column, n: Column, prior_rate: Column, weight: float) -> Column:
    return (F.coalesce(hits, F.lit(0)) + F.lit(weight) * prior_rate) / (F.coalesce(n, F.lit(0)) + F.lit(weight))


def target_encode(
    df: DataFrame, keys: Sequence[str], prior_rate: Column, roles: Roles = Roles(),
    weight: float = fixed.TARGET_PRIOR_WEIGHT, chunks: Chunks = None,
) -> DataFrame:
    """Smoothed label rate of each key's strictly earlier rows; a null key is a group."""
    chunks = plan_chunks(df, roles.ts, roles.id, chunks)
    for key in keys:
        df = prior(df, [key], roles.order, {"_n": ("count", F.lit(1)), "_y": ("sum", F.col(roles.label))}, chunks)
        df = df.withColumn(f"{key}_target_enc", smoothed(F.col("_y"), F.col("_n"), prior_rate, weight)).drop("_n", "_y")
    return df


def target_encode_lagged(
    df: DataFrame, keys: Sequence[str], prior_rate: Column, lag_s: int, roles: Roles = Roles(),
    weight: float = fixed.TARGET_PRIOR_WEIGHT, chunks: Chunks = None,
) -> DataFrame:
    """As ``target_encode`` but a label counts only once it is ``lag_s`` old."""
    chunks = plan_chunks(df, roles.ts, roles.id, chunks)
    for key in keys:
        df = before(
            df, [key], roles.ts, roles.id, {"_n": ("count", F.lit(1)), "_y": ("sum", F.col(roles.label))},
            {"lag": lag_s * MICROS - 1}, chunks,
        )
        df = df.withColumn(f"{key}_target_enc", smoothed(F.col("_y_lag"), F.col("_n_lag"), prior_rate, weight))
        df = df.drop("_n_lag", "_y_lag")
    return df


def arrival_flags(
    df: DataFrame, arrival: Sequence[str], roles: Roles = Roles(), max_backdate_s: int = fixed.MAX_BACKDATE_S,
    chunks: Chunks = None,
) -> DataFrame:
    """Flags in arrival order: behind the entity's newest row, and too far behind it to be accepted."""
    out = prior(df, [roles.entity], arrival, {"_seen": ("max", F.col(roles.ts))}, chunks)
    behind = F.col("_seen") - F.col(roles.ts)
    return out.withColumns({
        "out_of_order": F.coalesce((behind > 0).cast("int"), F.lit(0)),
        "stale": F.coalesce((behind > max_backdate_s * MICROS).cast("int"), F.lit(0)),
    }).drop("_seen")


def last_k(df: DataFrame, k: int, roles: Roles = Roles()) -> DataFrame:
    """The newest ``k`` rows of every entity; Spark trims each map task to ``k`` per entity first."""
    newest = Window.partitionBy(roles.entity).orderBy(*[F.desc(c) for c in roles.order])
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= k).drop("_rn")


def quantile_bucket(df: DataFrame, col: str, k: int, order: Sequence[str], out: str, chunks: Chunks = None) -> DataFrame:
    """Equal-count buckets of a column, ties ranked by ``order``."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = global_rank(df, [col, *order], "_rank", chunks)
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    bucket = F.greatest(F.ceil(F.col("_rank") * k / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0)).cast("int")
    return ranked.withColumn(out, bucket).drop("_rank")
