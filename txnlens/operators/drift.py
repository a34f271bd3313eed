"""Drift of a live window against a reference table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions import fixed
from txnlens.operators.ordered import Chunks, plan_chunks, prior


class EmptyWindowError(ValueError):
    """No verdict is possible from this window."""


@dataclass(frozen=True)
class DriftOptions:
    numeric_min_distinct: int = 5
    ks_factor: float = 1.358
    categorical_cut: float = 0.1
    share_threshold: float = fixed.DRIFT_SHARE_THRESHOLD
    missing_threshold: float = fixed.MISSING_SHARE_THRESHOLD


def usable_columns(reference: DataFrame, window: DataFrame) -> DataFrame:
    """Reference columns with their presence in the window and non-null rows; usable ones have such rows on both sides."""
    shared = [c for c in reference.columns if c in window.columns]
    absent = [c for c in reference.columns if c not in window.columns]
    counts = window.agg(*[F.count(c).alias(c) for c in shared], F.count(F.lit(1)).alias("_rows"))
    known = reference.agg(*[F.count(c).alias(c) for c in reference.columns]).first().asDict()
    cells = [F.struct(F.lit(c).alias("column"), F.lit(1).alias("present"), F.col(c).alias("filled"),
                      F.lit(int(known[c] > 0)).alias("known")) for c in shared]
    cells += [F.struct(F.lit(c).alias("column"), F.lit(0).alias("present"), F.lit(0).cast("long").alias("filled"),
                       F.lit(0).alias("known")) for c in absent]
    return counts.select(F.explode(F.array(*cells)).alias("x")).select(
        "x.column", "x.present", "x.filled",
        ((F.col("x.present") == 1) & (F.col("x.filled") > 0) & (F.col("x.known") == 1)).cast("int").alias("usable"))


def assert_window(reference: DataFrame, window: DataFrame) -> list[str]:
    """Comparable columns, or an error for an empty, disjoint or all-null window. Reads one row per column."""
    rows = usable_columns(reference, window).collect()
    if window.isEmpty():
        raise EmptyWindowError("the window has no rows")
    if not any(r["present"] for r in rows):
        raise EmptyWindowError("the window shares no column with the reference")
    usable = [r["column"] for r in rows if r["usable"]]
    if not usable:
        raise EmptyWindowError("every shared column is null on one side")
    return usable


def _values(reference: DataFrame, window: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """Every filled cell of the columns in long form with its side."""
    def long(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in cols])
        other = "cur" if side == "ref" else "ref"
        return df.select(F.explode(cells).alias("x")).select(
            "x.*", F.lit(1).cast("long").alias(side), F.lit(0).cast("long").alias(other)).where("value is not null")
    return long(reference, "ref").unionByName(long(window, "cur"))


def _value_counts(values: DataFrame) -> DataFrame:
    """Rows per (column, value) on both sides, one shuffle for all columns."""
    return values.groupBy("column", "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def numeric_drift(reference: DataFrame, window: DataFrame, cols: Sequence[str], options: DriftOptions = DriftOptions(),
                  chunks: Chunks = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and the Wasserstein distance in reference deviations."""
    values = _values(reference, window, cols, "double")
    plan = plan_chunks(values, "value", None, chunks)
    counts = _value_counts(values)
    totals = counts.groupBy("column").agg(
        F.sum("ref").alias("n"), F.sum("cur").alias("m"), F.count(F.lit(1)).alias("distinct"),
        F.sum(F.col("value") * F.col("ref")).alias("_s"), F.sum(F.col("value") * F.col("value") * F.col("ref")).alias("_q"))
    run = prior(counts, ["column"], ["value"], {
        "_r": ("sum", F.col("ref")), "_c": ("sum", F.col("cur")), "_before": ("max", F.col("value"))},
        plan if plan.plain else plan.for_all())
    run = run.join(F.broadcast(totals), "column")
    r0, c0 = F.coalesce("_r", F.lit(0)), F.coalesce("_c", F.lit(0))
    gap_after = F.abs((r0 + F.col("ref")) / F.col("n") - (c0 + F.col("cur")) / F.col("m"))
    gap_before = F.abs(r0 / F.col("n") - c0 / F.col("m"))
    width = F.coalesce(F.col("value") - F.col("_before"), F.lit(0.0))
    out = run.groupBy("column").agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.first("_s").alias("_s"), F.first("_q").alias("_q"),
        F.max(gap_after).alias("statistic"), F.sum(gap_before * width).alias("_w"))
    std = F.sqrt(F.greatest(F.col("_q") / F.col("n") - (F.col("_s") / F.col("n")) * (F.col("_s") / F.col("n")), F.lit(0.0)))
    cut = F.lit(options.ks_factor) * F.sqrt((F.col("n") + F.col("m")) / (F.col("n") * F.col("m")))
    return out.select(
        "column", F.lit("ks").alias("test"), "statistic", cut.alias("cut"),
        F.when(std > 0, F.col("_w") / std).alias("secondary"), (F.col("statistic") > cut).cast("int").alias("drifted"))


def categorical_drift(reference: DataFrame, window: DataFrame, cols: Sequence[str],
                      options: DriftOptions = DriftOptions()) -> DataFrame:
    """Jensen-Shannon distance (base 2) and the chi-square statistic of the two count rows."""
    counts = _value_counts(_values(reference, window, cols, "string"))
    totals = counts.groupBy("column").agg(F.sum("ref").alias("n"), F.sum("cur").alias("m"))
    x = counts.join(F.broadcast(totals), "column")
    a, b = F.col("ref") / F.col("n"), F.col("cur") / F.col("m")
    mid = (a + b) / 2
    part = lambda s: F.when(s > 0, s * F.log2(s / mid)).otherwise(0.0)
    both, total = F.col("ref") + F.col("cur"), F.col("n") + F.col("m")
    e_ref, e_cur = both * F.col("n") / total, both * F.col("m") / total
    chi = (F.col("ref") - e_ref) * (F.col("ref") - e_ref) / e_ref + (F.col("cur") - e_cur) * (F.col("cur") - e_cur) / e_cur
    out = x.groupBy("column").agg(
        F.sqrt(F.greatest((F.sum(part(a)) + F.sum(part(b))) / 2, F.lit(0.0))).alias("statistic"), F.sum(chi).alias("secondary"))
    cut = F.lit(options.categorical_cut)
    return out.select("column", F.lit("js").alias("test"), "statistic", cut.alias("cut"), "secondary",
                      (F.col("statistic") >= cut).cast("int").alias("drifted"))


def column_kinds(reference: DataFrame, cols: Sequence[str], options: DriftOptions = DriftOptions()) -> tuple[list[str], list[str]]:
    """Split columns into numeric and categorical; few-valued numbers count as categories.

    The distinct values are counted approximately when far above the limit and exactly near it.
    """
    numeric = [c for c in cols if isinstance(reference.schema[c].dataType, T.NumericType)]
    if not numeric:
        return [], list(cols)
    rough = reference.agg(*[F.approx_count_distinct(c).alias(c) for c in numeric]).first()
    near = [c for c in numeric if rough[c] <= 4 * options.numeric_min_distinct]
    exact = reference.agg(*[F.countDistinct(c).alias(c) for c in near]).first() if near else {}
    many = [c for c in numeric if c not in near or exact[c] > options.numeric_min_distinct]
    return many, [c for c in cols if c not in many]


def column_drift(reference: DataFrame, window: DataFrame, cols: Sequence[str], options: DriftOptions = DriftOptions(),
                 chunks: Chunks = None) -> DataFrame:
    """One row per compared column: test, statistic, cut, secondary statistic, drifted."""
    numeric, categorical = column_kinds(reference, cols, options)
    parts = []
    if numeric:
        parts.append(numeric_drift(reference, window, numeric, options, chunks))
    if categorical:
        parts.append(categorical_drift(reference, window, categorical, options))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drift_report(reference: DataFrame, window: DataFrame, options: DriftOptions = DriftOptions(),
                 chunks: Chunks = None) -> DataFrame:
    """The verdict row: drifted share, missing share, names and reasons."""
    usable = assert_window(reference, window)
    missing = sorted(set(reference.columns) - set(usable))
    columns = column_drift(reference, window, usable, options, chunks)
    share_missing = len(missing) / len(reference.columns)
    out = columns.agg(
        F.count(F.lit(1)).alias("compared"), F.sum("drifted").cast("long").alias("drifted"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drifted") == 1, F.col("column")))), ",").alias("drifted_features"))
    out = out.withColumns({
        "drift_share": F.col("drifted") / F.col("compared"),
        "missing_features": F.lit(",".join(missing)), "missing_share": F.lit(share_missing),
        "reference_rows": reference.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "current_rows": window.agg(F.count(F.lit(1)).alias("n")).scalar()})
    drifted = F.col("drift_share") > options.share_threshold
    incomplete = F.col("missing_share") > options.missing_threshold
    return out.withColumns({
        "drift_detected": (drifted | incomplete).cast("int"), "schema_incomplete": incomplete.cast("int"),
        "reason": F.concat_ws("; ", F.when(drifted, "features drifted"), F.when(incomplete, "schema incomplete"))})


def drift_alerts(report: DataFrame) -> DataFrame:
    """Alert rows: only reports that detected something."""
    return report.where(F.col("drift_detected") == 1)
