"""Money impact of a decision threshold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions import fixed
from txnlens.operators.curves import best_threshold, confusion_counts, ratio, sweep_counts
from txnlens.roles import DAY_S, MICROS


@dataclass(frozen=True)
class Costs:
    fn: float = fixed.COST_FN
    fp: float = fixed.COST_FP
    tp: float = fixed.REVENUE_TP

    @property
    def implied_swing(self) -> float:
        return self.tp + self.fn


CONVENTIONS = ("prd", "net_of_principal")


def annual_volume(df: DataFrame, ts: str = "t", y: str = "y") -> DataFrame:
    """Rows, span in whole days, yearly rows, fraud rate and yearly fraud of a table."""
    days = F.ceil((F.max(ts) - F.min(ts)) / float(MICROS) / DAY_S)
    out = df.agg(F.count(F.lit(1)).alias("n"), days.alias("span_days"), F.avg(y).alias("fraud_rate"))
    out = out.withColumn("annual_transactions", F.col("n") / F.greatest("span_days", F.lit(1)) * 365)
    return out.withColumn("annual_fraud", F.col("annual_transactions") * F.col("fraud_rate"))


def threshold_value(costs: Costs = Costs()) -> Column:
    return F.col("tp") * costs.tp - F.col("fp") * costs.fp - F.col("fn") * costs.fn


def optimal_threshold(
    df: DataFrame, costs: Costs = Costs(), grid: Sequence[float] | None = None, y: str = "y", p: str = "p",
    by: Sequence[str] = (),
) -> DataFrame:
    """Grid threshold with the best net value, the lowest one on ties."""
    return best_threshold(sweep_counts(df, grid, y, p, by), threshold_value(costs), by)


def _project(counts: DataFrame, costs: Costs, volume: DataFrame | None) -> DataFrame:
    """Rates of the counted split applied to a yearly volume, one row per cost convention."""
    n_fraud, n_legit = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    out = counts.withColumns({
        "recall": ratio(F.col("tp"), n_fraud), "fpr": ratio(F.col("fp"), n_legit),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
    })
    if volume is None:
        annual, fraud = n_fraud + n_legit, n_fraud
    else:
        annual = volume.select("annual_transactions").scalar()
        fraud = annual * n_fraud / (n_fraud + n_legit)
    out = out.withColumns({"annual_transactions": annual, "annual_fraud": fraud})
    out = out.withColumns({
        "annual_tp": F.col("annual_fraud") * F.col("recall"),
        "annual_fn": F.col("annual_fraud") * (1 - F.col("recall")),
        "annual_fp": (F.col("annual_transactions") - F.col("annual_fraud")) * F.col("fpr"),
    })
    prd = F.col("convention") == "prd"
    out = out.withColumn("convention", F.explode(F.array(*[F.lit(c) for c in CONVENTIONS])))
    out = out.withColumns({
        "gross_benefit": F.col("annual_tp") * costs.tp,
        "false_negative_loss": F.when(prd, F.col("annual_fn") * costs.fn).otherwise(0.0),
        "false_positive_cost": F.col("annual_fp") * costs.fp,
        "naive_baseline": F.when(prd, -F.col("annual_fraud") * costs.fn).otherwise(0.0),
    })
    net = F.col("gross_benefit") - F.col("false_negative_loss") - F.col("false_positive_cost")
    out = out.withColumn("net_value", net)
    return out.withColumns({
        "improvement": F.col("net_value") - F.col("naive_baseline"),
        "fp_per_fraud": F.when(F.col("annual_tp") > 0, F.col("annual_fp") / F.col("annual_tp")).otherwise(float("inf")),
        "implied_swing": F.lit(costs.implied_swing),
    })


def impact(
    df: DataFrame, threshold: float | Column, costs: Costs = Costs(), volume: DataFrame | None = None, y: str = "y",
    p: str = "p",
) -> DataFrame:
    """Yearly impact of one threshold under both cost conventions."""
    return _project(confusion_counts(df, threshold, y, p), costs, volume).withColumn("threshold", F.lit(threshold))


def impact_sweep(
    df: DataFrame, grid: Sequence[float] | None = None, costs: Costs = Costs(), volume: DataFrame | None = None,
    y: str = "y", p: str = "p",
) -> DataFrame:
    """Impact at every grid threshold under both conventions."""
    return _project(sweep_counts(df, grid, y, p), costs, volume)


def impact_table(sweep: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Chosen grid thresholds with their share of the convention's best value."""
    peak = sweep.groupBy("convention").agg(F.max("net_value").alias("peak"))
    chosen = sweep.where(F.col("threshold").isin([float(t) for t in thresholds]))
    return chosen.join(peak, "convention").withColumn("share_of_peak", F.col("net_value") / F.col("peak"))


def pnl(impact_rows: DataFrame) -> DataFrame:
    """Profit-and-loss lines of an impact row."""
    lines = (("gross", F.col("gross_benefit")), ("missed_fraud", -F.col("false_negative_loss")),
             ("false_alarms", -F.col("false_positive_cost")), ("net", F.col("net_value")))
    return impact_rows.select("convention", F.explode(F.array(*[
        F.struct(F.lit(n).alias("line"), c.alias("amount")) for n, c in lines])).alias("l")).select("convention", "l.*")


def convention_delta(sweep: DataFrame) -> DataFrame:
    """Best threshold under each convention and what choosing the other one changes."""
    point = F.struct("threshold", "recall", "annual_fp")
    best = sweep.groupBy("convention").agg(F.max_by(point, F.struct("net_value", -F.col("threshold"))).alias("r"))
    one = lambda c, f: F.max(F.when(F.col("convention") == c, F.col(f"r.{f}")))
    prd, net = CONVENTIONS
    return best.agg(
        one(prd, "threshold").alias("prd_threshold"), one(net, "threshold").alias("net_threshold"),
        (one(prd, "recall") - one(net, "recall")).alias("recall_delta"),
        (one(prd, "annual_fp") - one(net, "annual_fp")).alias("fp_delta"))


