"""Compositions over score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.operators.business import Costs, optimal_threshold
from txnlens.operators.curves import pr_counts, ratio, with_totals
from txnlens.operators.ensemble import Weights, blend
from txnlens.operators.ordered import Chunks

PRECISION_BAND, RECALL_BAND = 0.30, 0.80
RECALL_FLOORS = (0.7, 0.8, 0.9)


def score_export(df: DataFrame, weights: Weights) -> DataFrame:
    """Blended held-out scores with frozen weights."""
    return df.where(F.col("split") != "train").withColumn("blended", blend(weights))


def eval_battery(val: DataFrame, test: DataFrame, deployed: float, costs: Costs = Costs(), chunks: Chunks = None) -> DataFrame:
    """One row of everything reported about a score: areas, precision at recall floors, confusion and value at the
    deployed threshold and at the one re-derived on validation, and the target-band verdict.

    All test figures come from a single pass over the distinct-score curve.
    """
    rederived = optimal_threshold(val, costs).select("threshold").scalar()
    c = with_totals(pr_counts(test, chunks=chunks)).withColumn("_rt", rederived)
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    hit = lambda limit, col: F.sum(F.when(F.col("threshold") >= limit, F.col(col)).otherwise(0))
    recall, precision = ratio(F.col("tp"), F.col("n_pos")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    out = c.agg(
        (n_pos + n_neg).alias("n"), n_pos.alias("n_pos"), n_neg.alias("n_neg"),
        F.when((n_pos > 0) & (n_neg > 0), F.sum(F.col("pos") * precision) / n_pos).alias("ap"),
        F.when((n_pos > 0) & (n_neg > 0), 1 - F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)) / (n_pos * n_neg)).alias("auc"),
        F.lit(float(deployed)).alias("deployed_threshold"), F.max("_rt").alias("rederived_threshold"),
        hit(F.lit(float(deployed)), "pos").alias("tp"), hit(F.lit(float(deployed)), "neg").alias("fp"),
        hit(F.col("_rt"), "pos").alias("rederived_tp"), hit(F.col("_rt"), "neg").alias("rederived_fp"),
        *[F.max_by(F.when(recall >= f, precision), F.when(recall >= f, F.col("threshold"))).alias(f"precision_at_{round(f * 100)}")
          for f in RECALL_FLOORS])
    fn = F.col("n_pos") - F.col("tp")
    gained = F.col("tp") * costs.tp - F.col("fp") * costs.fp
    out = out.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("n_pos")),
        "value_prd": gained - fn * costs.fn, "value_net": gained})
    return out.withColumns({
        "in_band": ((F.col("precision") >= PRECISION_BAND) & (F.col("recall") >= RECALL_BAND)).cast("int"),
        "precision_gap": F.greatest(F.lit(PRECISION_BAND) - F.col("precision"), F.lit(0.0)),
        "recall_gap": F.greatest(F.lit(RECALL_BAND) - F.col("recall"), F.lit(0.0))})


