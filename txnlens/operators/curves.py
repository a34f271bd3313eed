"""Score curves, thresholds and the metrics derived from them.

Scores are first grouped by distinct value, so the ordered part runs over counts; the running counts come
from ``prior`` and stay bounded per task for any number of distinct scores or any hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions.rowwise import log_grid_values
from txnlens.operators.ordered import INF, Chunks, by_heat, prior


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def scored(df: DataFrame, p: str) -> DataFrame:
    """Rows that have a score; null and NaN rank nowhere, so no count or curve takes them in."""
    return df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))


def pr_counts(
    df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), weight: Column | None = None,
    chunks: Chunks = None,
) -> DataFrame:
    """Per distinct score, descending: own positives and negatives and cumulative ``tp`` and ``fp``."""
    w = F.lit(1).cast("long") if weight is None else weight

    def run(rows: DataFrame, plan: Chunks) -> DataFrame:
        counts = rows.groupBy(*by, "_desc").agg(
            F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg"),
        )
        out = prior(counts, by, ["_desc"], {"_tp": ("sum", F.col("pos")), "_fp": ("sum", F.col("neg"))}, plan)
        return out.select(
            *by, (-F.col("_desc")).alias("threshold"), "pos", "neg",
            (F.coalesce("_tp", F.lit(0)) + F.col("pos")).alias("tp"),
            (F.coalesce("_fp", F.lit(0)) + F.col("neg")).alias("fp"),
        )

    # Sizes and boundaries come from the rows, so the grouped counts are computed once.
    return by_heat(scored(df, p).withColumn("_desc", -F.col(p)), by, ["_desc"], run, chunks)


def _totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def with_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    totals = _totals(counts, by)
    if by:
        return counts.join(totals, list(by))
    return counts.withColumns({c: totals.select(c).scalar() for c in ("n_pos", "n_neg")})


def pr_curve(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), chunks: Chunks = None) -> DataFrame:
    """Precision and recall at every distinct score."""
    c = with_totals(pr_counts(df, y, p, by, chunks=chunks), by)
    return c.select(
        *by, "threshold", "tp", "fp",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
    )


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), chunks: Chunks = None) -> DataFrame:
    c = with_totals(pr_counts(df, y, p, by, chunks=chunks), by)
    return c.select(
        *by, "threshold", ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))


def _ap(pos: Column, tp: Column, fp: Column) -> Column:
    total = F.sum(pos)
    return F.when(total > 0, F.sum(pos * ratio(tp, tp + fp)) / total)


def area_metrics(
    df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), weight: Column | None = None,
    chunks: Chunks = None,
) -> DataFrame:
    """``ap`` (step sum), ``auc`` (ties half), rows and positives per group; null where a class is missing."""
    c = pr_counts(df, y, p, by, weight, chunks)
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    above = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2))
    return c.groupBy(*by).agg(
        (n_pos + n_neg).alias("n"),
        n_pos.alias("n_pos"),
        F.when(n_neg > 0, _ap(F.col("pos"), F.col("tp"), F.col("fp"))).alias("ap"),
        F.when((n_pos > 0) & (n_neg > 0), 1 - above / (n_pos * n_neg)).alias("auc"),
    )


def average_precision(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), weight: Column | None = None,
                      chunks: Chunks = None) -> DataFrame:
    c = pr_counts(df, y, p, by, weight, chunks)
    return c.groupBy(*by).agg(_ap(F.col("pos"), F.col("tp"), F.col("fp")).alias("ap"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), chunks: Chunks = None) -> DataFrame:
    return area_metrics(df, y, p, by, chunks=chunks).select(*by, "auc")


def confusion_counts(df: DataFrame, threshold: Column | float, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    hit = F.col(p) >= threshold
    cell = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return scored(df, p).groupBy(*by).agg(
        cell(hit & (F.col(y) == 1)).alias("tp"), cell(~hit & (F.col(y) == 0)).alias("tn"),
        cell(hit & (F.col(y) == 0)).alias("fp"), cell(~hit & (F.col(y) == 1)).alias("fn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from a confusion table, 0 on empty denominators."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumns({
        "f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
    })


def confusion(df: DataFrame, threshold: Column | float, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return rates(confusion_counts(df, threshold, y, p, by))


def class_report(df: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted means."""
    c = confusion_counts(df, threshold, y, p)
    per_class = c.select(F.explode(F.array(
        F.struct(F.lit("1").alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("false"), F.col("fn").alias("missed")),
        F.struct(F.lit("0").alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("false"), F.col("fp").alias("missed")),
    )).alias("c")).select("c.*")
    hit, false, missed = F.col("hit"), F.col("false"), F.col("missed")
    scored = per_class.select(
        "class", ratio(hit, hit + false).alias("precision"), ratio(hit, hit + missed).alias("recall"),
        (hit + missed).alias("support"))
    scored = scored.withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support"))
    weighted = scored.agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in names], F.sum("support").alias("support"))
    return (
        scored.unionByName(macro.withColumn("class", F.lit("macro")))
        .unionByName(weighted.withColumn("class", F.lit("weighted")))
    )


def confusion_matrix(df: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """Row-normalised 2x2 matrix in long form."""
    counts = df.groupBy(F.col(y).alias("actual"), (F.col(p) >= threshold).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def brier(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    d = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(F.avg(d * d).alias("brier"))


def reliability_bins(df: DataFrame, n: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Mean score and positive rate in uniform bins with closed right edges; empty bins do not appear."""
    b = F.greatest(F.ceil(F.col(p) * n) - 1, F.lit(0)).cast("int")
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score"), F.avg(y).alias("positive_rate"))


def sweep_counts(
    df: DataFrame, grid: Sequence[float] | None = None, y: str = "y", p: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts at every grid threshold from one aggregation of the scores.

    A score falls into the interval of the last threshold it reaches; counts are then accumulated
    over the grid, whose length bounds the ordered part.
    """
    grid = sorted(grid or log_grid_values())
    splits = [-INF, *grid, INF]
    binned = Bucketizer(splits=splits, inputCol="_p", outputCol="_g", handleInvalid="keep").transform(
        scored(df, p).withColumn("_p", F.col(p).cast("double")))
    flag = lambda v: F.sum(F.when(F.col(y) == v, 1).otherwise(0))
    filled = binned.groupBy(*by, F.col("_g").cast("int").alias("_g")).agg(flag(1).alias("pos"), flag(0).alias("neg"))
    groups = filled.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    empty = groups.select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("_g"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    full = filled.unionByName(empty).groupBy(*by, "_g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.partitionBy(*by).orderBy(F.desc("_g")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    run = full.select(
        *by, "_g", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"))
    values = F.array(*[F.lit(float(g)) for g in grid])
    return run.where(F.col("_g") >= 1).select(
        *by, F.element_at(values, F.col("_g")).alias("threshold"), "tp", "fp",
        (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))


def threshold_sweep(
    df: DataFrame, grid: Sequence[float] | None = None, y: str = "y", p: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    return rates(sweep_counts(df, grid, y, p, by))


def best_threshold(sweep: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of the largest value, the lowest one on ties. A sweep is bounded by its grid."""
    return sweep.withColumn("value", value).groupBy(*by).agg(
        F.max_by("threshold", F.struct("value", -F.col("threshold"))).alias("threshold"), F.max("value").alias("value"))


def f1_threshold(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), chunks: Chunks = None) -> DataFrame:
    """The score with the best F1, the lowest on ties; 0.5 when no score has a positive F1."""
    c = pr_curve(df, y, p, by, chunks)
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    best = best_threshold(c, f1, by)
    return best.select(*by, F.when(F.col("value") > 0, F.col("threshold")).otherwise(0.5).alias("threshold"),
                       F.col("value").alias("f1"))


def threshold_at_fpr(df: DataFrame, limit: float = 0.05, y: str = "y", p: str = "p", by: Sequence[str] = (),
                     chunks: Chunks = None) -> DataFrame:
    """The lowest score whose false-positive rate stays within the limit, with its rates."""
    c = roc_curve(df, y, p, by, chunks).where(F.col("fpr") <= limit)
    point = F.struct("threshold", "fpr", "tpr")
    return c.groupBy(*by).agg(F.min_by(point, "threshold").alias("r")).select(*by, "r.*")


def precision_at_recall(df: DataFrame, floors: Sequence[float], y: str = "y", p: str = "p", by: Sequence[str] = (),
                        chunks: Chunks = None) -> DataFrame:
    """Per recall floor, the operating point with the largest threshold that still reaches it."""
    if any(not 0.0 <= f <= 1.0 for f in floors):
        raise ValueError("recall floors must lie in [0, 1]")
    c = pr_curve(df, y, p, by, chunks)
    # Each floor is an aggregate of its own, so no point is copied.
    point = F.struct("threshold", "precision", "recall")
    picked = c.groupBy(*by).agg(*[
        F.max_by(F.when(F.col("recall") >= f, point), F.when(F.col("recall") >= f, F.col("threshold"))).alias(f"r{i}")
        for i, f in enumerate(floors)])
    long = picked.select(*by, F.explode(F.array(*[
        F.struct(F.lit(float(f)).alias("floor"), F.col(f"r{i}").alias("r")) for i, f in enumerate(floors)])).alias("x"))
    out = long.select(*by, "x.floor", "x.r.threshold", "x.r.precision", F.col("x.r.recall").alias("achieved_recall"))
    return out.withColumn("f1", ratio(
        2 * F.col("precision") * F.col("achieved_recall"), F.col("precision") + F.col("achieved_recall")))


def overfit_gap(df: DataFrame, split: str = "split", y: str = "y", p: str = "p", warn: float = 0.10, fail: float = 0.15,
                chunks: Chunks = None) -> DataFrame:
    """Average precision on train against the other splits, with the two alarm levels."""
    ap = average_precision(df, y, p, [split], chunks=chunks)
    one = lambda s: F.max(F.when(F.col(split) == s, F.col("ap")))
    wide = ap.agg(one("train").alias("train_ap"), one("val").alias("val_ap"), one("test").alias("test_ap"))
    gap = F.col("train_ap") - F.col("val_ap")
    return wide.withColumns({
        "val_gap": gap, "test_gap": F.col("train_ap") - F.col("test_ap"),
        "warn": (gap > warn).cast("int"), "fail": (gap > fail).cast("int")})


def slice_metrics(df: DataFrame, dims: Sequence[str], threshold: float, y: str = "y", p: str = "p", min_size: int = 30,
                  chunks: Chunks = None) -> DataFrame:
    """Metrics of every slice of every dimension at one frozen threshold."""
    long = df.select(F.col(y).alias("y"), F.col(p).alias("p"), F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dims])).alias("s"),
    ).select("y", "p", "s.*")
    by = ["dimension", "slice"]
    # One curve gives both the areas and the confusion counts at the threshold.
    c = pr_counts(long, "y", "p", by, chunks=chunks)
    hit = F.col("threshold") >= threshold
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    out = c.groupBy(*by).agg(
        (n_pos + n_neg).alias("n"), (n_pos / (n_pos + n_neg)).alias("fraud_rate"),
        F.when((n_pos > 0) & (n_neg > 0), _ap(F.col("pos"), F.col("tp"), F.col("fp"))).alias("ap"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"))
    return rates(out).withColumn("reliable", (F.col("n") >= min_size).cast("int"))


def unpivot_scores(df: DataFrame, keep: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """One row per (row, model)."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("p")) for s in scores])).alias("_s")).select(*keep, "_s.*")


def compare_models(df: DataFrame, scores: Sequence[str], y: str = "y", chunks: Chunks = None) -> DataFrame:
    """AP, AUC, best-F1 threshold and the metrics there, one row per model, best by AP marked."""
    long = unpivot_scores(df, [y], scores)
    c = with_totals(pr_counts(long, y, "p", ["model"], chunks=chunks), ["model"])
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("n_pos"))
    c = c.withColumn("f1", ratio(2 * precision * recall, precision + recall))
    point = F.struct("threshold", "tp", "fp", (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    out = c.groupBy("model").agg(
        _ap(F.col("pos"), F.col("tp"), F.col("fp")).alias("ap"),
        (1 - F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)) / (n_pos * n_neg)).alias("auc"),
        F.max_by(point, F.struct("f1", -F.col("threshold"))).alias("r"),
    ).select("model", "ap", "auc", "r.*")
    best = F.row_number().over(Window.orderBy(F.desc("ap"), "model"))
    return rates(out).withColumn("is_best", (best == 1).cast("int"))
