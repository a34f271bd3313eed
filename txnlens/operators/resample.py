"""Class balance: weights, replication and synthetic minority rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions.rowwise import unit_hash
from txnlens.operators.neighbours import nearest_neighbours
from txnlens.operators.ordered import global_rank
from txnlens.session import cut_lineage


def class_weights(df: DataFrame, label: str = "y", override: float | None = None) -> DataFrame:
    """One row: class counts, positive weight and the balanced weight of each class."""
    counts = df.agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n_neg"),
    )
    n = F.col("n_pos") + F.col("n_neg")
    guarded = counts.withColumn(
        "n_pos", F.when(F.col("n_pos") > 0, F.col("n_pos")).otherwise(F.raise_error(F.lit("no positive rows")).cast("long"))
    )
    ratio = F.lit(float(override)) if override and override > 0 else F.col("n_neg") / F.col("n_pos")
    return guarded.select(
        "n_pos", "n_neg", ratio.alias("scale_pos_weight"),
        (n / (2 * F.col("n_neg"))).alias("weight_0"), (n / (2 * F.col("n_pos"))).alias("weight_1"),
    )


def sampling_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Each row with the weight 1 / rows of its class."""
    w = class_weights(df, label)
    pos, neg = w.select("n_pos").scalar(), w.select("n_neg").scalar()
    return df.withColumn("sample_weight", F.when(F.col(label) == 1, 1 / pos).otherwise(1 / neg))


def balance_by_weight(df: DataFrame, key: str, label: str = "y", seed: int = 42) -> DataFrame:
    """Replicate minority rows so that both classes have about the same expected size.

    A row is repeated ``majority / minority`` times: the whole part always, the rest by a hash draw.
    """
    w = class_weights(df, label)
    pos, neg = w.select("n_pos").scalar(), w.select("n_neg").scalar()
    factor = F.when(F.col(label) == 1, F.greatest(neg / pos, F.lit(1.0))).otherwise(F.greatest(pos / neg, F.lit(1.0)))
    copies = F.floor(factor) + (unit_hash(key, F.lit(seed)) < factor - F.floor(factor)).cast("int")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))


def smote(df: DataFrame, key: str, vector: str, label: str = "y", k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows on segments to one of the k nearest minority rows, as many as balance the classes.

    Returns ``(base, neighbour, copy, share, vector)``.
    """
    minority = cut_lineage(df.where(F.col(label) == 1).select(F.col(key).alias("_id"), F.col(vector).alias("_x")))
    counts = df.agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    need = counts.select(F.col("n") - 2 * F.col("pos")).scalar()
    m = counts.select("pos").scalar()
    neighbours = cut_lineage(nearest_neighbours(minority, "_id", "_x", k))
    # Every minority row makes floor(need / m) copies; the first need % m rows in hash order make one more.
    placed = global_rank(minority.withColumn("_u", unit_hash("_id", F.lit(seed))), ["_u", "_id"], "_place")
    extra = (F.col("_place") < need % m).cast("int")
    draws = (
        placed.withColumn("_copies", (F.floor(need / m) + extra).cast("int")).where("_copies > 0")
        .select("_id", "_x", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    )
    sizes = neighbours.groupBy("_id").agg(F.max("rank").alias("_k"))
    picks = draws.join(sizes, "_id").select(
        "_id", "_x", "copy",
        (F.floor(unit_hash("_id", "copy", F.lit(seed)) * F.col("_k")) + 1).cast("int").alias("rank"),
        unit_hash("copy", "_id", F.lit(seed + 1)).alias("share"),
    )
    towards = minority.select(F.col("_id").alias("neighbour"), F.col("_x").alias("_nx"))
    made = picks.join(neighbours, ["_id", "rank"]).join(towards, "neighbour")
    step = F.zip_with("_x", "_nx", lambda a, b: (a + (b - a) * F.col("share")).cast("float"))
    return made.select(F.col("_id").alias("base"), "neighbour", "copy", "share", step.alias(vector))


def resolve_imbalance(sampling: str, loss: str, n_pos: int, n_neg: int) -> tuple[bool, float]:
    """Whether rows are resampled, and the positive-class loss weight; never both at once."""
    if sampling not in {"none", "oversample", "smote"}:
        raise ValueError(f"unknown sampling strategy {sampling}")
    if loss not in {"bce", "weighted_bce", "focal_loss"}:
        raise ValueError(f"unknown loss {loss}")
    if sampling == "smote":
        raise NotImplementedError("interpolated rows have no meaning for sequences")
    resampled = sampling == "oversample"
    weighted = loss == "weighted_bce" and not resampled
    return resampled, n_neg / max(n_pos, 1) if weighted else 1.0


def ablation(df: DataFrame, arms: dict[str, float | None], fit_and_score, score: str = "ap") -> DataFrame:
    """Fit one model per positive-class weight and rank the arms. ``fit_and_score(df, weight)`` gives one row."""
    rows = None
    for name, weight in arms.items():
        one = fit_and_score(df, weight).select(F.lit(name).alias("arm"), F.col(score))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), "arm")))


def weight_column(df: DataFrame, weight: float | None, label: str = "y", out: str = "w") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(weight or 1.0))).otherwise(1.0))

