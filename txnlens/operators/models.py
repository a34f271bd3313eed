"""Training and scoring: boosted trees of our own, the linear model of Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators import boosting
from txnlens.operators.curves import average_precision
from txnlens.session import cut_lineage


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def train_gbt(df: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None,
              validation: str | None = None, **options) -> boosting.Boosted:
    """Gradient-boosted trees, 100 of depth 6 by default, stopped early on the average precision of rows marked by ``validation``."""
    return boosting.train(df, features, label, weight, validation, **options)


def train_linear(df: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None, **options):
    lr = LogisticRegression(labelCol=label, featuresCol="features", **{"maxIter": 20, "regParam": 0.01, **options})
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(_assembled(df, features))


def score(model, df: DataFrame, features: Sequence[str], out: str = "p_raw") -> DataFrame:
    """Positive-class probability, kept apart from calibrated values."""
    if isinstance(model, boosting.Boosted):
        return df.withColumn(out, model.probability())
    scored = model.transform(_assembled(df, features))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(spark, model, features: Sequence[str]) -> DataFrame:
    rows = list(model.importances().items())
    return spark.createDataFrame(rows, "feature string, importance double")


def search_params(train: DataFrame, val: DataFrame, features: Sequence[str], grid: dict[str, Sequence], label: str = "y") -> DataFrame:
    """Every parameter combination fitted on train, stopped and ranked by validation AP; the split is by time, not folds."""
    out = None
    columns = [label, *features]
    both = cut_lineage(train.select(*columns, F.lit(False).alias("_held")).unionByName(val.select(*columns, F.lit(True).alias("_held"))))
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        scored = score(train_gbt(both, features, label, validation="_held", **params), val, features)
        name = ",".join(f"{k}={v}" for k, v in params.items())
        one = average_precision(scored, label, "p_raw").select(F.lit(name).alias("params"), "ap")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ap"), "params")))
