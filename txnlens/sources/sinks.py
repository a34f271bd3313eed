"""Sinks, saved state and cached edges."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.operators.validate import fingerprint


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split; the label stays a column."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_prediction_log(df: DataFrame, path: str, features: Sequence[str]) -> None:
    """Append decision fields, time and a feature map as JSON lines; null features leave no key."""
    pairs = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in features]),
        lambda x: x["v"].isNotNull()))
    df.select("transaction_id", "decision", "score", "logged_at", pairs.alias("features")).write.mode("append").json(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path),
     "parquet": lambda: writer.parquet(path)}[fmt]()


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def read_alert(spark: SparkSession, path: str) -> DataFrame:
    """Written alerts that are active."""
    return spark.read.json(path).where("drift_detected = 1")


def save_state(state: dict[str, DataFrame], path: str) -> None:
    """One table per fitted state below ``path``."""
    for name, df in state.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def load_state(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(os.path.join(path, name)) for name in names}


def load_or_build_edges(spark: SparkSession, path: str, source: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """Cached edges while the source's fingerprint matches the stored one, else build and store."""
    now = fingerprint(source).first()
    data, meta = os.path.join(path, f"edges-{now['digest']}-{now['rows']}"), os.path.join(path, "fingerprint")
    try:
        known = spark.read.parquet(meta).where(
            (F.col("digest") == now["digest"]) & (F.col("rows") == now["rows"])).isEmpty() is False
    except Exception as missing:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = False
    if not known:
        build().write.mode("overwrite").parquet(data)
        spark.createDataFrame([(now["rows"], now["digest"])], "rows long, digest string").write.mode("overwrite").parquet(meta)
    return spark.read.parquet(data)


def to_keyed_messages(df: DataFrame, entity: str) -> DataFrame:
    """Key = entity, value = JSON of the row without its nulls."""
    return df.select(F.col(entity).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def alert_messages(scored: DataFrame, entity: str, scores: Sequence[str]) -> DataFrame:
    """Frauds only, keyed by entity, single-model scores removed."""
    return to_keyed_messages(scored.where(F.col("decision") == "FRAUD").drop(*scores), entity)
