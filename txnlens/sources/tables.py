"""Batch sources. Schemas are explicit, NaN becomes null, column lists reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions import fixed

REQUIRED = ("TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "card1", "ProductCD")


def transaction_schema(v: int = 339, c: int = 14, d: int = 15, m: int = 9) -> T.StructType:
    """The wide transaction table: keys, category strings, count, delta and match families, float block."""
    fields = [("TransactionID", T.LongType()), ("isFraud", T.IntegerType()), ("TransactionDT", T.LongType()),
              ("TransactionAmt", T.DoubleType()), ("ProductCD", T.StringType()), ("card1", T.LongType()),
              ("card2", T.DoubleType()), ("card3", T.DoubleType()), ("card4", T.StringType()), ("card5", T.DoubleType()),
              ("card6", T.StringType()), ("addr1", T.DoubleType()), ("addr2", T.DoubleType()), ("dist1", T.DoubleType()),
              ("dist2", T.DoubleType()), ("P_emaildomain", T.StringType()), ("R_emaildomain", T.StringType())]
    fields += [(f"C{i}", T.DoubleType()) for i in range(1, c + 1)]
    fields += [(f"D{i}", T.DoubleType()) for i in range(1, d + 1)]
    fields += [(f"M{i}", T.StringType()) for i in range(1, m + 1)]
    fields += [(f"V{i}", T.FloatType()) for i in range(1, v + 1)]
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value to aggregates; missing cells must be null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_transactions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Typed CSV read of the transaction table."""
    return nan_to_null(spark.read.schema(schema or transaction_schema()).csv(path, header=True))


def read_identity(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).csv(path, header=True))


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return nan_to_null(df.select(*columns) if columns else df)


_LOG = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("decision", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("logged_at", T.LongType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())), T.StructField("_corrupt", T.StringType()),
])


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """All log lines parsed; ``malformed`` marks lines that are not whole records."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", _LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("r")).select(
        "r.transaction_id", "r.decision", "r.score", "r.logged_at", "r.features",
        F.col("r._corrupt").isNotNull().cast("int").alias("malformed"))


def prediction_window(log: DataFrame, reference: T.StructType, limit: int = fixed.DRIFT_WINDOW_ROWS) -> DataFrame:
    """The newest ``limit`` well-formed records with features, as columns of the reference schema."""
    usable = log.where((F.col("malformed") == 0) & (F.size("features") > 0))
    newest = usable.orderBy(F.desc("logged_at"), F.desc("transaction_id")).limit(limit)
    return newest.select(*[F.col("features").getItem(f.name).alias(f.name) for f in reference.fields])
