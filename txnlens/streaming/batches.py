"""The per-entity features of a stream computed with the batch operators, for streams with hot entities.

A keyed state function sees all new rows of one key in one task. Here every micro-batch is a DataFrame: hot
entities are cut as in batch, and state is two tables (entity totals, rows of the last day in long form).

State lies in buckets of entities, and each version of a bucket is a folder of its own. A batch reads and writes only
the buckets that its rows fall into; an index of one row a bucket says which batch wrote the current version of each.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions import fixed
from txnlens.operators.profiles import entity_recent, entity_state, merged_state
from txnlens.operators.windows import velocity_features, with_carried
from txnlens.roles import DAY_S, MICROS, Roles
from txnlens.session import delete_path

BUCKETS = 64


class FeatureBatches:
    """Use as ``foreachBatch(FeatureBatches(out, state))``.

    Batch b reads the versions that the index of batch b - 1 names, and writes its rows, its versions and its index to
    folders of its own, so a batch that is repeated after a failure gives the same result. Versions that neither of the
    two last indexes names are deleted. ``buckets`` must stay the same for the life of a state folder; the missing entity
    has a bucket like any other.
    """

    def __init__(self, out: str, state: str, roles: Roles = Roles(), max_backdate_s: int = fixed.MAX_BACKDATE_S,
                 buckets: int = BUCKETS):
        self.out, self.state, self.roles = out, state, roles
        self.max_backdate_s, self.buckets = max_backdate_s, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.roles.entity), F.lit(self.buckets)).cast("int")

    def _version(self, batch_id: int, name: str) -> str:
        return os.path.join(self.state, name, f"version={batch_id}")

    def _index_path(self, batch_id: int) -> str:
        return os.path.join(self.state, "index", str(batch_id))

    def index(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """The batch that wrote the current version of each bucket, after ``batch_id``; at most ``buckets`` entries."""
        if batch_id < 0:
            return {}
        rows = spark.read.schema("bucket int, version long").parquet(self._index_path(batch_id)).collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, spark: SparkSession, name: str, index: dict[int, int], schema: T.StructType) -> DataFrame:
        if not index:
            return spark.createDataFrame([], schema)
        versions = {v: [b for b, w in index.items() if w == v] for v in set(index.values())}
        parts = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
        paths = [self._version(v, name) for v in sorted(versions)]
        rows = spark.read.schema(parts).option("basePath", os.path.join(self.state, name)).parquet(*paths)
        current = reduce(Column.__or__, [(F.col("version") == v) & F.col("bucket").isin(bs) for v, bs in sorted(versions.items())])
        return rows.where(current).drop("version", "bucket")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        # Rebalanced by bucket, so that a hot bucket is several files.
        df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            self._version(batch_id, name))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        r, spark = self.roles, batch.sparkSession
        rows = batch.select(r.id, r.entity, r.ts, F.col(r.amount).cast("double").alias(r.amount))
        before = self.index(spark, batch_id - 1)
        touched = {x["b"] for x in rows.select(self._bucket().alias("b")).distinct().collect()}
        known = {b: v for b, v in before.items() if b in touched}
        carried = self._read(spark, "entity", known, entity_state(rows, r).schema)
        recent = self._read(spark, "recent", known, rows.select(r.entity, r.ts, r.id, r.amount).schema)
        rows = with_carried(rows, carried.select(r.entity, "last_ts"), r.entity)
        stale = F.col("c_last_ts") - F.col(r.ts) > self.max_backdate_s * MICROS
        rows = rows.withColumn("stale", F.coalesce(stale, F.lit(False)).cast("int")).drop("c_last_ts")
        kept, refused = rows.where("stale = 0"), rows.where("stale = 1")
        features = velocity_features(kept, r, carried, recent) if known else velocity_features(kept, r)
        features.unionByName(refused, allowMissingColumns=True).write.mode("overwrite").parquet(
            os.path.join(self.out, f"batch={batch_id}"))
        day = kept.select(r.entity, r.ts, r.id, r.amount)
        self._write(merged_state([carried, entity_state(kept, r)], r), "entity", batch_id)
        self._write(entity_recent(day.unionByName(recent), DAY_S, r), "recent", batch_id)
        after = before | {b: batch_id for b in touched}
        spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            self._index_path(batch_id))
        self._expire(spark, batch_id, before)

    def _expire(self, spark: SparkSession, batch_id: int, before: dict[int, int]) -> None:
        """Delete what the batch before this one replaced; this batch may still be repeated and reads ``before``."""
        old = spark._jvm.org.apache.hadoop.fs.Path(self._index_path(batch_id - 2))
        if not old.getFileSystem(spark._jsc.hadoopConfiguration()).exists(old):
            return
        for bucket, version in self.index(spark, batch_id - 2).items():
            if before[bucket] != version:
                for name in ("entity", "recent"):
                    delete_path(spark, os.path.join(self._version(version, name), f"bucket={bucket}"))
        delete_path(spark, self._index_path(batch_id - 2))
