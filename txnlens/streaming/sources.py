"""Streaming sources, parsing and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.roles import Roles
from txnlens.session import scratch_path


def stream_transactions(spark: SparkSession, fmt: str, path: str | None = None, schema: T.StructType | None = None,
                        **options: str) -> DataFrame:
    """Kafka, parquet or JSON source. Bound each trigger with maxFilesPerTrigger or maxOffsetsPerTrigger."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.option("startingOffsets", options.get("startingOffsets", "earliest")).load()
    return reader.schema(schema).load(path)


def parse_messages(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON values to columns, the raw text kept, ``bad`` = 1 for messages that do not parse."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(F.col("value").cast("string"), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return messages.select(F.col("value").cast("string").alias("raw"), parsed.alias("r")).select(
        "raw", *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields],
        (F.col("r").isNull() | F.col("r._corrupt").isNotNull()).cast("int").alias("bad"))


def dead_letters(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where("bad = 0").drop("bad", "raw"), parsed.where("bad = 1").select("raw")


def dedupe_stream(stream: DataFrame, time: str, roles: Roles = Roles(), delay: str = "2 days") -> DataFrame:
    """Drop repeated ids; the memory is bounded by event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([roles.id])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer, spark: SparkSession, offsets: str, state_partitions: int | None = None, store: str | None = None) -> list:
    """Run what is available and return the progress of its batches. State partitions follow the cluster's cores unless given."""
    wanted = {"spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism)}
    if store:
        wanted["spark.sql.streaming.stateStore.providerClass"] = store
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = writer.option("checkpointLocation", offsets).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_append_to(stream: DataFrame, out: str, offsets: str, **options) -> list:
    """Append what is available to a parquet folder; the same offsets folder continues an earlier run."""
    return _start(stream.writeStream.format("parquet").option("path", out), stream.sparkSession, offsets, **options)


def run_append(stream: DataFrame, name: str, **options) -> DataFrame:
    """Drain an append stream into a new parquet folder and read it back."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    run_append_to(stream, out, scratch_path(spark, f"{name}-offsets"), **options)
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, handle, name: str, **options) -> None:
    """Give every micro-batch to ``handle(batch, batch_id)``, which must be safe to repeat."""
    spark = stream.sparkSession
    _start(stream.writeStream.foreachBatch(handle), spark, scratch_path(spark, f"{name}-offsets"), **options)


def run_updates(stream: DataFrame, key: str, name: str, **options) -> DataFrame:
    """The latest row of each ``key`` of a watermarked aggregation.

    Only changed rows are written, a folder a batch, so a retry is harmless; the watermark drops the state of keys that can't
    change any more. Rows behind the watermark are not counted.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))

    writer = stream.writeStream.outputMode("update").foreachBatch(keep)
    _start(writer, spark, scratch_path(spark, f"{name}-offsets"), **options)
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", out).parquet(out)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_row"))
    return last.select("_row.*")
