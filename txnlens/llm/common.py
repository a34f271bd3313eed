"""What the operators of this folder share: clean input columns, tables in the shared folder, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.session import scratch_path, scratch_scope

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def clean_docs(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, a null text as the empty one; further columns can't clash with those of an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes the shuffle files of finished steps only after that."""
    gc.collect()
    spark._jvm.System.gc()


def kept_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written to the shared folder and read back, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept_alone(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``build`` returns, written and read back; the tables that ``build`` made on the way are deleted."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of the undirected ``edges(a, b)``: the least node reachable from it.

    Alternates two star steps until nothing changes. In the first, all larger neighbours of a node move to its least
    neighbour; in the second, a node and its smaller neighbours do. The rounds needed grow with the logarithm of the longest
    path. Each round is a table in the shared folder, so a lost executor costs one round at most. Nodes without edges are
    not returned; loops and nulls are ignored.
    """
    spark = edges.sparkSession
    now, path = kept_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        done, next_path = kept_table(small.select("e.*").where("a <> b").distinct(), "edges")
        state = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(spark, path)
        now, path = done, next_path
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
