"""Monotone calibration: pooled blocks merged in rounds on executors, and applied by range.

Pooling is associative: blocks of neighbouring ranges of scores, put next to each other and pooled again, are the blocks of all
their scores. So every range pools its own scores, and rounds join a few ranges each until one is left. With labels of 0 and 1 the
blocks have rising means that are fractions of whole numbers summing to n, of which there are O(n^(2/3)) at most, so the last task
stays small however many scores there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.curves import scored
from txnlens.operators.ordered import INF
from txnlens.session import cut_lineage

#: Ranges that one task of a round joins.
FAN = 8
#: Blocks that every task gets as a whole; more are joined by range.
SMALL_BLOCKS = 200_000
#: Ranges of that join.
BUCKETS = 4_096


class Pool:
    """Blocks ``(lo, hi, s, w)`` with strictly rising means, fed in ascending order."""

    def __init__(self):
        self.blocks: list[list[float]] = []

    def add(self, lo: float, hi: float, s: float, w: float) -> None:
        blocks = self.blocks
        blocks.append([lo, hi, s, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, s, w = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + s, blocks[-1][3] + w]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.blocks, columns=["lo", "hi", "s", "w"], dtype=float)


def fit_isotonic(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The calibrating blocks ``(lo, hi, value)``: scores from ``lo`` to ``hi`` have the same value. Missing scores take no part."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = scored(df, p).groupBy(F.col(p).cast("double").alias("lo")).agg(
        F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("w"))

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = Pool()
        for batch in batches:
            for lo, s, w in zip(*(batch[c].tolist() for c in ("lo", "s", "w"))):
                pool.add(lo, lo, s, w)
        yield pool.frame().assign(part=TaskContext.get().partitionId())

    def joined(key: tuple, ranges: pd.DataFrame) -> pd.DataFrame:
        pool = Pool()
        ordered = ranges.sort_values("lo")
        for row in zip(*(ordered[c].tolist() for c in ("lo", "hi", "s", "w"))):
            pool.add(*row)
        return pool.frame().assign(part=key[0])

    schema = "lo double, hi double, s double, w double, part long"
    blocks = distinct.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInPandas(pooled, schema)
    while parts > 1:
        blocks = blocks.groupBy(F.floor(F.col("part") / FAN).alias("part")).applyInPandas(joined, schema)
        parts = -(-parts // FAN)
    return cut_lineage(blocks.select("lo", "hi", (F.col("s") / F.col("w")).alias("value")))


def _segments(blocks: DataFrame) -> DataFrame:
    """``(x0, g0, x1, g1)``: from each knot to the next one; the last has no next."""
    knots = blocks.select(F.explode(F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))).alias("x0"), F.col("value").alias("g0"))
    # As many rows as there are blocks, which are few next to the scores.
    w = Window.orderBy("x0")
    return knots.withColumns({"x1": F.lead("x0").over(w), "g1": F.lead("g0").over(w)})


def apply_isotonic(df: DataFrame, blocks: DataFrame, p: str = "p", out: str = "calibrated") -> DataFrame:
    """Linear between the knots, constant beyond them, within [0, 1]; a missing score stays missing."""
    n = blocks.count()
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    if n == 0:
        return df.withColumn(out, F.lit(None).cast("double"))
    if n <= SMALL_BLOCKS:
        rows = blocks.toPandas().sort_values("lo")
        xs = rows[["lo", "hi"]].to_numpy().ravel()
        gs = np.repeat(rows["value"].to_numpy(), 2)

        @F.pandas_udf("double")
        def interpolated(score: pd.Series) -> pd.Series:
            x = score.to_numpy(float)
            # Equal neighbours of a block of one score don't hurt; NaN stays NaN, which is null again below.
            return pd.Series(np.interp(x, xs, gs))

        value = interpolated(F.col(p).cast("double"))
        return df.withColumn(out, F.when(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")), clip(value)))
    return _apply_by_range(df, _segments(blocks), p, out, clip)


def _apply_by_range(df: DataFrame, segments: DataFrame, p: str, out: str, clip) -> DataFrame:
    """Rows and segments meet in ranges of scores, in which every row takes the last segment that starts at or below it."""
    bounds = segments.approxQuantile("x0", [i / BUCKETS for i in range(1, BUCKETS)], 1 / (4 * BUCKETS))
    splits = [-INF, *sorted(set(bounds)), INF]

    def bucket(frame: DataFrame, column: str, name: str) -> DataFrame:
        return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(frame)

    last = segments.withColumn("_end", F.coalesce("x1", F.lit(INF)))
    placed = bucket(bucket(last, "x0", "_from"), "_end", "_to").withColumn("_to", F.least("_to", F.lit(len(splits) - 2.0)))
    placed = placed.withColumn("_bucket", F.explode(F.sequence(F.col("_from").cast("int"), F.col("_to").cast("int"))))
    ahead = F.struct("x0", "g0", "x1", "g1").alias("_seg")
    asked = bucket(df.withColumn("_x", F.col(p).cast("double")), "_x", "_bucket").withColumn("_bucket", F.col("_bucket").cast("int"))
    rows = asked.select(F.struct(*df.columns).alias("_row"), "_x", "_bucket")
    both = rows.unionByName(placed.select(F.col("x0").alias("_x"), "_bucket", ahead), allowMissingColumns=True)
    w = Window.partitionBy("_bucket").orderBy("_x", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # Below the first knot there is no segment; its value is the least one.
    low = segments.agg(F.min("g0").alias("g")).select("g").scalar()
    found = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    s = lambda c: F.col(f"_seg.{c}")
    value = F.when(F.col("_seg").isNull(), low).when(s("x1").isNull(), s("g0")).otherwise(
        s("g0") + (s("g1") - s("g0")) * (F.col("_x") - s("x0")) / (s("x1") - s("x0")))
    known = F.col("_x").isNotNull() & ~F.isnan("_x")
    return found.withColumn("_value", F.when(known, clip(value))).select("_row.*", F.col("_value").alias(out))
