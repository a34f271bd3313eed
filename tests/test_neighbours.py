from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators import neighbours


def _brute(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i, own in enumerate(ids):
        order = sorted((d[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out[own] = [n for _, n in order[:k]]
    return out


def _found(df, k, block):
    got = {}
    for r in neighbours.nearest_neighbours(df, "id", "v", k, block).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    assert all([v[0] for v in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in got.values())
    return {i: [v[1] for v in sorted(rows)] for i, rows in got.items()}


def _frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, v array<double>")


@pytest.mark.parametrize("block", [1_000, 12])
def test_tree_equals_brute_force_on_clusters_copies_and_ties(spark, block):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, size=(60, 3)) for c in (0, 5, 40)] + [np.repeat(rng.normal(size=(1, 3)), 60, 0)]
                       + [np.array([[i % 8, i // 8, 0] for i in range(64)], float)])
    ids = rng.permutation(len(x)) + 100
    want = _brute(x, ids.tolist(), 5)
    assert _found(_frame(spark, x, ids), 5, block) == want


def test_blocks_are_bounded_when_one_point_is_far_from_all(spark):
    """A pivot far away splits off nothing; the next split is by id, so every block ends below its size."""
    x = np.concatenate([np.linspace(0, 1e-9, 400)[:, None], [[1e9]]])
    df = _frame(spark, x, range(len(x))).select(F.col("id").alias("_id"), F.col("v").alias("_x"))
    sizes = [r["count"] for r in neighbours.blocks(df, 20).groupBy("_node").count().collect()]
    assert sum(sizes) == 401 and max(sizes) <= 20


def test_clusters_are_not_compared_with_each_other(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.05, size=(100, 64)) + 50 * rng.normal(size=64) for _ in range(12)])
    df = _frame(spark, x, range(len(x))).select(F.col("id").alias("_id"), F.col("v").alias("_x"))
    local = neighbours.cut_lineage(neighbours.blocks(df, 100).groupBy("_node").applyInPandas(neighbours._within(5), neighbours._LOCAL))
    sizes = {r["_node"]: r["count"] for r in local.groupBy("_node").count().collect()}
    met = sum(sizes[r["_block"]] for r in neighbours.visits(local).collect())
    assert met < 0.1 * len(x) ** 2


def test_few_rows_nulls_and_none(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None), (3, [2.0])], "id long, v array<double>")
    assert _found(df, 5, 10) == {1: [3], 3: [1]}
    assert _found(df.where("id = 1"), 5, 10) == {}
    assert _found(df.where("id = 9"), 5, 10) == {}
