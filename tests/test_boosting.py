"""Boosted trees against a plain version in one process."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators import boosting, models


def _rows(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.1)) & (rng.random(n) < 0.9)
    rows = [(i, int(y[i]), None if i % 11 == 0 else float(x[i, 0]), float("nan") if i % 13 == 0 else float(x[i, 1]), float(x[i, 2]),
             1.0 + 2 * int(y[i]), i % 5 == 0) for i in range(n)]
    return rows, "id long, y int, a double, b double, c double, weight double, held boolean"


def _plain(bins, y, w, base, trees, depth, rate, reg, least):
    """Every node sums its own rows; no siblings, no shuffles."""
    margin, out = np.full(len(y), base), []
    for _ in range(trees):
        g, h = boosting._gradients(margin, y, w)
        step = np.zeros(len(y))

        def split(rows, level):
            best = (1e-9, None)
            score = lambda r: (g[r].sum() / boosting.UNIT) ** 2 / (h[r].sum() / boosting.UNIT + reg)
            if level < depth:
                for f in range(bins.shape[1]):
                    for cut in np.unique(bins[rows, f])[:-1]:
                        go = bins[rows, f] <= cut
                        left, right = rows[go], rows[~go]
                        if min(h[left].sum(), h[right].sum()) >= least * boosting.UNIT:
                            gain = score(left) + score(right) - score(rows)
                            if gain > best[0] + 1e-12:
                                best = (gain, (left, right))
            if best[1] is None:
                step[rows] = -rate * g[rows].sum() / (h[rows].sum() + reg * boosting.UNIT)
            else:
                for part in best[1]:
                    split(part, level + 1)

        split(np.arange(len(y)), 0)
        margin = margin + step
        out.append(margin)
    return out


def test_trees_are_those_of_plain_sums(spark):
    rows, schema = _rows()
    df = spark.createDataFrame(rows, schema).repartition(5)
    model = boosting.train(df, ["a", "b", "c"], weight="weight", trees=12, depth=3)
    own = df.orderBy("id").toPandas()
    bins = model.binned([own[c] for c in "abc"])
    truth = _plain(bins, own["y"].to_numpy(float), own["weight"].to_numpy(), model.base, 12, 3, 0.1, 1.0, 1.0)[-1]
    got = models.score(model, df, ["a", "b", "c"]).orderBy("id").toPandas()["p_raw"]
    assert np.allclose(got, 1 / (1 + np.exp(-truth)), atol=1e-9)
    shares = model.importances()
    assert sum(shares.values()) == pytest.approx(1) and shares["c"] < 0.1


def test_training_stops_on_held_out_precision(spark):
    rows, schema = _rows()
    df = spark.createDataFrame(rows, schema)
    model = boosting.train(df, ["a", "b", "c"], weight="weight", validation="held", trees=60, depth=4, patience=5)
    assert len(model.trees) == int(np.argmax(model.history)) + 1 <= 60
    # The noted precision is that of the scores, up to the steps of its histogram.
    held = models.score(model, df.where("held"), ["a", "b", "c"])
    from txnlens.operators.curves import average_precision

    assert average_precision(held, p="p_raw").first()["ap"] == pytest.approx(max(model.history), abs=5e-3)
    assert max(model.history) > 0.7


def test_odd_tables(spark):
    rows, schema = _rows(40)
    df = spark.createDataFrame(rows, schema)
    features = ["a", "b", "c"]
    none = boosting.train(df.limit(0), features, trees=3)
    assert models.score(none, df, features).where("p_raw = 0.5").count() == 40
    constant = df.withColumns({f: F.lit(1.0) for f in features}).withColumn("y", F.lit(1))
    assert models.score(boosting.train(constant, features, trees=3), constant, features).agg(F.min("p_raw")).first()[0] > 0.99
    some = df.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    assert models.score(boosting.train(some, features, trees=2, depth=2), df, features).where("p_raw IS NULL").count() == 0
