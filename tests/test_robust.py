"""Sizes that estimates miss, ties and vocabularies of strings, missing scores and groups, repeated and late stream rows."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnlens import session
from txnlens.operators import curves, drift, encoders, ordered, profiles
from txnlens.streaming import state


def test_repetitive_rows_are_counted(spark, tmp_path, monkeypatch):
    """A table whose compressed size says nothing about its rows is cut all the same."""
    path = str(tmp_path / "t")
    spark.range(400_000).select(F.lit(1).alias("one"), (F.col("id") % 3).alias("g"), "id").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path).select("one", "id")
    monkeypatch.setattr(session, "ROWS_PER_CHUNK", 50_000)
    assert session.rows_at_most(df.select("one"), 50_000) == (False, 400_000)
    plan = ordered.plan_chunks(df, "id")
    assert not plan.plain and len(plan.splits) > 8
    exploded = spark.range(10).select(F.explode(F.sequence(F.lit(1), F.lit(10_000))).alias("v"))
    assert session.rows_at_most(exploded, 50_000)[0] is False


def test_ties_of_strings_are_cut(spark):
    rows = [(5, f"user_{i:06d}") for i in range(4000)] + [(i, f"x{i}") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "t long, id string").repartition(4)
    plan = ordered.plan_chunks(df, "t", "id", 20)
    sizes = [r["count"] for r in plan.assign(df, F.col("t"), F.col("id")).groupBy("_chunk").count().collect()]
    assert max(sizes) < 1500
    ranked = ordered.global_rank(df, ["t", "id"], "rank", 20).orderBy("rank").collect()
    assert [(r["t"], r["id"]) for r in ranked] == sorted(rows) and [r["rank"] for r in ranked] == list(range(len(rows)))


def test_more_chunks_than_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ordered, "QUANTILES", 8)
    df = spark.range(5000).withColumnRenamed("id", "t")
    plan = ordered.plan_chunks(df, "t", None, 64)
    sizes = [r["count"] for r in plan.assign(df, F.col("t"), None).groupBy("_chunk").count().collect()]
    assert max(sizes) < 400
    assert [r["rank"] for r in ordered.global_rank(df, ["t"], "rank", 64).orderBy("t").collect()] == list(range(5000))


def test_labels_with_a_common_prefix(spark):
    values = [f"https://example.org/{i}" for i in range(3000)] + [None, "é", ""]
    df = spark.createDataFrame([(v,) for v in values], "c string").repartition(3)
    got = {r["c"]: r["c_code"] for r in encoders.fit_labels(df, "c", 12).collect()}
    from txnlens.functions import fixed

    want = sorted({v if v is not None else fixed.MISSING for v in values} | {fixed.MISSING}, key=lambda s: s.encode())
    assert got == {v: i for i, v in enumerate(want)}


def test_hot_keys_keep_the_plan_linear(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_CHUNK", 100)
    df = spark.range(1000).select("id", F.col("id").alias("t"), *[F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % (5 + k)).alias(f"k{k}")
                                                                for k in range(4)])
    scans = []
    for k in range(4):
        df = ordered.prior(df, [f"k{k}"], ["t", "id"], {f"n{k}": ("count", F.lit(1))})
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    assert scans[-1] - scans[-2] <= max(scans[1] - scans[0], 4)
    seen: dict[tuple, int] = {}
    for r in df.orderBy("id").collect():
        for k in range(4):
            key = (k, r[f"k{k}"])
            assert r[f"n{k}"] == seen.get(key, 0)
            seen[key] = seen.get(key, 0) + 1


def test_rows_without_a_score_rank_nowhere(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "y int, p double")
    whole = df.where("p is not null and not isnan(p)")
    assert curves.average_precision(df).first() == curves.average_precision(whole).first()
    assert curves.confusion_counts(df, 0.75).first() == curves.confusion_counts(whole, 0.75).first()
    assert curves.threshold_sweep(df).orderBy("threshold").collect() == curves.threshold_sweep(whole).orderBy("threshold").collect()


def test_no_positives_and_null_groups(spark):
    assert profiles.label_distribution(spark.createDataFrame([(0,), (0,)], "y int")).first()["imbalance_ratio"] is None
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), float(rng.randrange(50))) for _ in range(400)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for chunks in (None, 6):
        got = {r["g"]: r for r in profiles.describe_by(df, "g", "x", chunks).collect()}
        assert set(got) == {"a", "b", "c", None, "empty"}
        for g in ("a", "b", "c", None):
            own = pd.Series([x for k, x in rows if k == g])
            assert [got[g][c] for c in ("n", "q25", "q50", "q75")] == pytest.approx([len(own), *own.quantile([0.25, 0.5, 0.75])])
        assert got["empty"]["n"] == 0 and got["empty"]["q50"] is None


def test_drift_with_a_null_reference_column(spark):
    ref = spark.createDataFrame([(float(i), None, "a") for i in range(50)], "x double, z double, c string")
    cur = spark.createDataFrame([(float(i), 1.0, "a") for i in range(50)], "x double, z double, c string")
    report = drift.drift_report(ref, cur).first()
    assert report["compared"] == 2 and report["missing_features"] == "z" and report["drifted"] == 0


def frame(rows):
    return pd.DataFrame(rows, columns=["entity", "id", "t", "amount"])


def test_repeated_ids_keep_their_rows():
    out, after = state._answer(frame([(1, 7, 10, 5.0), (1, 7, 20, 6.0), (1, None, 30, 1.0), (1, None, 40, 1.0)]), state._EMPTY)
    assert len(out) == 4 and out["tx_count"].tolist() == [0, 1, 2, 3] and after[0] == 4


def test_late_rows_see_their_own_day():
    hour = 3600 * state.MICROS
    _, after = state._answer(frame([(1, 1, 0, 1.0), (1, 2, 10 * hour, 1.0), (1, 3, 30 * hour, 1.0)]), state._EMPTY)
    out, _ = state._answer(frame([(1, 4, 20 * hour, 1.0)]), after)
    assert out["tx_count_24h"].tolist() == [2] and out["out_of_order"].tolist() == [1]
    assert np.isfinite(out["amt_24h_mean"]).all()


def test_scratch_scope_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    with session.scratch_scope(spark):
        kept = session.cut_lineage(spark.range(10))
        with session.scratch_scope(spark):
            session.cut_lineage(kept)
            assert len(list(tmp_path.iterdir())) == 2
        assert kept.count() == 10 and len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir())
