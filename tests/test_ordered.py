"""The chunked forms give the same rows as a plain loop, whatever the skew and ties."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txnlens.operators import ordered


def groups(df):
    by = defaultdict(list)
    for r in df.collect():
        by[r["user_id"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (r["t"], r["event_id"]))
    return by


@pytest.mark.parametrize("chunks", [None, 2, 7, 40])
def test_prior(skewed, chunks):
    x = F.col("value")
    out = ordered.prior(skewed, ["user_id"], ["t", "event_id"], {
        "n": ("count", F.lit(1)), "s": ("sum", x), "mx": ("max", x), "mn": ("min", x)}, chunks)
    got = {r["event_id"]: (r["n"], r["s"], r["mx"], r["mn"]) for r in out.collect()}
    assert len(got) == 1200
    for rows in groups(skewed).values():
        for i, r in enumerate(rows):
            before = [p["value"] for p in rows[:i]]
            want = (i, sum(before), max(before), min(before)) if before else (0, None, None, None)
            assert got[r["event_id"]] == want


@pytest.mark.parametrize("form", ["before", "_before_by_halo", "_before_by_probe"])
@pytest.mark.parametrize("chunks", [None, 2, 7, 40])
def test_before(skewed, chunks, form):
    if chunks is None and form != "before":
        pytest.skip("the plain form has no chunks")
    offsets = {"a": 0, "b": 100_000_000, "c": 900_000_000}
    plan = ordered.plan_chunks(skewed, "t", "event_id", chunks)
    measures = {"n": ("count", F.lit(1)), "s": ("sum", F.col("value"))}
    out = getattr(ordered, form)(skewed, ["user_id"], "t", "event_id", measures, offsets, plan)
    got = {r["event_id"]: r.asDict() for r in out.collect()}
    assert len(got) == 1200
    for rows in groups(skewed).values():
        for r in rows:
            for o, micros in offsets.items():
                old = [p["value"] for p in rows if p["t"] < r["t"] - micros]
                assert got[r["event_id"]][f"n_{o}"] == len(old)
                assert got[r["event_id"]][f"s_{o}"] == sum(old)


@pytest.mark.parametrize("chunks", [None, 2, 7, 40])
@pytest.mark.parametrize("current", [True, False])
def test_history(skewed, chunks, current):
    out = ordered.history(skewed, ["user_id"], ["t", "event_id"], F.col("event_id"), 4, "h", current, chunks)
    got = {r["event_id"]: r["h"] for r in out.collect()}
    assert len(got) == 1200
    for rows in groups(skewed).values():
        ids = [r["event_id"] for r in rows]
        for i, e in enumerate(ids):
            assert got[e] == (ids[max(0, i - 3):i + 1] if current else ids[max(0, i - 4):i])


@pytest.mark.parametrize("chunks", [None, 5, 30])
def test_global_rank_and_rows_at(skewed, chunks):
    ids = [r["event_id"] for r in sorted(skewed.collect(), key=lambda r: (r["t"], r["event_id"]))]
    out = ordered.global_rank(skewed, ["t", "event_id"], "rank", chunks)
    assert [r["event_id"] for r in sorted(out.collect(), key=lambda r: r["rank"])] == ids
    rows = ordered.rows_at(skewed, ["t", "event_id"], [0, 500, 1199, 1200], chunks)
    assert [r and r["event_id"] for r in rows] == [ids[0], ids[500], ids[1199], None]


def test_one_value_fills_several_chunks(spark):
    """A time shared by most rows is cut along the id, so no chunk holds it all."""
    df = spark.range(4000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 8 == 0, F.col("id")).otherwise(77).alias("t"))
    plan = ordered.plan_chunks(df, "t", "event_id", 20)
    sizes = [r["count"] for r in plan.assign(df, F.col("t"), F.col("event_id")).groupBy("_chunk").count().collect()]
    assert max(sizes) < 600
    out = ordered.global_rank(df, ["t", "event_id"], "rank", 20).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(4000))
    assert [(r["t"], r["event_id"]) for r in out] == sorted((r["t"], r["event_id"]) for r in out)


def test_small_tables_stay_lazy(skewed, spark):
    assert ordered.plan_chunks(spark.range(100), "id").plain
    assert ordered.plan_chunks(skewed, "t", "event_id").plain


def test_only_hot_groups_are_cut(skewed, monkeypatch):
    """With a low size limit the hot entity takes the chunked form and the others the plain one."""
    from txnlens import session
    from txnlens.operators import windows

    cols = ["tx_count", "tx_sum", "tx_count_10min", "tx_count_24h", "amt_24h_mean", "since_last", "max_amount"]
    plain = {r["event_id"]: [r[c] for c in cols] for r in windows.velocity_features(skewed).collect()}
    monkeypatch.setattr(session, "ROWS_PER_CHUNK", 300)
    scopes = []
    ordered.by_heat(skewed, ["user_id"], ["t", "event_id"], lambda d, p: (scopes.append((p.scope, d.count())), d)[1])
    assert sorted(s for s, _ in scopes) == ["all", "plain"] and sum(n for _, n in scopes) == 1200
    mixed = {r["event_id"]: [r[c] for c in cols] for r in windows.velocity_features(skewed).collect()}
    assert mixed == plain
