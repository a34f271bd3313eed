"""Semantics of the per-entity and fitted features on hand-made rows."""

from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F

from txnlens.functions import rowwise
from txnlens.operators import encoders, graph, resample, sequences, splits, validate, windows
from txnlens.operators.neighbours import nearest_neighbours
from txnlens.operators.profiles import entity_state
from txnlens.roles import MICROS, Roles


def frame(spark, rows):
    data = [(i, e, int(t * MICROS), float(x), int(y)) for i, (e, t, x, y) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, user_id long, t long, value double, y int")


def by_id(df, *cols):
    return {r["event_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_span_border_is_inside(spark):
    at = frame(spark, [(1, 0, 5, 0), (1, 600, 5, 0)])
    past = frame(spark, [(1, 0, 5, 0), (1, 601, 5, 0)])
    assert by_id(windows.trailing_counts(at), "tx_count_10min")[1] == 1
    assert by_id(windows.trailing_counts(past), "tx_count_10min")[1] == 0


def test_ties_count_by_position_and_strict_leaves_them_out(spark):
    df = frame(spark, [(1, 100, 5, 0), (1, 100, 6, 0), (1, 100, 7, 0)])
    assert by_id(windows.trailing_counts(df), "tx_count_1h") == {0: 0, 1: 1, 2: 2}
    assert by_id(windows.trailing_counts(df, strict=True), "tx_count_1h") == {0: 0, 1: 0, 2: 0}


@pytest.mark.parametrize("chunks", [None, 3])
def test_own_amount_is_not_seen(spark, chunks):
    rows = [(1, t, 100, 0) for t in range(4)] + [(2, t, 50, 0) for t in range(3)]
    changed = [*rows]
    changed[3] = (1, 3, 5000, 1)
    cols = ["tx_count", "tx_sum", "mean_amount", "max_amount", "std_amount", "tx_count_24h", "amt_24h_mean"]
    a = by_id(windows.velocity_features(frame(spark, rows), chunks=chunks), *cols)
    b = by_id(windows.velocity_features(frame(spark, changed), chunks=chunks), *cols)
    assert a == b
    assert a[3] == (3, 300.0, 100.0, 100.0, 0.0, 3, 100.0)


@pytest.mark.parametrize("chunks", [None, 5])
def test_velocity_does_not_depend_on_input_order(skewed, chunks):
    cols = ["tx_count", "tx_sum", "tx_count_10min", "amt_24h_mean", "since_last"]
    a = by_id(windows.velocity_features(skewed, chunks=chunks), *cols)
    b = by_id(windows.velocity_features(skewed.orderBy(F.rand(3)).repartition(5), chunks=chunks), *cols)
    assert a == b


def test_carried_state_continues_history(skewed):
    cols = ["tx_count", "tx_sum", "max_amount", "since_last"]
    whole = by_id(windows.velocity_features(skewed), *cols)
    first, second = skewed.where("t < 900000000"), skewed.where("t >= 900000000")
    cont = by_id(windows.velocity_features(second, carried=entity_state(first)), *cols)
    assert cont == {k: whole[k] for k in cont}


def test_gap_of_a_backdated_row_is_minus_one(spark):
    late = frame(spark, [(1, 50, 5, 0)])
    state = entity_state(frame(spark, [(1, 100, 5, 0)]))
    assert by_id(windows.time_since_last(late, carried=state), "since_last")[0] == -1.0


@pytest.mark.parametrize("chunks", [None, 6])
def test_target_encoding_against_loop(skewed, chunks):
    lag = 300
    out = by_id(windows.target_encode_lagged(skewed, ["event_type"], F.lit(0.1), lag, chunks=chunks), "event_type_target_enc")
    eager = by_id(windows.target_encode(skewed, ["event_type"], F.lit(0.1), chunks=chunks), "event_type_target_enc")
    rows = skewed.collect()
    for r in rows:
        old = [p["y"] for p in rows if p["event_type"] == r["event_type"] and p["t"] <= r["t"] - lag * MICROS]
        seen = [p["y"] for p in rows if p["event_type"] == r["event_type"] and (p["t"], p["event_id"]) < (r["t"], r["event_id"])]
        assert out[r["event_id"]] == pytest.approx((sum(old) + 1) / (len(old) + 10))
        assert eager[r["event_id"]] == pytest.approx((sum(seen) + 1) / (len(seen) + 10))


def test_split_sizes_follow_float_cuts(spark):
    df = spark.range(590_540).select(F.col("id").alias("event_id"), F.col("id").alias("t"))
    counts = {r["split"]: r["count"] for r in splits.time_split3(df).groupBy("split").count().collect()}
    assert counts == {"train": 413_378, "val": 59_053, "test": 118_109}


def test_fits_read_train_only(spark, skewed):
    base = splits.time_split3(skewed)
    moved = base.withColumns({
        "y": F.when(F.col("split") != "train", 1 - F.col("y")).otherwise(F.col("y")),
        "value": F.when(F.col("split") != "train", F.col("value") * 10).otherwise(F.col("value")),
        "event_type": F.when(F.col("split") != "train", F.lit("ZZZ")).otherwise(F.col("event_type"))})
    for fit in (lambda d: encoders.frequency(d, "event_type"), lambda d: encoders.fit_labels(d, "event_type"),
                lambda d: encoders.fit_quantile(d, "value"), entity_state):
        a = fit(base.where("split = 'train'")).collect()
        b = fit(moved.where("split = 'train'")).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_unseen_and_missing_labels_share_a_code(spark, skewed):
    state = encoders.fit_labels(skewed.where("event_type = 'a'"), "event_type")
    assert {r["event_type"]: r["event_type_code"] for r in state.collect()} == {"MISSING": 0, "a": 1}
    out = encoders.apply_labels(skewed, state, "event_type")
    assert {(r["event_type"], r["event_type_code"]) for r in out.collect()} == {("a", 1), ("b", 0), (None, 0)}


@pytest.mark.parametrize("chunks", [None, 4])
def test_quantiles_are_exact(skewed, chunks):
    values = sorted(r["value"] for r in skewed.collect())
    probs = [i / 100 for i in range(101)]
    got = {r["prob"]: r["value"] for r in encoders.exact_quantiles(skewed, "value", probs, chunks).collect()}
    for p in probs:
        h = (len(values) - 1) * p
        lo, hi = values[math.floor(h)], values[math.ceil(h)]
        assert got[p] == pytest.approx(lo + (hi - lo) * (h - math.floor(h)))


def test_normal_scores(spark):
    us = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    for r in encoders.with_inverse_normal(df, "u", "z").collect():
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["u"]), rel=1e-7, abs=1e-8)


def test_decimal_length(spark):
    df = spark.createDataFrame([(100.0,), (99.99,), (49.995,)], "value double")
    assert [r["amount_decimal_len"] for r in rowwise.amount_features(df).collect()] == [0, 2, 3]


def test_row_summary_fills(spark):
    df = spark.createDataFrame([(None, None), (4.0, None), (1.0, 3.0)], "a double, b double")
    rows = rowwise.row_summary(df, ["a", "b"], "D", "d").collect()
    assert [(r["d_null_count"], r["d_mean"], r["d_max"]) for r in rows] == [(2, -1.0, -1.0), (1, 4.0, 4.0), (0, 2.0, 3.0)]
    assert [r["d_std"] for r in rows] == [-1.0, -1.0, pytest.approx(math.sqrt(2))]


def test_cohort_key_tokens(spark):
    df = spark.createDataFrame([(7, None, None, 0), (None, 3.0, 0.5, 86_400 * MICROS)], "user_id long, a double, d double, t long")
    assert [r["uid"] for r in rowwise.cohort_key(df, "user_id", "a", "d").collect()] == ["7_naA_naD", "-1_3_0"]


@pytest.mark.parametrize("chunks", [None, 4])
def test_sequences_pad_left_and_keep_order(skewed, chunks):
    out = sequences.build_sequences(skewed, ["value"], n=3, chunks=chunks)
    for r in out.where("user_id = 2").collect():
        real = sum(r["mask"])
        assert r["mask"] == [0] * (3 - real) + [1] * real
        assert r["seq"][-1] == [r["value"]]
        assert all(v == [0.0] for v in r["seq"][: 3 - real])


def test_cross_split_sequences_match_the_whole_table(skewed):
    df = splits.time_split3(skewed)
    whole = by_id(sequences.build_sequences(df, ["value"], n=5), "seq")
    for split in ("train", "val", "test"):
        part = by_id(sequences.sequences_across(df, ["value"], "split", split, n=5), "seq")
        assert part == {k: whole[k] for k in part}


@pytest.mark.parametrize("chunks", [None, 4])
def test_capped_edges(spark, chunks):
    df = spark.createDataFrame([(i, 1 if i < 9 else -1, 5.0) for i in range(12)], "node long, card long, addr double")
    spec = graph.EdgeSpec("card", ("card",), 3)
    got = {(r["src"], r["dst"]) for r in graph.capped_edges(df, "node", spec, chunks).collect()}
    assert got == {(a, b) for a in range(9) for b in range(9) if 0 < b - a <= 3}
    none = graph.EdgeSpec("addr", ("addr",), 3, {"addr": 5.0})
    assert graph.capped_edges(df, "node", none).count() == 0
    with pytest.raises(ValueError):
        graph.assert_edge_key_allowed(["card_freq"])
    with pytest.raises(ValueError):
        graph.assert_edge_budget(df, [spec], 5)


def test_sampled_neighbours_share_the_shuffle_of_their_edges(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(40)], "node long, card long, kind long")
    edges = graph.edges_from_specs(df, "node", [graph.EdgeSpec("card", ("card",), 6), graph.EdgeSpec("both", ("card", "kind"), 3)])
    got = graph.sample_neighbors(edges, 2)
    assert "hashpartitioning(src" not in got._jdf.queryExecution().executedPlan().toString()
    import hashlib

    into = {}
    for src, dst in {(r["src"], r["dst"]) for r in edges.collect()}:
        into.setdefault(dst, []).append((hashlib.md5(f"{src}:{dst}:42".encode()).hexdigest(), src))
    want = {(src, dst) for dst, own in into.items() for _, src in sorted(own)[:2]}
    assert {(r["src"], r["dst"]) for r in got.collect()} == want and edges.count() == sum(map(len, into.values()))


def test_edge_budget_grows_with_the_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_EDGES", 10)
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "node long, card long")
    graph.assert_edge_budget(df, [graph.EdgeSpec("card", ("card",), 3)])
    monkeypatch.setattr(graph, "MAX_EDGES_PER_NODE", 5)
    with pytest.raises(ValueError):
        graph.assert_edge_budget(df, [graph.EdgeSpec("card", ("card",), 10)])


@pytest.mark.parametrize("block", [1000, 40])
def test_neighbours_are_exact(spark, block):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[:100] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in nearest_neighbours(df, "id", "v", 5, block).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        want = np.sort(d[i])[:5]
        assert np.allclose([v[2] for v in sorted(got[i])], want, atol=1e-9)


def test_smote_balances_on_segments(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3)], int(i < 12)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v array<float>, y int")
    out = resample.smote(df, "id", "v", k=3).collect()
    x = {i: np.array(v) for i, v, _ in rows}
    assert len(out) == 76
    for r in out:
        assert r["base"] < 12 and r["neighbour"] < 12
        assert np.allclose(r["v"], x[r["base"]] + (x[r["neighbour"]] - x[r["base"]]) * r["share"], atol=1e-4)


def test_imbalance_rule():
    assert resample.resolve_imbalance("oversample", "weighted_bce", 1, 27) == (True, 1.0)
    assert resample.resolve_imbalance("none", "weighted_bce", 1, 27) == (False, 27.0)
    with pytest.raises(NotImplementedError):
        resample.resolve_imbalance("smote", "bce", 1, 1)
    with pytest.raises(ValueError):
        resample.resolve_imbalance("both", "bce", 1, 1)


def test_validation_errors(spark, skewed):
    with pytest.raises(ValueError):
        validate.align(skewed, ["nope"])
    with pytest.raises(Exception, match="no positive rows"):
        resample.class_weights(skewed.where("y = 0")).collect()


def test_roles_are_bound_not_fixed(spark):
    df = spark.createDataFrame([(1, 9, 5 * MICROS, 2.0), (2, 9, 8 * MICROS, 3.0)], "k long, card long, at long, amt double")
    roles = Roles("k", "card", "at", "amt")
    assert [r["since_last"] for r in windows.velocity_features(df, roles).orderBy("k").collect()] == [-1.0, 3.0]
