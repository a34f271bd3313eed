"""Curves, thresholds, money, blends, drift and explanations on hand-made rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators import business, curves, drift, ensemble, isotonic, profiles
from txnlens.sources import sinks, tables


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(list(zip([1, 1, 0, 1, 0], [0.9, 0.7, 0.5, 0.3, 0.1])), "y int, p double")


def test_hand_curve(hand):
    rows = {r["floor"]: (r["threshold"], r["precision"], r["achieved_recall"]) for r in curves.precision_at_recall(hand, [0.7, 0.6]).collect()}
    assert rows[0.7] == (0.3, 0.75, 1.0)
    assert rows[0.6] == (0.7, 1.0, pytest.approx(2 / 3))
    assert curves.average_precision(hand).first()["ap"] == pytest.approx((1 + 1 + 0.75) / 3)
    assert curves.roc_auc(hand).first()["auc"] == pytest.approx(5 / 6)


@pytest.mark.parametrize("chunks", [None, 3, 9])
def test_areas_match_loops(spark, chunks):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), rng.choice([0.1, 0.2, 0.5, 0.5, rng.random()]), "ab"[i % 3 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, p double, g string")
    got = {r["g"]: r for r in curves.area_metrics(df, by=["g"], chunks=chunks).collect()}
    for g in "ab":
        own = [(y, p) for y, p, k in rows if k == g]
        pos, neg = [p for y, p in own if y], [p for y, p in own if not y]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        ap = sum(sum(1 for q in pos if q >= p) / sum(1 for _, q in own if q >= p) for p in pos) / len(pos)
        assert got[g]["auc"] == pytest.approx(auc)
        assert got[g]["ap"] == pytest.approx(ap)


def test_single_class_slice_has_no_area(spark):
    df = spark.createDataFrame([(0, 0.2, "x"), (0, 0.9, "x"), (1, 0.9, "z"), (0, 0.1, "z")], "y int, p double, s string")
    rows = {r["slice"]: r for r in curves.slice_metrics(df, ["s"], 0.5).collect()}
    assert rows["x"]["ap"] is None and rows["x"]["fp"] == 1 and rows["x"]["reliable"] == 0
    assert rows["z"]["ap"] == 1.0


def test_sweep_equals_confusion(hand):
    sweep = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in curves.sweep_counts(hand, [0.05, 0.5, 0.9, 0.95]).collect()}
    for t, counts in sweep.items():
        c = curves.confusion_counts(hand, t).first()
        assert counts == (c["tp"], c["fp"], c["fn"], c["tn"])


def test_cost_conventions(spark):
    rows = [(1, 0.9)] * 8 + [(1, 0.1)] * 2 + [(0, 0.9)] * 9 + [(0, 0.1)] * 81
    df = spark.createDataFrame(rows, "y int, p double")
    got = {r["convention"]: r for r in business.impact(df, 0.5).collect()}
    assert got["prd"]["net_value"] == pytest.approx(8 * 480 - 2 * 500 - 9 * 5)
    assert got["net_of_principal"]["net_value"] == pytest.approx(8 * 480 - 9 * 5)
    assert got["prd"]["naive_baseline"] == -5000 and got["net_of_principal"]["naive_baseline"] == 0
    assert got["prd"]["implied_swing"] == 980


def test_weight_search_prefers_the_signal(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.1)
        rows.append((i, y, 3 * y + rng.gauss(0, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "id long, y int, informative double, noise double")
    best = ensemble.search_weights(df, ["informative", "noise"], 0.1, 0.02).first()
    assert best["w_informative"] > 0.7
    assert best["w_informative"] + best["w_noise"] == pytest.approx(1)
    spread = {r["model"]: r["mean"] for r in ensemble.bootstrap_weights(df, ["informative", "noise"], "id", 4, 0.25).collect()}
    assert spread["informative"] > spread["noise"]


def test_chunked_weight_search_is_the_same(spark):
    rng = random.Random(8)
    rows = [(int(rng.random() < 0.2), round(rng.random(), 1), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    grid = ensemble.simplex_grid(spark, ["a", "b"], 0.25)
    plain = {r["point"]: r["ap"] for r in ensemble.grid_ap(df, ["a", "b"], grid).collect()}
    cut = {r["point"]: r["ap"] for r in ensemble.grid_ap(df, ["a", "b"], grid, chunks=4).collect()}
    assert plain == pytest.approx(cut)


def test_blend_needs_the_same_models(hand):
    with pytest.raises(ValueError):
        ensemble.checked_blend(hand, {"a": 1.0}, ["b"])


def _sequential(pairs):
    """Plain pooling of ``(score, label)`` and the linear reading of it."""
    by_score = {}
    for p, y in pairs:
        s, w = by_score.get(p, (0, 0))
        by_score[p] = s + y, w + 1
    blocks = []
    for p in sorted(by_score):
        blocks.append([p, p, *by_score[p]])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return blocks


@pytest.mark.parametrize("small", [isotonic.SMALL_BLOCKS, 0])
@pytest.mark.parametrize("kind", ["noise", "near monotone", "falling", "one"])
def test_isotonic_blocks_are_those_of_one_pass(spark, monkeypatch, kind, small):
    monkeypatch.setattr(isotonic, "SMALL_BLOCKS", small)
    monkeypatch.setattr(isotonic, "BUCKETS", 7)
    rng = random.Random(6)
    label = {"noise": lambda p: int(rng.random() < p), "near monotone": lambda p: int(p > 0.5) ^ int(rng.random() < 0.02),
             "falling": lambda p: int(p < 0.5), "one": lambda p: 1}[kind]
    pairs = [(p, label(p)) for p in (round(rng.random(), 3) if kind != "one" else 0.25 for _ in range(900))]
    df = spark.createDataFrame([*pairs, (None, 1), (float("nan"), 0)], "p double, y int").repartition(3)
    fitted = isotonic.fit_isotonic(df)
    truth = _sequential(pairs)
    got = sorted((r.lo, r.hi, r.value) for r in fitted.collect())
    assert [g[:2] for g in got] == [(b[0], b[1]) for b in truth] and [g[2] for g in got] == pytest.approx([b[2] / b[3] for b in truth])
    asked = spark.createDataFrame([(i, x) for i, x in enumerate([-1.0, 0.0, 0.0015, 0.25, 0.49951, 0.5, 0.7777, 1.0, 9.0, None, float("nan")])], "i int, p double")
    out = {r["i"]: r["calibrated"] for r in isotonic.apply_isotonic(asked, fitted).collect()}
    xs, gs = [x for b in truth for x in b[:2]], [b[2] / b[3] for b in truth for _ in "ab"]
    for r in asked.collect():
        missing = r["p"] is None or r["p"] != r["p"]
        assert out[r["i"]] is None if missing else out[r["i"]] == pytest.approx(float(np.interp(r["p"], xs, gs)))


def test_isotonic_is_monotone_and_not_worse(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < p * p), p) for p in (rng.random() for _ in range(500))]
    df = spark.createDataFrame(rows, "y int, p double")
    out = isotonic.apply_isotonic(df, isotonic.fit_isotonic(df))
    values = [r["calibrated"] for r in out.orderBy("p").collect()]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    assert curves.brier(out, p="calibrated").first()["brier"] <= curves.brier(df).first()["brier"]


def test_pca_is_centred(spark):
    from txnlens.operators import encoders

    rng = random.Random(3)
    rows = [(i, [a := rng.gauss(50, 5), 2 * a + rng.gauss(0, 0.01), rng.gauss(0, 0.1)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    stages = encoders.fit_pca(df, "v", 2)
    out = encoders.apply_pca(df, stages, "v")
    assert abs(out.agg(F.avg("pca_v_0")).first()[0]) < 1e-6
    assert encoders.explained_variance(spark, stages).first()["share"] > 0.99


def _window(spark, seed, scale=1.0, n=400):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.gauss(0, 1) * scale, rng.gauss(0, 1), rng.choice("abc")) for _ in range(n)], "a double, b double, c string")


@pytest.mark.parametrize("chunks", [None, 4])
def test_drift_verdicts(spark, chunks):
    ref = _window(spark, 1)
    same = drift.drift_report(ref, _window(spark, 2), chunks=chunks).first()
    moved = drift.drift_report(ref, _window(spark, 2, 20.0), chunks=chunks).first()
    assert same["drift_detected"] == 0
    assert moved["drift_detected"] == 1 and moved["drifted_features"] == "a"
    half = drift.drift_report(ref, _window(spark, 2).select("b", "c"), chunks=chunks).first()
    assert half["drift_detected"] == 1 and half["schema_incomplete"] == 1 and half["missing_features"] == "a"
    for bad in (ref.where("a > 1e9"), ref.select(F.col("a").alias("z")), ref.select(F.lit(None).cast("double").alias("a"))):
        with pytest.raises(drift.EmptyWindowError):
            drift.assert_window(ref, bad)


def test_ks_against_loop(spark):
    ref, cur = _window(spark, 1, n=150), _window(spark, 9, 1.4, 90)
    got = {r["column"]: r for r in drift.numeric_drift(ref, cur, ["a", "b"], chunks=5).collect()}
    for c in ("a", "b"):
        x, z = [r[c] for r in ref.collect()], [r[c] for r in cur.collect()]
        d = max(abs(sum(v <= t for v in x) / len(x) - sum(v <= t for v in z) / len(z)) for t in x + z)
        assert got[c]["statistic"] == pytest.approx(d)


def test_counters_and_profiles(spark):
    df = spark.createDataFrame([("FRAUD", 0, 0, 1, 0), ("LEGITIMATE", 1, 1, 0, 1)], "decision string, error int, duplicate int, out_of_order int, partial int")
    assert profiles.stream_counters(df).first().asDict() == {
        "processed": 2, "alerts": 1, "errors": 1, "duplicates": 1, "out_of_order": 1, "partial_sequences": 1}


def test_log_window_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    lines = ['{"transaction_id":"%d","decision":"FRAUD","score":0.5,"logged_at":%d,"features":{"value":%d.0}}' % (i, i, i) for i in range(5)]
    (path / "a.json").write_text("\n".join([*lines, '{"transaction_id":"9","logged', '{"transaction_id":"8","logged_at":9,"features":{}}']))
    log = tables.read_prediction_log(spark, str(path))
    assert log.agg(F.sum("malformed")).first()[0] == 1
    from pyspark.sql.types import StructType
    window = tables.prediction_window(log, StructType().add("value", "double"), 3)
    assert sorted(r["value"] for r in window.collect()) == [2.0, 3.0, 4.0]


def test_edge_cache_follows_the_data(spark, tmp_path):
    source = spark.range(5)
    calls = []
    build = lambda: (calls.append(1), spark.range(3))[1]
    for df in (source, source, spark.range(6)):
        assert sinks.load_or_build_edges(spark, str(tmp_path / "e"), df, build).count() == 3
    assert len(calls) == 2


@pytest.mark.parametrize("ties", [False, True])
def test_bounded_search_is_exhaustive(spark, ties):
    """The winner of the bounds is that of all points, with weights, ties, and scores that are missing."""
    rng = random.Random(3)
    rows = []
    for i in range(500):
        y = int(rng.random() < 0.15)
        a, b, c = (0.4 * y + rng.random() for _ in range(3))
        rows.append((i, y, round(a, 1) if ties else a, b, None if i % 50 == 0 else c))
    df = spark.createDataFrame(rows, "id long, y int, m1 double, m2 double, m3 double")
    models, grid = ["m1", "m2", "m3"], ensemble._grid(["m1", "m2", "m3"], 0.1)
    best = {r["b"]: r for r in ensemble.bootstrap_best(df, models, "id", 5, 0.1).collect()}
    weighted = ensemble.bootstrap_samples(df.where("m3 is not null"), models, "id", 5).collect()
    for resample in range(5):
        own = [r for r in weighted if r["b"] == resample]
        aps = []
        for point in grid:
            score = [sum(w * r[m] for w, m in zip(point, models)) for r in own]
            tp = n = 0
            ap = 0.0
            for s in sorted(set(score), reverse=True):
                at = [r for r, v in zip(own, score) if v == s]
                pos = sum(r["w"] for r in at if r["y"])
                tp, n = tp + pos, n + sum(r["w"] for r in at)
                ap += pos * tp / n
            aps.append(ap / sum(r["w"] for r in own if r["y"]))
        top = max(round(x, 10) for x in aps)
        first = next(p for p, x in zip(grid, aps) if round(x, 10) == top)
        assert best[resample]["ap"] == pytest.approx(top, abs=1e-9)
        assert tuple(best[resample][f"w_{m}"] for m in models) == pytest.approx(first)


def test_close_points_are_told_apart_by_bins(spark, monkeypatch):
    """Scores that say nothing give close precisions; finer bins leave few points for exact curves, from spread rows."""
    rng, seen = random.Random(8), []
    df = spark.createDataFrame([(i, int(rng.random() < 0.2), rng.random(), rng.random(), rng.random()) for i in range(4000)],
                               "id long, y int, m1 double, m2 double, m3 double").coalesce(1)
    exact = ensemble.average_precision

    def counted(rows, y, p, by, *rest):
        seen.append((rows.select("b", "point").distinct().count(), rows.rdd.getNumPartitions()))
        return exact(rows, y, p, by, *rest)

    monkeypatch.setattr(ensemble, "average_precision", counted)
    monkeypatch.setattr(ensemble, "spread", lambda d, real=ensemble.spread: seen.append(real(d).rdd.getNumPartitions()) or real(d))
    models = ["m1", "m2", "m3"]
    got = ensemble.search_coarse(df, models, 0.05).first()
    assert seen[0] >= 8 and seen[1][0] <= 20
    tried = ensemble.grid_ap(df, models, ensemble.simplex_grid(spark, models, 0.05)).agg(F.max("ap")).first()[0]
    assert got["ap"] == pytest.approx(tried, abs=1e-9)


def test_resample_weights_match_hashlib(spark):
    import hashlib

    ids = [0, 7, 123456, None]
    df = spark.createDataFrame([(i, 1, 0.5) for i in ids], "id long, y int, m double")
    got = {(r["id"], r["b"]): r["w"] for r in ensemble.bootstrap_samples(df, ["m"], "id", 6).collect()}
    want = {}
    for i in ids:
        for b in range(6):
            u = int(hashlib.md5((f"{i}:{b}" if i is not None else str(b)).encode()).hexdigest()[:8], 16) / (1 << 32)
            want[i, b] = sum(u >= c for c in ensemble.POISSON_CUTS)
    assert got == {k: w for k, w in want.items() if w}


def test_bounds_hold_the_precision():
    rng = np.random.default_rng(5)
    for _ in range(50):
        score, y = np.round(rng.random(200), 2), rng.random(200) < 0.2
        pos, n = np.zeros((2, 17), np.int64)
        cell = (score * 16).astype(int)
        np.add.at(pos, cell, y)
        np.add.at(n, cell, 1)
        low, high = ensemble.ap_gaps(pos[::-1], n[::-1])
        exact = 0.0
        for s in np.unique(score[y]):
            above = score >= s
            exact += (score[y] == s).sum() * y[above].sum() / above.sum()
        exact /= y.sum()
        assert low.sum() - 1e-12 <= exact <= high.sum() + 1e-12
        edges = ensemble.finer_edges(np.linspace(0, 1.0625, 18), pos, (high - low)[::-1], 60)
        assert (np.diff(edges) > 0).all() and edges[0] == 0 and edges[-1] == 1.0625 and len(edges) <= 61
