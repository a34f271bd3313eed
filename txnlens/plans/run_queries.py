"""Queries that write, train, monitor or stream."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions import fixed, rowwise
from txnlens.operators import business, curves, drift, encoders, ensemble, explain, graph, isotonic, models, profiles, resample, validate, windows
from txnlens.plans.catalog import ARRIVAL, EV, PRIOR, SPLIT, W, _SHIFT, events, query, rounded, split_events, sq
from txnlens.plans.features import apply_steps, causal_steps, features_full
from txnlens.plans.row_queries import _DEV, _UA, DAY_MEAN, DOMAIN, DOMAIN_B, EXPANDED, PLACE, RATE, UID_SQL, _rules_sql, _trailing_sql, with_uid
from txnlens.plans.score_queries import FULL, SCORES
from txnlens.plans.table_queries import CARD, _nodes
from txnlens.roles import MICROS, Roles
from txnlens.session import cut_lineage, scratch_path
from txnlens.sources import sinks, tables
from txnlens.sources.tables import read_table
from txnlens.streaming import keyed, labels, rates, scoring, sources, state
from txnlens.streaming.batches import FeatureBatches

# ---------------------------------------------------------------- sources and sinks

TX = ["event_id", "t", "user_id", "event_type", "value", "k"]
TX_SQL = "event_id, t, user_id, event_type, value, k"


@query("scan_csv", f"WITH {EV} SELECT {TX_SQL} FROM ev")
def _(spark, d):
    e = events(spark, d).select(*TX)
    path = scratch_path(spark, "tx-csv")
    sinks.write_report(e, path, "csv")
    return tables.read_transactions(spark, path, e.schema)


@query("scan_side_csv", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, d):
    side = read_table(spark, d, "labels")
    path = scratch_path(spark, "side-csv")
    sinks.write_report(side, path, "csv")
    return tables.read_identity(spark, path, side.schema)


@query("sink_splits", f"WITH {SPLIT} SELECT event_id, y, p, split FROM sp")
def _(spark, d):
    path = scratch_path(spark, "splits")
    sinks.write_splits(split_events(spark, d).select("event_id", "y", "p", "split"), path)
    return spark.read.parquet(path)


def _log_rows(e):
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"), rowwise.decide(F.col("p"), 0.45).alias("decision"),
        F.col("p").alias("score"), F.col("t").alias("logged_at"), "value", F.expr("CASE WHEN k <> 9 THEN k END").alias("k"), "p2")


FEATURES = ["value", "k", "p2"]


@query("sink_jsonl", f"WITH {EV} SELECT CAST(event_id AS VARCHAR) AS transaction_id, t AS logged_at, value, CASE WHEN k <> 9 THEN k::DOUBLE END AS k FROM ev")
def _(spark, d):
    path = scratch_path(spark, "log")
    sinks.write_prediction_log(_log_rows(events(spark, d)), path, FEATURES)
    log = tables.read_prediction_log(spark, path)
    return log.select("transaction_id", "logged_at", F.col("features")["value"].alias("value"), F.col("features")["k"].alias("k"))


WINDOW_SCHEMA = T.StructType().add("value", "double").add("k", "double").add("p2", "double")


def _damaged_log(spark, d):
    """A log in which every line of k = 7 is cut off in the middle."""
    path, text = scratch_path(spark, "log"), scratch_path(spark, "log-text")
    sinks.write_prediction_log(_log_rows(events(spark, d)), path, FEATURES)
    lines = spark.read.text(path)
    broken = F.get_json_object("value", "$.features.k") == "7.0"
    lines.select(F.when(broken, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value")).write.text(text)
    return tables.read_prediction_log(spark, text)


@query("scan_jsonl_window", f"""WITH {EV} SELECT value, CASE WHEN k <> 9 THEN k::DOUBLE END AS k, p2 FROM ev WHERE k <> 7 ORDER BY t DESC, CAST(event_id AS VARCHAR) DESC LIMIT 5000""")
def _(spark, d):
    return tables.prediction_window(_damaged_log(spark, d), WINDOW_SCHEMA)


@query("malformed_count", f"WITH {EV} SELECT count(*) AS lines, count(*) FILTER (k = 7) AS malformed FROM ev")
def _(spark, d):
    return _damaged_log(spark, d).agg(F.count(F.lit(1)).alias("lines"), F.sum("malformed").alias("malformed"))


@query("sink_tables", f"WITH {EV}, g AS (SELECT event_type, count(*) AS n, CAST(sum(y) AS BIGINT) AS frauds FROM ev GROUP BY 1) SELECT fmt, event_type, n, frauds FROM g, (VALUES ('csv'), ('json'), ('parquet')) f(fmt)")
def _(spark, d):
    out = None
    table = events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("frauds"))
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, f"report-{fmt}")
        sinks.write_report(table, path, fmt)
        reader = spark.read.schema(table.schema)
        back = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
        back = back.withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


STATE_COLS = "user_id, count(*) AS n, max(value) AS max, max(t) AS last_ts"


@query("state_save", f"WITH {SPLIT} SELECT {STATE_COLS} FROM sp WHERE split = 'train' GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "state")
    sinks.save_state({"entity": profiles.entity_state(split_events(spark, d).where("split = 'train'"))}, path)
    return sinks.load_state(spark, path, ["entity"])["entity"].select("user_id", "n", "max", "last_ts")


@query("state_load", f"""WITH {SPLIT}, f AS (SELECT event_type, count(*) / (SELECT count(*) FROM sp WHERE split = 'train') AS f FROM sp WHERE split = 'train' GROUP BY 1),
s AS (SELECT user_id, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1)
SELECT event_id, f.f AS event_type_freq, CAST(coalesce(s.n, 0) AS BIGINT) AS n FROM sp LEFT JOIN f USING (event_type) LEFT JOIN s USING (user_id) WHERE split = 'test'""")
def _(spark, d):
    e = split_events(spark, d)
    train = e.where("split = 'train'")
    path = scratch_path(spark, "state")
    sinks.save_state({"freq": encoders.frequency(train, "event_type"), "entity": profiles.entity_state(train)}, path)
    st = sinks.load_state(spark, path, ["freq", "entity"])
    out = encoders.apply_frequency(e.where("split = 'test'"), st["freq"], "event_type")
    out = windows.with_carried(out, st["entity"], "user_id")
    return out.select("event_id", "event_type_freq", F.coalesce("c_n", F.lit(0)).alias("n"))


@query("edge_cache", f"WITH {SPLIT} SELECT sum(least(c - 1, 10) * c - least(c - 1, 10) * (least(c - 1, 10) + 1) / 2)::BIGINT AS edges, 1 AS same FROM (SELECT count(*) AS c FROM sp GROUP BY user_id)")
def _(spark, d):
    nodes = _nodes(spark, d).select("node", "user_id")
    path = scratch_path(spark, "edges")
    first = sinks.load_or_build_edges(spark, path, nodes, lambda: graph.capped_edges(nodes, "node", CARD))
    again = sinks.load_or_build_edges(spark, path, nodes, lambda: nodes.where("false").select(F.lit(0).alias("src")))
    same = first.exceptAll(again).isEmpty()
    return again.agg(F.count(F.lit(1)).alias("edges")).withColumn("same", F.lit(int(same)))


@query("kafka_sink_txn", f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS key, event_id, CASE WHEN k >= 50 THEN value END AS value, CAST(k < 50 AS INTEGER) AS value_absent FROM ev")
def _(spark, d):
    e = events(spark, d).select("event_id", "user_id", F.expr("CASE WHEN k >= 50 THEN value END").alias("value"))
    m = sinks.to_keyed_messages(e, "user_id")
    return m.select(
        "key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"),
        F.get_json_object("value", "$.value").cast("double").alias("value"), (~F.contains("value", F.lit('"value"'))).cast("int").alias("value_absent"))


def _scored(df):
    return df.withColumn("decision", rowwise.decide(F.col("p"), 0.45))


@query("kafka_sink_alert", f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS key, event_id, 0 AS model_scores FROM ev WHERE p >= 0.45")
def _(spark, d):
    m = sinks.alert_messages(_scored(events(spark, d)), "user_id", SCORES)
    return m.select("key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"),
                    F.contains("value", F.lit('"p1"')).cast("int").alias("model_scores"))


# ---------------------------------------------------------------- compositions

DELTAS = ["nullif(k, 0)", "CASE WHEN k % 4 <> 0 THEN k / 2 END", "CASE WHEN k > 50 THEN value END"]


AGENT = "CASE k % 5 WHEN 0 THEN 'Chrome 90 for Android Mobile' WHEN 1 THEN 'mobile Safari 11' WHEN 2 THEN 'Firefox 60' WHEN 3 THEN 'Edge 17' END"
DEVICE = "CASE k % 4 WHEN 0 THEN 'SAMSUNG SM-G930' WHEN 1 THEN 'iOS Device' WHEN 2 THEN 'Windows' END"
SCREEN = "CASE WHEN k % 3 = 0 THEN '1920x1080' WHEN k % 3 = 1 THEN '12x' END"
TARGET_KEYS = ["user_id", "event_type", "dom_a", "dom_b", "k", "place"]


def _wide(spark, d):
    return events(spark, d).withColumns({
        "dom_a": F.expr(DOMAIN), "dom_b": F.expr(DOMAIN_B), "agent": F.expr(AGENT), "device": F.expr(DEVICE), "screen": F.expr(SCREEN),
        "v0": F.col("p2"), "v1": F.when(F.col("k") > 10, F.col("p3")), "v2": F.col("k") / 100.0, **{f"d{i}": F.expr(c).cast("double") for i, c in enumerate(DELTAS)}})


def _steps():
    return causal_steps(Roles(), ("dom_a", "dom_b"), ["d0", "d1", "d2"], ["d0", "d1"], {"addr_present": "d0", "dist_present": "d2"},
                        device=("agent", "device", "screen"))


DEVICE_COLUMNS = f"""{_rules_sql("ua", _UA)} AS browser_family, CAST(regexp_matches(ua, '{fixed.MOBILE_PATTERN}') AS INTEGER) AS browser_is_mobile,
  {_rules_sql("dev", _DEV)} AS device_brand, CASE WHEN k % 3 = 0 THEN 1920.0::DOUBLE WHEN k % 3 = 1 THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END AS screen_width""".replace(
    "(ua,", f"(coalesce(lower({AGENT}), ''),").replace("(dev,", f"(coalesce(lower({DEVICE}), ''),")


CAUSAL = f"""{DAY_MEAN}, {EXPANDED.replace("FROM ev", "FROM dm")}, g AS (SELECT *, (t - lag(t) OVER ({W})) / 1e6 AS g, (t // 3600000000) % 24 AS h FROM m)"""


@query("features_causal", f"""WITH {EV}, {CAUSAL}
SELECT event_id, CAST(h AS INTEGER) AS hour_of_day, {sq("ln(1 + value)", 6)} AS amount_log, CAST({DOMAIN} IS NOT DISTINCT FROM {DOMAIN_B} AS INTEGER) AS email_match,
  CAST(({DELTAS[0]} IS NULL)::INTEGER + ({DELTAS[1]} IS NULL)::INTEGER + (({DELTAS[2]}) IS NULL)::INTEGER AS INTEGER) AS d_null_count,
  n AS tx_count, {sq("mean")} AS mean_amount, {sq("std")} AS std_amount, {sq("coalesce(g, -1)")} AS since_last, wn AS tx_count_24h, {sq("day_mean")} AS amt_24h_mean,
  CAST(k <> 0 AS INTEGER) AS addr_present, {sq("h * ln(1 + value)")} AS hour_x_amount_log, {DEVICE_COLUMNS} FROM g""")
def _(spark, d):
    out = apply_steps(_wide(spark, d), _steps()).select(
        "event_id", "hour_of_day", "amount_log", "email_match", "d_null_count", "tx_count", "mean_amount", "std_amount",
        "since_last", "tx_count_24h", "amt_24h_mean", "addr_present", "hour_x_amount_log", "browser_family", "browser_is_mobile",
        "device_brand", "screen_width")
    return rounded(out, amount_log=6, mean_amount=4, std_amount=4, since_last=4, amt_24h_mean=4, hour_x_amount_log=4)


LAG_S = 432_000
_KEY_SQL = {"user_id": "user_id", "event_type": "event_type", "dom_a": DOMAIN, "dom_b": DOMAIN_B, "k": "k", "place": PLACE}
_TARGETS = ", ".join(sq(f"(coalesce(sum(y) OVER (PARTITION BY {e} {{o}}), 0) + 10 * {RATE}) / (count(*) OVER (PARTITION BY {e} {{o}}) + 10)", 8)
                     + f" AS {k}_target_enc" for k, e in _KEY_SQL.items()).replace(
    "{o}", f"ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {LAG_S * MICROS} PRECEDING")
# All components together keep the length of the centred block, whatever their signs and order.
_BLOCK = [("p2", "p2"), ("v1", "CASE WHEN k > 10 THEN p3 ELSE 0 END"), ("v2", "k / 100.0::DOUBLE")]
_CENTRED = " + ".join(f"pow({e} - (SELECT avg({e}) FROM sp WHERE split = 'train'), 2)" for _, e in _BLOCK)


@query("features_full", f"""WITH {SPLIT}, {UID_SQL.format(src="sp")},
cf AS (SELECT user_id, dm, count(*) / (SELECT count(*) FROM sp WHERE split = 'train') AS f FROM (SELECT *, coalesce({DOMAIN}, '-999') AS dm FROM sp WHERE split = 'train') GROUP BY 1, 2),
un AS (SELECT uid, count(*) AS n FROM uid WHERE split = 'train' GROUP BY 1),
ct AS (SELECT quantile_cont(value, 0.8) AS cut FROM sp WHERE split = 'train' AND event_type = 'purchase'),
lb AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT coalesce({DOMAIN}, 'MISSING') AS v FROM sp WHERE split = 'train' UNION SELECT 'MISSING')),
fr AS (SELECT user_id, count(*) / (SELECT count(*) FROM sp WHERE split = 'train') AS f FROM sp WHERE split = 'train' GROUP BY 1),
te AS (SELECT event_id, {_TARGETS}, row_number() OVER ({W}) - 1 AS n, {sq(_CENTRED, 6)} AS block_length, {DEVICE_COLUMNS} FROM sp)
SELECT sp.event_id, sp.split, coalesce(cf.f, 0) AS combo_freq, coalesce(un.n, 0) AS uid_count, CAST(sp.event_type = 'purchase' AND sp.value >= cut AS INTEGER) AS dist_high,
  te.* EXCLUDE (event_id, n), coalesce(fr.f, 0) AS user_id_freq, lb.code AS dom_a_code, te.n AS tx_count, coalesce({", ".join(["CASE WHEN sp.k > 50 THEN sp.value END", "-999"])}) AS d2
FROM sp JOIN uid USING (event_id) LEFT JOIN cf ON cf.user_id = sp.user_id AND cf.dm = coalesce({DOMAIN.replace("event_type", "sp.event_type")}, '-999')
LEFT JOIN fr ON fr.user_id = sp.user_id LEFT JOIN un ON un.uid = uid.uid JOIN te ON te.event_id = sp.event_id JOIN lb ON lb.v = coalesce({DOMAIN.replace("event_type", "sp.event_type")}, 'MISSING'), ct""")
def _(spark, d):
    df = _wide(spark, d)
    out = features_full(df, Roles(), ["user_id", "dom_a"], with_uid, "age", "event_type = 'purchase'", TARGET_KEYS, ["dom_a"],
                        ["value", "dom_a", "dom_b", "d0", "d1", "d2"], _steps(), LAG_S, freq_cols=["user_id"], block=["v0", "v1", "v2"])
    length = reduce(lambda a, b: a + b, [F.col(f"pca_v_{i}") * F.col(f"pca_v_{i}") for i in range(3)])
    encoded = [f"{k}_target_enc" for k in TARGET_KEYS]
    return rounded(out.withColumn("block_length", length).select(
        "event_id", "split", "combo_freq", "uid_count", "dist_high", *encoded, "dom_a_code", "tx_count", "d2", "user_id_freq", "block_length",
        "browser_family", "browser_is_mobile", "device_brand", "screen_width"), block_length=6, **{c: 8 for c in encoded})


@query("ensemble_eval")
def _(spark, d):
    """Correlations, search, lift gate, resampled weights and threshold on validation, metrics on test at the frozen choice."""
    e = split_events(spark, d)
    val, test = cut_lineage(e.where("split = 'val'").select("event_id", "y", *SCORES)), e.where("split = 'test'")
    three = ensemble.search_weights(val, SCORES).first()
    two = ensemble.search_weights(val, ["p1", "p3"]).first()
    names = SCORES if three["ap"] - two["ap"] >= fixed.MIN_LIFT else ["p1", "p3"]
    won = three if names is SCORES else two
    blended = ensemble.blend({m: won[f"w_{m}"] for m in names})
    chosen = business.optimal_threshold(val.withColumn("p", blended), business.Costs(fn=0.0)).first()["threshold"]
    scored = test.withColumn("p", blended)
    ap = curves.average_precision(scored).select("ap").scalar()
    label = ";".join(f"{m}={won[f'w_{m}']:.4f}" for m in names)
    related = {f"corr_{r['a']}_{r['b']}": F.lit(r["corr"]) for r in profiles.corr_pairs(val, SCORES).collect()}
    resampled = {f"{stat}_{r['model']}": F.lit(r[stat]) for r in ensemble.bootstrap_weights(val, names, "event_id").collect() for stat in ("mean", "std", "p05", "p95")}
    return curves.confusion(scored, chosen).withColumns({
        "weights": F.lit(label), "threshold": F.lit(chosen), "val_ap": F.lit(won["ap"]), "test_ap": ap, "lift": F.lit(three["ap"] - two["ap"]), **related, **resampled})


# ---------------------------------------------------------------- models

X = ["value", "k", "p2", "p3"]


@query("train_gbt")
def _(spark, d):
    e = cut_lineage(split_events(spark, d).select("event_id", "split", "y", *X))
    fit = resample.weight_column(e.where("split <> 'test'"), 3.0).withColumn("held", F.col("split") == "val")
    model = models.train_gbt(fit, X, weight="w", validation="held")
    return models.score(model, e.where("split = 'test'"), X).select("event_id", "y", "p_raw")


@query("score_batch")
def _(spark, d):
    e = cut_lineage(split_events(spark, d).select("event_id", "split", "y", *X))
    model = models.train_linear(e.where("split = 'train'"), X)
    scored = models.score(model, e.where("split <> 'train'"), X)
    calibrated = isotonic.apply_isotonic(scored, isotonic.fit_isotonic(scored.where("split = 'val'"), p="p_raw"), "p_raw", "p_calibrated")
    return calibrated.select("event_id", "split", "y", "p_raw", "p_calibrated")


@query("param_search")
def _(spark, d):
    e = cut_lineage(split_events(spark, d).select("split", "y", *X))
    return models.search_params(e.where("split = 'train'"), e.where("split = 'val'"), X, {"depth": [3, 6], "rate": [0.1]})


@query("feature_importance")
def _(spark, d):
    e = split_events(spark, d).where("split <> 'test'")
    fit = cut_lineage(e.select("y", *X, (F.col("split") == "val").alias("held")))
    return models.importances(spark, models.train_gbt(fit, X, validation="held"), X)


@query("ablation_table")
def _(spark, d):
    e = cut_lineage(split_events(spark, d).select("split", "y", *X))

    def arm(df, weight):
        model = models.train_linear(resample.weight_column(df.where("split = 'train'"), weight), X, weight="w")
        return curves.average_precision(models.score(model, df.where("split = 'val'"), X), p="p_raw")

    return resample.ablation(e, {"none": None, "x7": 7.25, "x29": 29.0}, arm)


@query("linear_model_additivity", f"WITH {EV} SELECT 0 * count(*) AS violations FROM ev")
def _(spark, d):
    train = cut_lineage(split_events(spark, d).where("split = 'train'").select("event_id", "y", *X))
    model = models.train_linear(train, X)
    coefs = dict(zip(X, map(float, model.coefficients)))
    means = explain.feature_means(train, X)
    base = means.select(sum((F.lit(w) * F.col(c) for c, w in coefs.items()), F.lit(float(model.intercept))))
    long = explain.linear_contributions(train, "event_id", coefs, means)
    bad = explain.additivity_violations(long, explain.margins(train, "event_id", coefs, float(model.intercept)), "event_id", base)
    return bad.agg(F.count(F.lit(1)).alias("violations"))


# ---------------------------------------------------------------- drift

DRIFT_COLS = ["value", "k", "p2", "event_type", "hour_bin"]


def _drift_sides(spark, d):
    """Train rows against the newest part; one column is shifted there and one category merged."""
    e = rowwise.temporal_features(split_events(spark, d)).withColumn("hour_bin", (F.col("hour_of_day") / 6).cast("int"))
    ref = e.where("split = 'train'").select(*DRIFT_COLS)
    cur = e.where("split = 'test'").select(
        (F.col("value") * 1.5).alias("value"), "k", "p2", F.expr("CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END").alias("event_type"), "hour_bin")
    return ref, cur


def drift_sql(numeric, categorical):
    """Drift of table c against table r as CTEs ending in ``dr``."""
    def long(cols, cast):
        return " UNION ALL ".join(
            f"SELECT '{x}' AS col, {cast.format(x)} AS v, 1 AS a, 0 AS b FROM r WHERE {x} IS NOT NULL UNION ALL "
            f"SELECT '{x}', {cast.format(x)}, 0, 1 FROM c WHERE {x} IS NOT NULL" for x in cols)

    out = f"""nl AS ({long(numeric, "{}::DOUBLE")}),
ng AS (SELECT col, v, sum(a) AS a, sum(b) AS b FROM nl GROUP BY 1, 2),
nt AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS n, sum(b) OVER t AS m, v - lag(v) OVER w AS width FROM ng WINDOW w AS (PARTITION BY col ORDER BY v), t AS (PARTITION BY col)),
ks AS (SELECT col, max(abs(ca / n - cb / m)) AS stat, max(n) AS n, max(m) AS m, sum(abs((ca - a) / n - (cb - b) / m) * coalesce(width, 0)) AS w1,
  sqrt(sum(v * v * a) / max(n) - (sum(v * a) / max(n)) ** 2) AS sd FROM nt GROUP BY 1),
kd AS (SELECT col AS "column", 'ks' AS test, stat AS statistic, 1.358::DOUBLE * sqrt((n + m) / (n * m)) AS cut, w1 / sd AS secondary, CAST(stat > 1.358 * sqrt((n + m) / (n * m)) AS INTEGER) AS drifted FROM ks)"""
    if not categorical:
        return out + ", dr AS (SELECT * FROM kd)"
    return out + f""", cl AS ({long(categorical, "CAST({} AS VARCHAR)")}),
cg AS (SELECT col, v, sum(a) AS a, sum(b) AS b, sum(sum(a)) OVER (PARTITION BY col) AS n, sum(sum(b)) OVER (PARTITION BY col) AS m FROM cl GROUP BY 1, 2),
cp AS (SELECT *, a / n AS p, b / m AS q, (a / n + b / m) / 2 AS z, (a + b) * n / (n + m) AS ea, (a + b) * m / (n + m) AS eb FROM cg),
js AS (SELECT col, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / z) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / z) ELSE 0 END) / 2, 0)) AS stat, sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb) AS chi FROM cp GROUP BY 1),
dr AS (SELECT * FROM kd UNION ALL SELECT col, 'js', stat, 0.1::DOUBLE, chi, CAST(stat >= 0.1 AS INTEGER) FROM js)"""


DR = f"""{SPLIT}, r AS (SELECT value, k, p2, event_type, CAST(((t // 3600000000) % 24) // 6 AS INTEGER) AS hour_bin FROM sp WHERE split = 'train'),
c AS (SELECT value * 1.5::DOUBLE AS value, k, p2, CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS event_type, CAST(((t // 3600000000) % 24) // 6 AS INTEGER) AS hour_bin FROM sp WHERE split = 'test'),
{drift_sql(["value", "k", "p2"], ["event_type", "hour_bin"])}"""


@query("column_drift", f"""WITH {DR} SELECT "column", test, {sq("statistic", 6)} AS statistic, {sq("cut", 6)} AS cut, {sq("secondary", 4)} AS secondary, drifted FROM dr""")
def _(spark, d):
    ref, cur = _drift_sides(spark, d)
    return rounded(drift.column_drift(ref, cur, DRIFT_COLS), statistic=6, cut=6, secondary=4)


@query("drift_report", f"""WITH {DR}, s AS (SELECT count(*) AS compared, CAST(sum(drifted) AS BIGINT) AS drifted, string_agg("column", ',' ORDER BY "column") FILTER (drifted = 1) AS names FROM dr)
SELECT compared, drifted, names AS drifted_features, {sq("drifted / compared", 6)} AS drift_share, 'lost' AS missing_features, {sq("1 / 6", 6)} AS missing_share,
  CAST(drifted / compared > 0.3 AS INTEGER) AS drift_detected, (SELECT count(*) FROM r) AS reference_rows, (SELECT count(*) FROM c) AS current_rows FROM s""")
def _(spark, d):
    ref, cur = _drift_sides(spark, d)
    out = drift.drift_report(ref.withColumn("lost", F.col("value")), cur).select(
        "compared", "drifted", "drifted_features", "drift_share", "missing_features", "missing_share", "drift_detected", "reference_rows", "current_rows")
    return rounded(out, drift_share=6, missing_share=6)


@query("usable_columns", f"""WITH {DR}, n AS (SELECT count(*) AS n FROM c) SELECT 'value' AS "column", 1 AS present, n AS filled, 1 AS usable FROM n
UNION ALL SELECT 'k', 1, 0, 0 FROM n UNION ALL SELECT 'lost', 0, 0, 0 FROM n""")
def _(spark, d):
    ref, cur = _drift_sides(spark, d)
    return drift.usable_columns(ref.select("value", "k").withColumn("lost", F.col("value")), cur.withColumn("k", F.expr("nullif(k, k)")))


@query("drift_guards", f"WITH {DR} SELECT count(*) AS window_rows, 3 AS refused FROM c")
def _(spark, d):
    ref, cur = _drift_sides(spark, d)
    refused = 0
    for window in (cur.where("value < 0"), cur.select(F.col("value").alias("other")), cur.select(F.expr("nullif(value, value)").alias("value"))):
        try:
            drift.assert_window(ref, window)
        except drift.EmptyWindowError:
            refused += 1
    return cur.agg(F.count(F.lit(1)).alias("window_rows")).withColumn("refused", F.lit(refused))


def _alert_path(spark, d):
    ref, cur = _drift_sides(spark, d)
    path = scratch_path(spark, "alerts")
    sinks.append_alerts(drift.drift_alerts(drift.drift_report(ref, cur)), path)
    sinks.append_alerts(drift.drift_alerts(drift.drift_report(ref, ref)), path)
    return path


@query("drift_alerts", f"""WITH {DR} SELECT CAST(1 AS BIGINT) AS drift_detected, (SELECT count(*) FROM c) AS current_rows FROM dr HAVING sum(drifted) / count(*) > 0.3""")
def _(spark, d):
    return spark.read.json(_alert_path(spark, d)).select("drift_detected", "current_rows")


@query("alert_readback", f"""WITH {DR} SELECT count(*) AS alerts FROM (SELECT 1 FROM dr HAVING sum(drifted) / count(*) > 0.3)""")
def _(spark, d):
    return sinks.read_alert(spark, _alert_path(spark, d)).agg(F.count(F.lit(1)).alias("alerts"))


@query("monitor", f"""WITH {SPLIT}, r AS (SELECT value, k, p2 FROM sp WHERE split = 'train'),
c AS (SELECT value, CASE WHEN k <> 9 THEN k END AS k, p2 FROM sp WHERE k <> 7 ORDER BY t DESC, CAST(event_id AS VARCHAR) DESC LIMIT 5000), {drift_sql(["value", "k", "p2"], [])}
SELECT count(*) AS compared, CAST(sum(drifted) AS BIGINT) AS drifted, CAST(sum(drifted) / count(*) > 0.3 AS INTEGER) AS drift_detected,
  (SELECT count(*) FROM r) AS reference_rows, (SELECT count(*) FROM c) AS current_rows FROM dr""")
def _(spark, d):
    """Newest log window, dtypes restored, compared with the train reference."""
    window = tables.prediction_window(_damaged_log(spark, d), WINDOW_SCHEMA)
    reference = split_events(spark, d).where("split = 'train'").select("value", F.col("k").cast("int").alias("k"), "p2")
    restored = validate.cast_like(window, reference.schema)
    return drift.drift_report(reference, restored).select("compared", "drifted", "drift_detected", "reference_rows", "current_rows")


# ---------------------------------------------------------------- streaming


def _event_stream(spark, d, **options):
    """The events table as a stream. A trigger's rows are bounded by ``maxFilesPerTrigger``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = read_table(spark, d, "events").schema
    # As a pattern the path may be one file or a folder of files.
    path = os.path.join(d, "events.parque[t]")
    raw = sources.stream_transactions(spark, "parquet", path, schema, maxFilesPerTrigger="64", **options)
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.col("ts").cast("timestamp")
    e = raw.select("event_id", at.alias("at"), F.unix_micros(at).alias("t"), "user_id", "event_type", "value", k.alias("k"))
    return e.select(
        "*", (F.col("k") < 4).cast("int").alias("y"), F.least(F.round(F.col("value") / 500, 4), F.lit(1.0)).alias("p1"),
        ((F.col("event_id") * 7919) % 1000 / 1000.0).alias("p2"), (F.floor(F.col("t") / 3_600_000_000) % 24 / 24.0).alias("p3"),
    ).withColumn("p", ensemble.blend(FULL))


MESSAGE = T.StructType().add("event_id", "long").add("user_id", "long").add("t", "long").add("value", "double")


def _message_stream(spark, d):
    """Keyed JSON messages from a file source; those of k = 7 are cut off."""
    path = scratch_path(spark, "messages")
    e = events(spark, d)
    m = sinks.to_keyed_messages(e.select("event_id", "user_id", "t", "value", "k"), "user_id")
    broken = F.get_json_object("value", "$.k") == "7"
    m.select(F.when(broken, F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value")).write.text(path)
    return sources.parse_messages(sources.stream_transactions(spark, "text", path, T.StructType().add("value", "string")), MESSAGE)


@query("kafka_source", f"WITH {EV} SELECT event_id, user_id, t, value FROM ev WHERE k <> 7")
def _(spark, d):
    good, _ = sources.dead_letters(_message_stream(spark, d))
    return sources.run_append(good, "consumed")


@query("poison_tolerance", f"WITH {EV} SELECT count(*) FILTER (k <> 7) AS processed, count(*) FILTER (k = 7) AS skipped FROM ev")
def _(spark, d):
    parsed = sources.run_append(_message_stream(spark, d).select("event_id", "bad"), "parsed")
    return parsed.agg(F.sum(1 - F.col("bad")).alias("processed"), F.sum("bad").alias("skipped"))


@query("stream_static_join", f"WITH {EV}, s AS (SELECT user_id, count(*) AS n FROM ev WHERE y = 1 GROUP BY 1) SELECT event_id, coalesce(s.n, 0) AS frauds FROM ev LEFT JOIN s USING (user_id)")
def _(spark, d):
    side = events(spark, d).where("y = 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "side")
    side.write.parquet(path)
    out = _event_stream(spark, d).join(spark.read.parquet(path), "user_id", "left")
    return sources.run_append(out.select("event_id", F.coalesce("n", F.lit(0)).alias("frauds")), "enriched")


@query("dedupe", f"WITH {EV} SELECT event_id, user_id, value FROM ev")
def _(spark, d):
    # Every row of k < 20 arrives twice.
    twice = _event_stream(spark, d).withColumn("_again", F.explode(F.when(F.col("k") < 20, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return sources.run_append(sources.dedupe_stream(twice, "at").select("event_id", "user_id", "value"), "deduped")


def _stream_out(spark, d):
    return sources.run_append(state.stream_features(_event_stream(spark, d)), "features")


@query("entity_state_stream", f"""WITH {EV}, {EXPANDED}
SELECT event_id AS id, n AS tx_count, {sq("s", 2)} AS tx_sum, {sq("mean")} AS mean_amount, coalesce(mx, 0) AS max_amount, {sq("std")} AS std_amount FROM m""")
def _(spark, d):
    return rounded(_stream_out(spark, d).select("id", "tx_count", "tx_sum", "mean_amount", "max_amount", "std_amount"), tx_sum=2, mean_amount=4, std_amount=4)


@query("window_state_stream", f"""WITH {EV}, {DAY_MEAN} SELECT event_id AS id, {_trailing_sql(600)} AS tx_count_10min, {_trailing_sql(3600)} AS tx_count_1h, wn AS tx_count_24h, {sq("day_mean")} AS amt_24h_mean FROM dm""")
def _(spark, d):
    return rounded(_stream_out(spark, d).select("id", "tx_count_10min", "tx_count_1h", "tx_count_24h", "amt_24h_mean"), amt_24h_mean=4)


def _cents_sql(x):
    return f"CAST(CAST(floor({x} * 100 + {_SHIFT}) AS BIGINT) AS VARCHAR)"


@query("ring_buffer_stream", f"""WITH {EV}, a AS (SELECT * FROM ev WHERE k % 10 <> 9), r AS (SELECT event_id, list({_cents_sql("value")} || ':' || {_cents_sql("p2")} || ':' || k) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS seq FROM a)
SELECT event_id AS id, array_to_string(seq, ',') AS seq, CAST(len(seq) AS INTEGER) AS seq_len FROM r""")
def _(spark, d):
    """Rings of feature vectors; rows of k = 9, 19, ... lack an amount and every third row comes twice, which both leave no trace."""
    s = _event_stream(spark, d).withColumn("value", F.when(F.col("k") % 10 != 9, F.col("value")))
    twice = s.withColumn("_again", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    out = sources.run_append(keyed.keyed_features(twice, vector=["value", "p2", "k"]), "rings", store=sources.ROCKSDB)
    cents = lambda x: F.floor(x * 100 + _SHIFT).cast("long").cast("string")
    text = F.transform("seq", lambda v: F.concat_ws(":", cents(v[0]), cents(v[1]), v[2].cast("long").cast("string")))
    return out.where("duplicate = 0 AND lacking = 0").select("id", F.array_join(text, ",").alias("seq"), "seq_len")


@query("entity_state_batches", f"""WITH {EV}, {DAY_MEAN}, {EXPANDED.replace("FROM ev", "FROM dm")}
SELECT event_id, n AS tx_count, {sq("mean")} AS mean_amount, {sq("std")} AS std_amount, wn AS tx_count_24h, {sq("day_mean")} AS amt_24h_mean, 0 AS stale FROM m""")
def _(spark, d):
    base = scratch_path(spark, "batches")
    out = os.path.join(base, "out")
    sources.run_batches(_event_stream(spark, d), FeatureBatches(out, os.path.join(base, "state")), "batches")
    cols = spark.read.parquet(out).select("event_id", "tx_count", "mean_amount", "std_amount", "tx_count_24h", "amt_24h_mean", "stale")
    return rounded(cols, mean_amount=4, std_amount=4, amt_24h_mean=4)


@query("train_serve_parity", f"WITH {EV} SELECT count(*) AS n, 0::BIGINT AS differing FROM ev")
def _(spark, d):
    """Every streamed row against the batch features: counts exactly, floats to 1e-9 relative."""
    live = _stream_out(spark, d)
    batch = windows.velocity_features(events(spark, d))
    exact = ["tx_count", "tx_count_10min", "tx_count_1h", "tx_count_24h"]
    close = ["tx_sum", "mean_amount", "max_amount", "std_amount", "since_last", "amt_24h_mean"]
    b = batch.select(F.col("event_id").alias("id"), *[F.col(c).alias(f"b_{c}") for c in exact + close])
    off = sum((F.col(c) != F.col(f"b_{c}")).cast("int") for c in exact)
    off = off + sum((F.abs(F.col(c) - F.col(f"b_{c}")) > 1e-6 + 1e-9 * F.abs(F.col(c))).cast("int") for c in close)
    return live.join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.sum((off > 0).cast("int")).alias("differing"))


@query("late_rule", f"""WITH {EV}, a AS (SELECT *, {ARRIVAL} AS arrived FROM ev),
s AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY arrived, t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT event_id AS id, CAST(coalesce(seen - t > 86400000000, FALSE) AS INTEGER) AS stale, CAST(coalesce(t < seen, FALSE) AS INTEGER) AS out_of_order, triggers
FROM s, (VALUES (1), (3)) v(triggers)""")
def _(spark, d):
    """Each event arrives k hours after it happened; the verdicts follow the arrival, in one trigger and in three."""
    base = scratch_path(spark, "arrivals")
    e = events(spark, d).select("event_id", "user_id", "t", "value", F.expr(ARRIVAL).alias("arrived"))
    ends = e.selectExpr("percentile_approx(arrived, array(0.3, 0.6))").first()[0]
    out = []
    for name, cuts in (("1", []), ("3", ends)):
        source, offsets, to = (os.path.join(base, f"{x}{name}") for x in ("src", "offsets", "out"))
        bounds = [None, *cuts, None]
        for low, high in zip(bounds, bounds[1:]):
            part = e.where(F.lit(True) if low is None else F.col("arrived") > low).where(F.lit(True) if high is None else F.col("arrived") <= high)
            part.write.mode("append").parquet(source)
            stream = sources.stream_transactions(spark, "parquet", source, e.schema)
            sources.run_append_to(keyed.keyed_features(stream, arrival="arrived"), to, offsets, store=sources.ROCKSDB)
        out.append(spark.read.parquet(to).select("id", "stale", "out_of_order", F.lit(int(name)).alias("triggers")))
    return out[0].unionByName(out[1])


@query("late_rule_by_trigger", f"""WITH {EV}, m AS (SELECT user_id, max(t) AS seen FROM ev WHERE k < 90 GROUP BY 1)
SELECT event_id AS id, CAST(k >= 90 AND seen - t > 86400000000 AS INTEGER) AS stale, CAST(k >= 90 AND t < seen AS INTEGER) AS out_of_order FROM ev LEFT JOIN m USING (user_id)""")
def _(spark, d):
    base = scratch_path(spark, "late")
    e = events(spark, d).select("event_id", "user_id", "t", "value", "k")
    drops = [("first", "k < 90"), ("second", "k >= 90")]
    for name, rule in drops:
        e.where(rule).write.parquet(os.path.join(base, "in", f"drop={name}"))
    out, offsets = os.path.join(base, "out"), os.path.join(base, "offsets")
    source = os.path.join(base, "src")
    for name, _ in drops:
        # The second delivery reaches the same query after it has finished the first.
        spark.read.parquet(os.path.join(base, "in", f"drop={name}")).write.mode("append").parquet(source)
        s = sources.stream_transactions(spark, "parquet", source, e.schema)
        sources.run_append_to(state.stream_features(s), out, offsets)
    return spark.read.parquet(out).select("id", "stale", "out_of_order")


TTL_DAYS = 1


# Three deliveries in time order; after each one the watermark, an hour behind, lets entities go that were silent for a day.
@query("state_ttl", f"""WITH {EV}, e AS (SELECT *, least((t - min(t) OVER ()) * 3 // (max(t) OVER () - min(t) OVER () + 1), 2) AS part FROM ev),
w AS (SELECT part, max(max(t)) OVER (ORDER BY part) // 1000 - 3600000 AS mark FROM e GROUP BY part),
p AS (SELECT user_id, part, lag(max(t)) OVER (PARTITION BY user_id ORDER BY part) AS last FROM e GROUP BY 1, 2),
r AS (SELECT p.user_id, p.part, sum(CAST(coalesce(last // 1000 + {TTL_DAYS} * 86400000 < w.mark, FALSE) AS INTEGER)) OVER (PARTITION BY p.user_id ORDER BY p.part) AS life
  FROM p LEFT JOIN w ON w.part = p.part - 1)
SELECT event_id AS id, row_number() OVER (PARTITION BY user_id, life ORDER BY t, event_id) - 1 AS tx_count FROM e JOIN r USING (user_id, part)""")
def _(spark, d):
    base = scratch_path(spark, "ttl")
    e = events(spark, d).select("event_id", "user_id", "t", "value", F.timestamp_micros("t").alias("at"))
    low, high = e.agg(F.min("t"), F.max("t")).first()
    part = F.least(F.floor((F.col("t") - low) * 3 / (high - low + 1)), F.lit(2))
    src, out, offsets = (os.path.join(base, x) for x in ("src", "out", "offsets"))
    for i in range(3):
        e.where(part == i).write.mode("append").parquet(src)
        stream = sources.stream_transactions(spark, "parquet", src, e.schema).withWatermark("at", "1 hour")
        sources.run_append_to(state.stream_features(stream, time="at", ttl_days=TTL_DAYS), out, offsets)
    return spark.read.parquet(out).select("id", "tx_count")


@query("state_seed", f"""WITH {SPLIT}, {DAY_MEAN.replace("FROM ev", "FROM sp")}, {EXPANDED.replace("FROM ev", "FROM dm")},
r AS (SELECT *, list({_cents_sql("value")} || ':' || {_cents_sql("p2")}) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS vs,
  {", ".join(f"{_trailing_sql(v)} AS w{k}" for k, v in fixed.TRAILING_SPANS_S.items())},
  coalesce((t - max(t) OVER {PRIOR}) / 1e6, -1) AS gap FROM m)
SELECT event_id AS id, n AS tx_count, {sq("s", 2)} AS tx_sum, {sq("mean")} AS mean_amount, coalesce(mx, 0) AS max_amount, {sq("std")} AS std_amount, {sq("gap", 2)} AS since_last,
  {", ".join(f"w{k} AS tx_count_{k}" for k in fixed.TRAILING_SPANS_S)}, {sq("day_mean")} AS amt_24h_mean, array_to_string(vs, ',') AS seq FROM r WHERE split <> 'train'""")
def _(spark, d):
    """All accumulators, trailing entries and the ring go on from the batch state of the train rows."""
    e = split_events(spark, d)
    seed = keyed.batch_state(e.where("split = 'train'"), vector=["value", "p2"])
    path = scratch_path(spark, "later")
    e.where("split <> 'train'").select("event_id", "user_id", "t", "value", "p2").write.parquet(path)
    stream = sources.stream_transactions(spark, "parquet", path, spark.read.parquet(path).schema)
    live = sources.run_append(keyed.keyed_features(stream, vector=["value", "p2"], seed=seed), "seeded", store=sources.ROCKSDB)
    cents = lambda x: F.floor(x * 100 + _SHIFT).cast("long").cast("string")
    seq = F.array_join(F.transform("seq", lambda v: F.concat_ws(":", cents(v[0]), cents(v[1]))), ",")
    counts = [f"tx_count_{k}" for k in fixed.TRAILING_SPANS_S]
    return rounded(live.withColumn("seq", seq).select("id", "tx_count", "tx_sum", "mean_amount", "max_amount", "std_amount", "since_last", *counts, "amt_24h_mean", "seq"),
                   tx_sum=2, mean_amount=4, std_amount=4, since_last=2, amt_24h_mean=4)


@query("state_seed_totals", f"WITH {SPLIT} SELECT event_id AS id, row_number() OVER ({W}) - 1 AS tx_count, {sq(f'coalesce(sum(value) OVER {PRIOR}, 0)', 2)} AS tx_sum, split FROM sp QUALIFY split <> 'train'")
def _(spark, d):
    e = split_events(spark, d)
    seed = profiles.entity_state(e.where("split = 'train'"))
    path = scratch_path(spark, "later")
    e.where("split <> 'train'").select("event_id", "user_id", "t", "value", "split").write.parquet(path)
    stream = sources.stream_transactions(spark, "parquet", path, spark.read.parquet(path).schema)
    live = sources.run_append(state.seeded_counts(stream, seed), "seeded", store=sources.ROCKSDB)
    return rounded(live.join(spark.read.parquet(path).select(F.col("event_id").alias("id"), "split"), "id").select("id", "tx_count", "tx_sum", "split"), tx_sum=2)


@query("score_stream", f"""WITH {EV}, a AS (SELECT * FROM ev WHERE user_id % 10 <> 3), f AS (SELECT *, {_trailing_sql(86400)} AS wn FROM a),
x AS (SELECT *, CASE WHEN k <> 50 THEN p1 END AS m1, CASE WHEN k % 10 <> 0 THEN p2 END AS m2, least(wn / 20, 1.0::DOUBLE) AS v FROM f),
z AS (SELECT *, CASE WHEN m1 IS NULL THEN 'failed' WHEN m2 IS NULL THEN 'fallback' ELSE 'full' END AS mode,
  CASE WHEN m1 IS NULL THEN NULL WHEN m2 IS NULL THEN 0.7::DOUBLE * m1 + 0.3::DOUBLE * v ELSE 0.5::DOUBLE * m1 + 0.3::DOUBLE * m2 + 0.2::DOUBLE * v END AS b FROM x),
o AS (SELECT event_id AS id, mode, {sq("b", 6)} AS p, CASE WHEN b IS NULL THEN NULL WHEN b >= CASE WHEN mode = 'full' THEN 0.45 ELSE 0.3 END THEN 'FRAUD' ELSE 'LEGITIMATE' END AS decision FROM z)
SELECT 'log' AS sink, * FROM o UNION ALL SELECT 'alert', * FROM o WHERE decision = 'FRAUD'""")
def _(spark, d):
    """Rows of some users are broken, every fifth row comes twice, some models are missing; a third score comes from the keyed features."""
    base = scratch_path(spark, "scored")
    s = _event_stream(spark, d).withColumns({
        "value": F.when(F.col("user_id") % 10 == 3, -1.0).otherwise(F.col("value")),
        "m1": F.when(F.col("k") != 50, F.col("p1")), "m2": F.when(F.col("k") % 10 != 0, F.col("p2"))}).drop("p", "p1", "p2", "p3")
    twice = s.withColumn("_again", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_again")
    scored = scoring.decisions(
        twice, "at", ["m1", "m2"], {"m1": 0.5, "m2": 0.3, "v": 0.2}, {"m1": 0.7, "v": 0.3}, 0.45, 0.3, {"v": F.least(F.col("tx_count_24h") / 20, F.lit(1.0))})
    scoring.run_sinks(scored, base, store=sources.ROCKSDB)
    schema = scored.schema
    out = [spark.read.schema(schema).parquet(os.path.join(base, k, "*")).select(F.lit(k).alias("sink"), "id", "mode", "p", "decision") for k in ("log", "alert")]
    return rounded(out[0].unionByName(out[1]), p=6)


@query("score_stream_precomputed", f"WITH {EV} SELECT 'log' AS sink, event_id FROM ev WHERE user_id % 10 <> 3 UNION ALL SELECT 'alert', event_id FROM ev WHERE user_id % 10 <> 3 AND p >= 0.45")
def _(spark, d):
    """Validate, score, decide, then two sinks from each micro-batch. Rows of some users are broken on purpose."""
    base = scratch_path(spark, "scored")
    s = _event_stream(spark, d).withColumn("value", F.when(F.col("user_id") % 10 == 3, -1.0).otherwise(F.col("value")))
    checked = s.withColumn("reason", validate.reject_reason("event_id", "t", "value", "user_id"))
    scored = _scored(checked.where("reason is null"))

    def both(batch, batch_id: int) -> None:
        # Both sinks read the batch, which would be scored twice without this.
        rows = batch.select("event_id", "decision").persist()
        rows.write.mode("overwrite").parquet(os.path.join(base, "log", f"batch={batch_id}"))
        rows.where("decision = 'FRAUD'").write.mode("overwrite").parquet(os.path.join(base, "alert", f"batch={batch_id}"))
        rows.unpersist()

    sources.run_batches(scored, both, "scored")
    out = [spark.read.parquet(os.path.join(base, k)).select(F.lit(k).alias("sink"), "event_id") for k in ("log", "alert")]
    return out[0].unionByName(out[1])


def _windows_sql(width_us, slide_us):
    n = width_us // slide_us
    return f"w AS (SELECT (t // {slide_us} - i) * {slide_us} AS window_start, * FROM ev, range({n}) r(i))"


@query("sliding_fraud_rate", f"""WITH {EV}, {_windows_sql(300_000_000, 30_000_000)}
SELECT window_start, count(*) AS n, count(*) FILTER (p >= 0.45) AS frauds, count(*) FILTER (p >= 0.45) / count(*) AS fraud_rate FROM w GROUP BY 1""")
def _(spark, d):
    return sources.run_updates(rates.sliding_rate(_scored(_event_stream(spark, d)), "at"), "window_start", "rate")


@query("volume_per_min", f"WITH {EV}, {_windows_sql(60_000_000, 60_000_000)} SELECT window_start, count(*) AS n FROM w GROUP BY 1")
def _(spark, d):
    return sources.run_updates(rates.volume(_event_stream(spark, d), "at"), "window_start", "volume")


@query("latency_p95", f"""WITH {EV}, {_windows_sql(300_000_000, 60_000_000)} SELECT window_start, count(*) AS n, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS p95 FROM w GROUP BY 1""")
def _(spark, d):
    return sources.run_updates(rates.latency_p95(_event_stream(spark, d), "at", "value"), "window_start", "latency")


@query("backlog", f"""WITH {EV}, c AS (SELECT event_id % 4 AS batch, count(*) AS n FROM ev GROUP BY 1)
SELECT batch, (sum(n) OVER (ORDER BY batch))::BIGINT AS processed, (sum(n) OVER () - sum(n) OVER (ORDER BY batch))::BIGINT AS backlog FROM c""")
def _(spark, d):
    """Four files, one a trigger: what waits is the rows in the source less those of the progress events."""
    path = scratch_path(spark, "arriving")
    e = events(spark, d).select("event_id", "value")
    for i in range(4):
        e.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(path)
    stream = sources.stream_transactions(spark, "parquet", path, e.schema, maxFilesPerTrigger="1")
    progress = sources.run_append_to(stream, scratch_path(spark, "counted"), scratch_path(spark, "counted-offsets"))
    trace = rates.backlog_trace(progress, spark.read.parquet(path).count())
    return spark.createDataFrame(trace, "batch long, processed long, backlog long")


_ENCODED = f"""SELECT event_id AS id, count(*) OVER w AS ready, {sq("(coalesce(sum(y) OVER w, 0) + 10 * 0.035) / (count(*) OVER w + 10)", 8)} AS target_enc FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {LAG_S * MICROS} PRECEDING)"""


@query("label_in_row_stream", f"WITH {EV} {_ENCODED}")
def _(spark, d):
    out = sources.run_append(state.stream_label_encoding(_event_stream(spark, d), 0.035, LAG_S), "labels")
    return rounded(out.select("id", "ready", "target_enc"), target_enc=8)


@query("label_promotion", f"WITH {EV} {_ENCODED}")
def _(spark, d):
    """Labels come k hours after their transactions, every seventh one twice, and in two triggers dealt by neither time nor entity."""
    base = scratch_path(spark, "promotion")
    e = events(spark, d).select("event_id", "user_id", "t", "y", "k")
    known = F.col("t") + F.col("k") * 3_600_000_000
    again = F.explode(F.when(F.col("event_id") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    feed = e.withColumn("known", known).withColumn("_again", again).drop("k", "_again")
    # What ends a stream moves the watermark past all rows.
    end = e.agg(F.max("t").alias("t")).select(
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), (F.col("t") + 400 * 86_400 * MICROS).alias("t"))
    out, offsets = os.path.join(base, "out"), os.path.join(base, "offsets")
    deals = [(e.where(F.col("event_id") % 2 == i), feed.where(F.col("event_id") % 5 % 2 == i)) for i in range(2)]
    for tx, labels_ in [*deals, (end, end.select("*", F.lit(0).alias("y"), F.col("t").alias("known")))]:
        tx.select("event_id", "user_id", "t").write.mode("append").parquet(os.path.join(base, "tx"))
        labels_.select("event_id", "user_id", "t", "y", "known").write.mode("append").parquet(os.path.join(base, "feed"))
        both = [sources.stream_transactions(spark, "parquet", os.path.join(base, n), spark.read.parquet(os.path.join(base, n)).schema) for n in ("tx", "feed")]
        sources.run_append_to(labels.promoted_label_encoding(*both, 0.035, LAG_S, delay="365 days", slice_s=LAG_S), out, offsets, store=sources.ROCKSDB)
    return rounded(spark.read.parquet(out).where("id IS NOT NULL").select("id", "ready", "target_enc"), target_enc=8)
