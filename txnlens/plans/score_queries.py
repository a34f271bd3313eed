"""Queries over score tables: curves, thresholds, money, blends, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlens.functions import rowwise
from txnlens.operators import business, curves, ensemble, explain
from txnlens.plans.catalog import CURVE, EV, SPLIT, events, grid_sql, query, rounded, split_events, sq
from txnlens.plans.reports import eval_battery, score_export
from txnlens.session import cut_lineage

GRID = rowwise.log_grid_values()
GRID_SQL = f"gr AS (SELECT * FROM {grid_sql(GRID)} g(i, threshold))"
T = 0.45
SCORES = ["p1", "p2", "p3"]


def _curve_sql(src="ev"):
    return f"cv AS ({CURVE.format(src=src)})"


PRC = "pr AS (SELECT p AS threshold, tp, fp, pos, n_pos, n_neg, tp / (tp + fp) AS pre, tp / n_pos AS rec FROM cv)"


@query("log_grid", f"""WITH {EV}, {GRID_SQL}, b AS (SELECT CAST((SELECT max(i) FROM gr WHERE threshold <= ev.p) AS INTEGER) AS i FROM ev)
SELECT gr.threshold, count(b.i) AS n FROM gr LEFT JOIN b USING (i) GROUP BY 1""")
def _(spark, d):
    at = curves.sweep_counts(events(spark, d), GRID).select("threshold", (F.col("tp") + F.col("fp")).alias("reach"))
    # The grid has 200 rows, so its ordering is bounded.
    from pyspark.sql import Window
    following = F.lead("reach", 1, 0).over(Window.orderBy("threshold"))
    return at.select("threshold", (F.col("reach") - following).alias("n"))


@query("confusion", f"""WITH {EV}, c AS (SELECT count(*) FILTER (p >= {T} AND y = 1) tp, count(*) FILTER (p < {T} AND y = 0) tn, count(*) FILTER (p >= {T} AND y = 0) fp, count(*) FILTER (p < {T} AND y = 1) fn FROM ev),
r AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c)
SELECT tp, tn, fp, fn, {sq("precision", 8)} AS precision, {sq("recall", 8)} AS recall, {sq("2 * precision * recall / (precision + recall)", 8)} AS f1, {sq("(tp + tn) / (tp + tn + fp + fn)", 8)} AS accuracy FROM r""")
def _(spark, d):
    return rounded(curves.confusion(events(spark, d), T), precision=8, recall=8, f1=8, accuracy=8)


@query("classification_report", f"""WITH {EV}, c AS (SELECT count(*) FILTER (p >= {T} AND y = 1) tp, count(*) FILTER (p < {T} AND y = 0) tn, count(*) FILTER (p >= {T} AND y = 0) fp, count(*) FILTER (p < {T} AND y = 1) fn FROM ev),
k AS (SELECT '1' AS class, tp / (tp + fp) AS a, tp / (tp + fn) AS b, tp + fn AS s FROM c UNION ALL SELECT '0', tn / (tn + fn), tn / (tn + fp), tn + fp FROM c),
f AS (SELECT *, 2 * a * b / (a + b) AS f FROM k),
al AS (SELECT * FROM f UNION ALL SELECT 'macro', avg(a), avg(b), CAST(sum(s) AS BIGINT), avg(f) FROM f UNION ALL SELECT 'weighted', sum(a * s) / sum(s), sum(b * s) / sum(s), CAST(sum(s) AS BIGINT), sum(f * s) / sum(s) FROM f)
SELECT class, {sq("a", 8)} AS precision, {sq("b", 8)} AS recall, {sq("f", 8)} AS f1, s AS support FROM al""")
def _(spark, d):
    return rounded(curves.class_report(events(spark, d), T), precision=8, recall=8, f1=8)


@query("confusion_normalized", f"""WITH {EV} SELECT y AS actual, CAST(p >= {T} AS INTEGER) AS predicted, count(*) AS n, {sq("count(*) / sum(count(*)) OVER (PARTITION BY y)", 8)} AS share FROM ev GROUP BY 1, 2""")
def _(spark, d):
    return rounded(curves.confusion_matrix(events(spark, d), T), share=8)


@query("brier", f"WITH {EV} SELECT event_type, {sq('avg((p - y) * (p - y))', 8)} AS brier FROM ev GROUP BY 1")
def _(spark, d):
    return rounded(curves.brier(events(spark, d), by=["event_type"]), brier=8)


@query("reliability", f"""WITH {EV} SELECT CAST(greatest(ceil(p * 10) - 1, 0) AS INTEGER) AS bin, count(*) AS n, {sq("avg(p)", 8)} AS mean_score, {sq("avg(y)", 8)} AS positive_rate FROM ev GROUP BY 1""")
def _(spark, d):
    return rounded(curves.reliability_bins(events(spark, d)), mean_score=8, positive_rate=8)


HB = "CASE WHEN (t // 3600000000) % 24 < 6 THEN 'night' WHEN (t // 3600000000) % 24 < 12 THEN 'morning' WHEN (t // 3600000000) % 24 < 18 THEN 'afternoon' ELSE 'evening' END"


@query("slice_metrics", f"""WITH {EV}, s AS (SELECT y, p, 'event_type' AS dimension, event_type AS slice FROM ev UNION ALL SELECT y, p, 'user_id', CAST(user_id AS VARCHAR) FROM ev
  UNION ALL SELECT y, p, 'hours', {HB} FROM ev),
g AS (SELECT dimension, slice, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp FROM g WINDOW w AS (PARTITION BY dimension, slice ORDER BY p DESC)),
a AS (SELECT dimension, slice, CAST(sum(pos + neg) AS BIGINT) AS n, sum(pos) AS np, sum(neg) AS nn, sum(pos * ctp / (ctp + cfp)) AS ap,
  CAST(coalesce(sum(pos) FILTER (p >= {T}), 0) AS BIGINT) AS tp, CAST(coalesce(sum(neg) FILTER (p < {T}), 0) AS BIGINT) AS tn,
  CAST(coalesce(sum(neg) FILTER (p >= {T}), 0) AS BIGINT) AS fp, CAST(coalesce(sum(pos) FILTER (p < {T}), 0) AS BIGINT) AS fn FROM c GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pre, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rec FROM a)
SELECT dimension, slice, n, {sq("np / n", 8)} AS fraud_rate, {sq("CASE WHEN np > 0 AND nn > 0 THEN ap / np END", 8)} AS ap, tp, tn, fp, fn, {sq("pre", 8)} AS precision, {sq("rec", 8)} AS recall,
  {sq("CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END", 8)} AS f1, {sq("(tp + tn) / n", 8)} AS accuracy, CAST(n >= 30 AS INTEGER) AS reliable FROM r""")
def _(spark, d):
    e = rowwise.temporal_features(events(spark, d)).withColumn("hours", rowwise.hour_bucket(F.col("hour_of_day")))
    out = curves.slice_metrics(e, ["event_type", "user_id", "hours"], T)
    return rounded(out, fraud_rate=8, ap=8, precision=8, recall=8, f1=8, accuracy=8)


@query("pr_curve", f"WITH {EV}, {_curve_sql()}, {PRC} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {sq('pre', 8)} AS precision, {sq('rec', 8)} AS recall FROM pr")
def _(spark, d):
    return rounded(curves.pr_curve(events(spark, d)), precision=8, recall=8)


@query("average_precision", f"WITH {EV}, {_curve_sql()}, {PRC} SELECT {sq('sum(pos * pre) / max(n_pos)', 8)} AS ap FROM pr")
def _(spark, d):
    return rounded(curves.average_precision(events(spark, d)), ap=8)


AUC = "1 - sum(pos * (fp - neg / 2)) / (max(n_pos) * max(n_neg))"


@query("roc_auc", f"""WITH {EV}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM ev)
SELECT {sq("(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))", 8)} AS auc FROM r""")
def _(spark, d):
    return rounded(curves.roc_auc(events(spark, d)), auc=8)


@query("roc_curve", f"WITH {EV}, {_curve_sql()} SELECT p AS threshold, {sq('fp / n_neg', 8)} AS fpr, {sq('tp / n_pos', 8)} AS tpr FROM cv")
def _(spark, d):
    return rounded(curves.roc_curve(events(spark, d)), fpr=8, tpr=8)


def _sweep_sql(src="ev"):
    return f"""{GRID_SQL}, sw AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp,
      count(*) FILTER (p < threshold AND y = 1) AS fn, count(*) FILTER (p < threshold AND y = 0) AS tn FROM {src} CROSS JOIN gr GROUP BY 1)"""


@query("threshold_sweep", f"""WITH {EV}, {_sweep_sql()}, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pre, tp / (tp + fn) AS rec FROM sw)
SELECT threshold, tp, fp, fn, tn, {sq("pre", 8)} AS precision, {sq("rec", 8)} AS recall, {sq("CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END", 8)} AS f1,
  {sq("(tp + tn) / (tp + tn + fp + fn)", 8)} AS accuracy FROM r""")
def _(spark, d):
    return rounded(curves.threshold_sweep(events(spark, d)), precision=8, recall=8, f1=8, accuracy=8)


VALUE_SQL = "tp * 480.0::DOUBLE - fp * 5.0 - fn * 500.0"


@query("optimal_threshold", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {_sweep_sql('v')}
SELECT threshold, {VALUE_SQL} AS value FROM sw ORDER BY value DESC, threshold LIMIT 1""")
def _(spark, d):
    return business.optimal_threshold(split_events(spark, d).where("split = 'val'"))


@query("argmax", f"""WITH {EV}, {_sweep_sql('e2').replace('gr AS', 'e2 AS (SELECT * FROM ev), gr AS', 1)}, b AS (SELECT threshold, tp - fp / 100 AS v FROM sw)
SELECT threshold, {sq("v", 6)} AS value FROM b ORDER BY v DESC, threshold LIMIT 1""")
def _(spark, d):
    sweep = curves.sweep_counts(events(spark, d))
    return rounded(curves.best_threshold(sweep, F.col("tp") - F.col("fp") / 100), value=6)


F1 = "CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END"


@query("f1_threshold", f"WITH {EV}, {_curve_sql()}, {PRC}, f AS (SELECT threshold, {F1} AS f FROM pr) SELECT threshold, {sq('f', 8)} AS f1 FROM f ORDER BY f DESC, threshold LIMIT 1")
def _(spark, d):
    return rounded(curves.f1_threshold(events(spark, d)), f1=8)


@query("threshold_at_fpr", f"WITH {EV}, {_curve_sql()} SELECT p AS threshold, {sq('fp / n_neg', 8)} AS fpr, {sq('tp / n_pos', 8)} AS tpr FROM cv WHERE fp / n_neg <= 0.05 ORDER BY p LIMIT 1")
def _(spark, d):
    return rounded(curves.threshold_at_fpr(events(spark, d)), fpr=8, tpr=8)


@query("precision_at_recall", f"""WITH {EV}, {_curve_sql()}, {PRC}, f AS (SELECT unnest([0.7, 0.8, 0.9])::DOUBLE AS floor),
b AS (SELECT floor, threshold, pre, rec FROM f JOIN pr ON rec >= floor QUALIFY row_number() OVER (PARTITION BY floor ORDER BY threshold DESC) = 1)
SELECT floor, threshold, {sq("pre", 8)} AS precision, {sq("rec", 8)} AS achieved_recall, {sq(F1, 8)} AS f1 FROM b""")
def _(spark, d):
    return rounded(curves.precision_at_recall(events(spark, d), [0.7, 0.8, 0.9]), precision=8, achieved_recall=8, f1=8)


AP_BY = """{name} AS (SELECT {by}, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT {by}, p, sum({w} * y) AS pos, sum({w} * (1 - y)) AS neg FROM {src} GROUP BY {by}, p)
  WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)) GROUP BY {by})"""


def ap_by(name, by, src, w="1"):
    return AP_BY.format(name=name, by=by, src=src, w=w)


@query("overfit_gap", f"""WITH {SPLIT}, {ap_by("a", "split", "sp")}, x AS (SELECT max(ap) FILTER (split = 'train') tr, max(ap) FILTER (split = 'val') va, max(ap) FILTER (split = 'test') te FROM a)
SELECT {sq("tr", 8)} AS train_ap, {sq("va", 8)} AS val_ap, {sq("te", 8)} AS test_ap, {sq("tr - va", 8)} AS val_gap, {sq("tr - te", 8)} AS test_gap,
  CAST(tr - va > 0.1 AS INTEGER) AS warn, CAST(tr - va > 0.15 AS INTEGER) AS fail FROM x""")
def _(spark, d):
    return rounded(curves.overfit_gap(split_events(spark, d)), train_ap=8, val_ap=8, test_ap=8, val_gap=8, test_gap=8)


LONG = "lg AS (SELECT y, unnest(['p1', 'p2', 'p3']) AS model, unnest([p1, p2, p3]) AS p FROM ev)"


@query("compare_models", f"""WITH {EV}, {LONG}, g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM lg GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
f AS (SELECT *, tp / (tp + fp) AS pre, tp / np AS rec FROM c),
b AS (SELECT model, p AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(nn - fp AS BIGINT) AS tn, CAST(np - tp AS BIGINT) AS fn, pre, rec FROM f QUALIFY row_number() OVER (PARTITION BY model ORDER BY {F1} DESC, p) = 1),
a AS (SELECT model, sum(pos * tp / (tp + fp)) / max(np) AS ap, 1 - sum(pos * (fp - neg / 2)) / (max(np) * max(nn)) AS auc FROM c GROUP BY 1)
SELECT model, {sq("ap", 8)} AS ap, {sq("auc", 8)} AS auc, threshold, tp, fp, tn, fn, {sq("pre", 8)} AS precision, {sq("rec", 8)} AS recall, {sq(F1, 8)} AS f1,
  {sq("(tp + tn) / (tp + tn + fp + fn)", 8)} AS accuracy, CAST(ap = max(ap) OVER () AS INTEGER) AS is_best FROM a JOIN b USING (model)""")
def _(spark, d):
    return rounded(curves.compare_models(events(spark, d), SCORES), ap=8, auc=8, precision=8, recall=8, f1=8, accuracy=8)


# ---------------------------------------------------------------- money

VOL = "vo AS (SELECT count(*) AS n, ceil((max(t) - min(t)) / 1e6 / 86400) AS span_days, avg(y) AS fraud_rate, count(*) / greatest(ceil((max(t) - min(t)) / 1e6 / 86400), 1) * 365 AS annual FROM ev)"


@query("volume", f"WITH {EV}, {VOL} SELECT n, CAST(span_days AS BIGINT) AS span_days, {sq('fraud_rate', 8)} AS fraud_rate, {sq('annual', 2)} AS annual_transactions, {sq('annual * fraud_rate', 2)} AS annual_fraud FROM vo")
def _(spark, d):
    return rounded(business.annual_volume(events(spark, d)), fraud_rate=8, annual_transactions=2, annual_fraud=2)


IMPACT = """im0 AS (SELECT *, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, annual * (tp + fn) / (tp + fn + fp + tn) AS fraud FROM {src}, vo),
im1 AS (SELECT *, fraud * recall AS atp, fraud * (1 - recall) AS afn, (annual - fraud) * fpr AS afp FROM im0),
im AS (SELECT *, atp * 480 AS gross, CASE WHEN convention = 'prd' THEN afn * 500 ELSE 0 END AS fnl, afp * 5 AS fpc, CASE WHEN convention = 'prd' THEN -fraud * 500 ELSE 0 END AS naive
  FROM im1, (VALUES ('prd'), ('net_of_principal')) c(convention))"""
IM_COLS = (f"threshold, convention, tp, fp, fn, tn, {sq('recall', 8)} AS recall, {sq('fpr', 8)} AS fpr, {sq('precision', 8)} AS precision, {sq('annual', 2)} AS annual_transactions, "
           f"{sq('gross', 2)} AS gross_benefit, {sq('fnl', 2)} AS false_negative_loss, {sq('fpc', 2)} AS false_positive_cost, {sq('gross - fnl - fpc', 2)} AS net_value, "
           f"{sq('gross - fnl - fpc - naive', 2)} AS improvement")


def _impact_out(df):
    out = df.select("threshold", "convention", "tp", "fp", "fn", "tn", "recall", "fpr", "precision", "annual_transactions", "gross_benefit",
                    "false_negative_loss", "false_positive_cost", "net_value", "improvement")
    return rounded(out, recall=8, fpr=8, precision=8, annual_transactions=2, gross_benefit=2, false_negative_loss=2,
                   false_positive_cost=2, net_value=2, improvement=2)


ONE = f"""on1 AS (SELECT {T}::DOUBLE AS threshold, count(*) FILTER (p >= {T} AND y = 1) tp, count(*) FILTER (p < {T} AND y = 0) tn, count(*) FILTER (p >= {T} AND y = 0) fp, count(*) FILTER (p < {T} AND y = 1) fn FROM ev)"""


@query("impact", f"WITH {EV}, {VOL}, {ONE}, {IMPACT.format(src='on1')} SELECT {IM_COLS} FROM im")
def _(spark, d):
    e = events(spark, d)
    return _impact_out(business.impact(e, T, volume=business.annual_volume(e)))


@query("impact_sweep", f"WITH {EV}, {VOL}, {_sweep_sql()}, {IMPACT.format(src='sw')} SELECT {IM_COLS} FROM im")
def _(spark, d):
    e = events(spark, d)
    return _impact_out(business.impact_sweep(e, volume=business.annual_volume(e)))


CHOSEN = [GRID[i] for i in (60, 120, 180)]
CHOSEN_SQL = ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in CHOSEN)


@query("impact_table", f"""WITH {EV}, {VOL}, {_sweep_sql()}, {IMPACT.format(src='sw')}, pk AS (SELECT *, gross - fnl - fpc AS net, max(gross - fnl - fpc) OVER (PARTITION BY convention) AS peak FROM im)
SELECT convention, threshold, {sq("net", 2)} AS net_value, {sq("net / peak", 6)} AS share_of_peak FROM pk WHERE threshold IN ({CHOSEN_SQL})""")
def _(spark, d):
    e = events(spark, d)
    sweep = business.impact_sweep(e, volume=business.annual_volume(e))
    out = business.impact_table(sweep, CHOSEN).select("convention", "threshold", "net_value", "share_of_peak")
    return rounded(out, net_value=2, share_of_peak=6)


@query("pnl", f"""WITH {EV}, {VOL}, {ONE}, {IMPACT.format(src='on1')}
SELECT convention, unnest(['gross', 'missed_fraud', 'false_alarms', 'net']) AS line, unnest([{sq("gross", 2)}, {sq("-fnl", 2)}, {sq("-fpc", 2)}, {sq("gross - fnl - fpc", 2)}]) AS amount FROM im""")
def _(spark, d):
    e = events(spark, d)
    return rounded(business.pnl(business.impact(e, T, volume=business.annual_volume(e))), amount=2)


@query("convention_delta", f"""WITH {EV}, {VOL}, {_sweep_sql()}, {IMPACT.format(src='sw')},
b AS (SELECT convention, threshold, recall, afp FROM im QUALIFY row_number() OVER (PARTITION BY convention ORDER BY gross - fnl - fpc DESC, threshold) = 1)
SELECT a.threshold AS prd_threshold, n.threshold AS net_threshold, {sq("a.recall - n.recall", 8)} AS recall_delta, {sq("a.afp - n.afp", 2)} AS fp_delta
FROM b a, b n WHERE a.convention = 'prd' AND n.convention = 'net_of_principal'""")
def _(spark, d):
    e = events(spark, d)
    return rounded(business.convention_delta(business.impact_sweep(e, volume=business.annual_volume(e))), recall_delta=8, fp_delta=2)


# ---------------------------------------------------------------- blends

FULL = {"p1": 0.5, "p2": 0.3, "p3": 0.2}
TWO = {"p1": 0.7, "p3": 0.3}


@query("blend", f"WITH {EV} SELECT event_id, p AS blended FROM ev")
def _(spark, d):
    return ensemble.checked_blend(events(spark, d), FULL, SCORES, "blended").select("event_id", "blended")


@query("mode_fallback", f"""WITH {EV}, x AS (SELECT *, CASE WHEN k % 10 <> 0 THEN p2 END AS m2, CASE WHEN k <> 50 THEN p1 END AS m1 FROM ev),
z AS (SELECT *, CASE WHEN m1 IS NULL THEN 'failed' WHEN m2 IS NULL THEN 'fallback' ELSE 'full' END AS mode,
  CASE WHEN m1 IS NULL THEN NULL WHEN m2 IS NULL THEN 0.7::DOUBLE * m1 + 0.3::DOUBLE * p3 ELSE 0.5::DOUBLE * m1 + 0.3::DOUBLE * m2 + 0.2::DOUBLE * p3 END AS b FROM x)
SELECT event_id, mode, b AS p, CASE WHEN b IS NULL THEN NULL WHEN b >= CASE WHEN mode = 'full' THEN 0.45 ELSE 0.3 END THEN 'FRAUD' ELSE 'LEGITIMATE' END AS decision FROM z""")
def _(spark, d):
    e = events(spark, d).withColumns({"m2": F.expr("CASE WHEN k % 10 <> 0 THEN p2 END"), "m1": F.expr("CASE WHEN k <> 50 THEN p1 END")})
    full, two = {"m1": 0.5, "m2": 0.3, "p3": 0.2}, {"m1": 0.7, "p3": 0.3}
    return ensemble.score_with_fallback(e.drop("p"), full, two, 0.45, 0.3).select("event_id", "mode", "p", "decision")


# One mode per event type, its "models" being the hours and their weights the hourly shares; every third mode is
# scaled so that it breaks the rule.
@query("spec_check", f"""WITH {EV}, m AS (SELECT event_type AS mode, (t // 3600000000) % 24 AS model, count(*) AS c, avg(p) AS threshold FROM ev GROUP BY 1, 2),
w AS (SELECT mode, model, c / sum(c) OVER (PARTITION BY mode) * CASE WHEN mode = 'view' THEN 1.1 ELSE 1 END AS weight, threshold FROM m)
SELECT mode, {sq("sum(weight)", 6)} AS total, count(*) AS n, count(DISTINCT model) AS models, CAST(abs(sum(weight) - 1) > 1e-6 AS INTEGER) AS violation FROM w GROUP BY 1""")
def _(spark, d):
    from pyspark.sql import Window
    e = rowwise.temporal_features(events(spark, d))
    m = e.groupBy(F.col("event_type").alias("mode"), F.col("hour_of_day").alias("model")).agg(
        F.count(F.lit(1)).alias("c"), F.avg("p").alias("threshold"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("mode"))
    w = m.withColumn("weight", share * F.when(F.col("mode") == "view", 1.1).otherwise(1.0))
    return rounded(ensemble.mode_violations(w).select("mode", "total", "n", "models", "violation"), total=6)


GRID20 = "sg AS (SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INTEGER) AS point, i / {n} AS w1, j / {n} AS w2, greatest(0, 1 - (i / {n} + j / {n})) AS w3 FROM range({m}) a(i), range({m}) b(j) WHERE i + j <= {n})"


@query("simplex_grid", f"""WITH {EV}, {GRID20.format(n=20, m=21)}, m AS (SELECT avg(p1) a, avg(p2) b, avg(p3) c FROM ev)
SELECT point, {sq("w1", 6)} AS w1, {sq("w2", 6)} AS w2, {sq("w3", 6)} AS w3, {sq("w1 * a + w2 * b + w3 * c", 6)} AS mean_score FROM sg, m""")
def _(spark, d):
    means = events(spark, d).agg(*[F.avg(s).alias(s) for s in SCORES])
    grid = ensemble.simplex_grid(spark, SCORES, 0.05)
    value = sum((F.col(f"w_{s}") * means.select(s).scalar() for s in SCORES[1:]), F.col("w_p1") * means.select("p1").scalar())
    out = grid.select("point", F.col("w_p1").alias("w1"), F.col("w_p2").alias("w2"), F.col("w_p3").alias("w3"), value.alias("mean_score"))
    return rounded(out, w1=6, w2=6, w3=6, mean_score=6)


def _search_sql(n, src, w="1", by=""):
    return f"""{GRID20.format(n=n, m=n + 1)}, bl AS (SELECT {by + ', ' if by else ''}point, y, {w} AS wt, w1 * p1 + w2 * p2 + w3 * p3 AS p FROM {src}, sg),
    {ap_by("aps", (by + ", " if by else "") + "point", "bl", "wt")}"""


# Sums in another order differ in the last digits, so equal precisions are told apart by the point on both sides.
_FIRST_BEST = "ORDER BY round(ap, 10) DESC, point LIMIT 1"
_FOUND = f"{sq('w1', 6)} AS w_p1, {sq('w2', 6)} AS w_p2, {sq('w3', 6)} AS w_p3, {sq('ap', 8)} AS ap"


def _weights_rounded(df):
    return rounded(df.select(*[f"w_{m}" for m in SCORES], "ap"), ap=8, **{f"w_{m}": 6 for m in SCORES})


@query("weight_search", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {_search_sql(50, 'v')}
SELECT {_FOUND} FROM (SELECT * FROM aps JOIN sg USING (point) {_FIRST_BEST})""")
def _(spark, d):
    return _weights_rounded(ensemble.search_coarse(split_events(spark, d).where("split = 'val'"), SCORES, 0.02))


def _axis_sql(w):
    low, high = f"greatest(0.0::DOUBLE, {w} - 0.02::DOUBLE)", f"least(1.0::DOUBLE, {w} + 0.02::DOUBLE)"
    return f"CASE WHEN i < 20 THEN {low} + ({high} - {low}) * i / 20 ELSE {high} END"


@query("weight_search_refined", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {_search_sql(50, 'v')},
won AS (SELECT w1, w2, w3 FROM aps JOIN sg USING (point) {_FIRST_BEST}),
x AS (SELECT i, {_axis_sql('w1')} AS w1 FROM won, range(21) r(i)), z AS (SELECT i AS j, {_axis_sql('w2')} AS w2 FROM won, range(21) r(i)),
fine AS (SELECT i * 21 + j AS point, w1, w2, greatest(0, 1 - (w1 + w2)) AS w3 FROM x, z WHERE w1 + w2 <= 1 + 1e-9 UNION ALL SELECT 441, * FROM won),
fb AS (SELECT point, y, w1 * p1 + w2 * p2 + w3 * p3 AS p FROM v, fine), {ap_by("fa", "point", "fb")}
SELECT {_FOUND} FROM (SELECT * FROM fa JOIN fine USING (point) {_FIRST_BEST})""")
def _(spark, d):
    return _weights_rounded(ensemble.search_weights(split_events(spark, d).where("split = 'val'"), SCORES))


BOOT = """bs AS (SELECT v.*, b, list_sum([CAST(u >= c AS BIGINT) FOR c IN {cuts}]) AS w FROM (
  SELECT v.*, b.b, CAST('0x' || substr(md5(event_id || ':' || b.b), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM v, range(50) b(b)) v)"""
CUTS_SQL = "[" + ", ".join(f"CAST('{c!r}' AS DOUBLE)" for c in ensemble.POISSON_CUTS) + "]"


@query("bootstrap_samples", f"WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {BOOT.format(cuts=CUTS_SQL)} SELECT event_id, CAST(b AS INTEGER) AS b, CAST(w AS BIGINT) AS w FROM bs WHERE w > 0")
def _(spark, d):
    val = split_events(spark, d).where("split = 'val'")
    return ensemble.bootstrap_samples(val, SCORES, "event_id").select("event_id", "b", "w")


@query("bootstrap_ap", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {BOOT.format(cuts=CUTS_SQL)}, bw AS (SELECT * FROM bs WHERE w > 0),
{_search_sql(20, "bw", "w", "b")} SELECT CAST(b AS INTEGER) AS b, {sq("max(ap)", 8)} AS best_ap FROM aps GROUP BY 1""")
def _(spark, d):
    best = ensemble.bootstrap_best(split_events(spark, d).where("split = 'val'"), SCORES, "event_id")
    return rounded(best.select("b", F.col("ap").alias("best_ap")), best_ap=8)


@query("bootstrap_weights", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {BOOT.format(cuts=CUTS_SQL)}, bw AS (SELECT * FROM bs WHERE w > 0),
{_search_sql(20, "bw", "w", "b")}, best AS (SELECT b, arg_max(point, (round(ap, 10), -point)) AS point FROM aps GROUP BY 1),
l AS (SELECT unnest(['p1', 'p2', 'p3']) AS model, unnest([w1, w2, w3]) AS w FROM best JOIN sg USING (point))
SELECT model, {sq("avg(w)", 6)} AS mean, {sq("stddev_pop(w)", 6)} AS std, {sq("quantile_cont(w, 0.05)", 6)} AS p05, {sq("quantile_cont(w, 0.95)", 6)} AS p95 FROM l GROUP BY 1""")
def _(spark, d):
    out = ensemble.bootstrap_weights(split_events(spark, d).where("split = 'val'"), SCORES, "event_id")
    return rounded(out, mean=6, std=6, p05=6, p95=6)


# The gate compares the refined searches, as the ensemble evaluation does; for two models the coarse one is a line of the grid.
@query("min_lift_gate", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {_search_sql(50, 'v')},
g AS (SELECT max(ap) AS a, max(ap) FILTER (point IN (SELECT point FROM sg WHERE w2 = 0)) AS b FROM aps)
SELECT {sq("a", 8)} AS ap_with, {sq("b", 8)} AS ap_without, {sq("a - b", 8)} AS lift, CAST(a - b >= 0.005 AS INTEGER) AS keep FROM g""")
def _(spark, d):
    val = cut_lineage(split_events(spark, d).where("split = 'val'").select("y", *SCORES))
    out = ensemble.min_lift_gate(ensemble.search_coarse(val, SCORES), ensemble.search_coarse(val, ["p1", "p3"]))
    return rounded(out, ap_with=8, ap_without=8, lift=8)


@query("weight_curve", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), bl AS (SELECT i / 100 AS weight, y, (i / 100) * p1 + (1 - i / 100) * p2 AS p FROM v, range(101) r(i)),
{ap_by("aps", "weight", "bl")} SELECT {sq("weight", 6)} AS weight, {sq("ap", 8)} AS ap FROM aps""")
def _(spark, d):
    val = split_events(spark, d).where("split = 'val'")
    return rounded(ensemble.weight_curve(val, "p1", "p2"), weight=6, ap=8)


@query("mode_spec", f"""WITH {SPLIT}, v AS (SELECT y, 'full' AS mode, 0.5::DOUBLE * p1 + 0.3::DOUBLE * p2 + 0.2::DOUBLE * p3 AS p FROM sp WHERE split = 'val'
  UNION ALL SELECT y, 'no_p2', 0.7::DOUBLE * p1 + 0.3::DOUBLE * p3 FROM sp WHERE split = 'val'), {GRID_SQL},
s AS (SELECT mode, threshold, count(*) FILTER (p >= threshold AND y = 1) * 480 - count(*) FILTER (p >= threshold AND y = 0) * 5 AS value FROM v, gr GROUP BY 1, 2),
b AS (SELECT mode, threshold FROM s QUALIFY row_number() OVER (PARTITION BY mode ORDER BY value DESC, threshold) = 1)
SELECT mode, model, weight::DOUBLE AS weight, threshold FROM b JOIN (VALUES ('full', 'p1', 0.5), ('full', 'p2', 0.3), ('full', 'p3', 0.2), ('no_p2', 'p1', 0.7), ('no_p2', 'p3', 0.3)) w(mode, model, weight) USING (mode)""")
def _(spark, d):
    val = split_events(spark, d).where("split = 'val'")
    return ensemble.mode_spec(val, {"full": FULL, "no_p2": TWO}).select("mode", "model", "weight", "threshold")


def _set_sql(name, models, keep):
    """The best point of the grid that uses only some models, with its precision on test rows."""
    label = " || ';' || ".join(f"printf('{m}=%.4f', w{m[1]})" for m in models)
    return f"""SELECT '{name}' AS model_set, {label} AS weights, {sq('ap', 8)} AS val_ap, (SELECT {sq('ap', 8)} FROM ta WHERE ta.point = b.point) AS test_ap
    FROM (SELECT * FROM aps JOIN sg USING (point) WHERE {keep} ORDER BY round(ap, 10) DESC, {'point' if 'p1' in models else 'w2'} LIMIT 1) b"""


@query("compare_ensembles", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {_search_sql(50, 'v')},
tb AS (SELECT point, y, w1 * p1 + w2 * p2 + w3 * p3 AS p FROM sp, sg WHERE split = 'test'), {ap_by("ta", "point", "tb")}
{_set_sql("p1+p2", ["p1", "p2"], "w3 = 0")} UNION ALL {_set_sql("p1+p3", ["p1", "p3"], "w2 = 0")} UNION ALL {_set_sql("all", SCORES, "TRUE")}""")
def _(spark, d):
    e = split_events(spark, d)
    out = ensemble.compare_ensembles(
        e.where("split = 'val'"), e.where("split = 'test'"), {"p1+p2": ["p1", "p2"], "p1+p3": ["p1", "p3"], "all": SCORES}, 0.02)
    return rounded(out, val_ap=8, test_ap=8)


@query("score_export", f"WITH {SPLIT} SELECT event_id, split, y, p AS blended FROM sp WHERE split <> 'train'")
def _(spark, d):
    return score_export(split_events(spark, d), FULL).select("event_id", "split", "y", "blended")


@query("eval_battery", f"""WITH {SPLIT}, v AS (SELECT * FROM sp WHERE split = 'val'), {_sweep_sql('v')}, te AS (SELECT * FROM sp WHERE split = 'test'),
rt AS (SELECT threshold FROM sw ORDER BY {VALUE_SQL} DESC, threshold LIMIT 1), {_curve_sql('te')}, {PRC},
a AS (SELECT sum(pos * pre) / max(n_pos) AS ap, CAST(max(n_pos) AS BIGINT) AS n_pos FROM pr), u AS (SELECT {AUC} AS auc FROM cv),
c AS (SELECT count(*) AS n, count(*) FILTER (p >= {T} AND y = 1) tp, count(*) FILTER (p >= {T} AND y = 0) fp,
  count(*) FILTER (p >= threshold AND y = 1) rtp, count(*) FILTER (p >= threshold AND y = 0) rfp FROM te, rt),
par AS (SELECT max(pre) FILTER (r = 1) AS p80 FROM (SELECT pre, row_number() OVER (ORDER BY threshold DESC) AS r FROM pr WHERE rec >= 0.8))
SELECT c.n, n_pos, {sq("ap", 8)} AS ap, {sq("auc", 8)} AS auc, {T}::DOUBLE AS deployed_threshold, threshold AS rederived_threshold, tp, fp, rtp AS rederived_tp, rfp AS rederived_fp,
  {sq("p80", 8)} AS precision_at_80, CAST(tp / (tp + fp) >= 0.3 AND tp / n_pos >= 0.8 AS INTEGER) AS in_band,
  {sq("tp * 480.0 - (n_pos - tp) * 500.0 - fp * 5.0", 2)} AS value_prd, {sq("tp * 480.0 - fp * 5.0", 2)} AS value_net FROM c, a, u, rt, par""")
def _(spark, d):
    e = split_events(spark, d)
    out = eval_battery(e.where("split = 'val'"), e.where("split = 'test'"), T).select(
        "n", "n_pos", "ap", "auc", "deployed_threshold", "rederived_threshold", "tp", "fp", "rederived_tp", "rederived_fp",
        "precision_at_80", "in_band", "value_prd", "value_net")
    return rounded(out, ap=8, auc=8, precision_at_80=8, value_prd=2, value_net=2)


@query("corr_model_pairs", "WITH " + EV + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sq(f'corr({a}, {b})', 8)} AS corr FROM ev" for a, b in (("p1", "p2"), ("p1", "p3"), ("p2", "p3"))))
def _(spark, d):
    from txnlens.operators.profiles import corr_pairs
    return rounded(corr_pairs(events(spark, d), SCORES), corr=8)


# ---------------------------------------------------------------- explanations

COEF = {"value": 0.02, "k": -0.05, "p2": 1.5}
CONTRIB = "mn AS (SELECT avg(value) a, avg(k) b, avg(p2) c FROM ev), ct AS (SELECT event_id, unnest(['value', 'k', 'p2']) AS feature, unnest([value, k, p2]) AS value, unnest([0.02 * (value - a), -0.05 * (k - b), 1.5 * (p2 - c)]) AS contribution FROM ev, mn)"


def _contributions(spark, d):
    e = events(spark, d)
    return explain.linear_contributions(e, "event_id", COEF, explain.feature_means(e, list(COEF)))


@query("contributions", f"WITH {EV}, {CONTRIB} SELECT event_id, feature, value, {sq('contribution', 6)} AS contribution FROM ct")
def _(spark, d):
    return rounded(_contributions(spark, d), contribution=6)


@query("additivity_check", f"""WITH {EV}, {CONTRIB} SELECT event_id FROM ct JOIN ev USING (event_id), mn GROUP BY event_id, ev.value, k, p2, a, b, c
HAVING abs(0.02 * a - 0.05 * b + 1.5 * c + sum(contribution) - (0.02 * ev.value - 0.05 * k + 1.5 * p2 + CASE WHEN k = 3 THEN 1 ELSE 0 END)) > 0.01""")
def _(spark, d):
    e = events(spark, d)
    means = explain.feature_means(e, list(COEF))
    base = means.select(sum((F.lit(w) * F.col(c) for c, w in COEF.items()), F.lit(0.0)).alias("base"))
    # Rows with k = 3 get a wrong margin on purpose, so the check has something to find.
    margin = explain.margins(e, "event_id", COEF, 0.0).join(e.select("event_id", "k"), "event_id").select(
        "event_id", (F.col("margin") + F.when(F.col("k") == 3, 1.0).otherwise(0.0)).alias("margin"))
    return explain.additivity_violations(_contributions(spark, d), margin, "event_id", base).select("event_id")


@query("topk_abs", f"""WITH {EV}, {CONTRIB}, s AS (SELECT *, CASE WHEN contribution > 0 THEN 'risk' ELSE 'mitigating' END AS direction FROM ct WHERE contribution <> 0),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY event_id, direction ORDER BY abs(contribution) DESC, feature) <= 5)
SELECT event_id, feature, direction, CAST(row_number() OVER (PARTITION BY event_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS position FROM t""")
def _(spark, d):
    return explain.top_contributors(_contributions(spark, d), "event_id").select("event_id", "feature", "direction", "position")


@query("global_importance", f"WITH {EV}, {CONTRIB} SELECT feature, {sq('avg(abs(contribution))', 6)} AS importance FROM ct GROUP BY 1")
def _(spark, d):
    return rounded(explain.global_importance(_contributions(spark, d)), importance=6)


@query("contribution_points", f"""WITH {EV}, {CONTRIB}, ks AS (SELECT event_id FROM ev ORDER BY md5(event_id || ':42'), event_id LIMIT 2000),
x AS (SELECT ct.*, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM ct SEMI JOIN ks USING (event_id))
SELECT event_id, feature, {sq("contribution", 6)} AS contribution, {sq("CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END", 6)} AS scaled FROM x""")
def _(spark, d):
    out = explain.contribution_points(_contributions(spark, d), "event_id").select("event_id", "feature", "contribution", "scaled")
    return rounded(out, contribution=6, scaled=6)


@query("case_pick", f"""WITH {EV}, c AS (SELECT *, CASE WHEN p >= {T} AND y = 1 THEN 'TP' WHEN p < {T} AND y = 1 THEN 'FN' WHEN p >= {T} THEN 'FP' END AS outcome FROM ev)
SELECT outcome, event_id, p FROM c WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY t, event_id) = 1""")
def _(spark, d):
    return explain.example_cases(events(spark, d), "event_id", T, ["t"])


@query("cum_curve", f"WITH {EV} SELECT p, sum(CAST(sum(y) AS BIGINT)) OVER (ORDER BY p DESC)::BIGINT AS tp, sum(CAST(sum(1 - y) AS BIGINT)) OVER (ORDER BY p DESC)::BIGINT AS fp FROM ev GROUP BY p")
def _(spark, d):
    return curves.pr_counts(events(spark, d)).select(F.col("threshold").alias("p"), "tp", "fp")


