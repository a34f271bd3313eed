"""Queries over whole tables: aggregates, splits, encoders, sequences, graph."""

from __future__ import annotations

from functools import reduce


from pyspark.sql import functions as F

from txnlens.functions import rowwise
from txnlens.operators import encoders, graph, isotonic, joins, profiles, resample, sequences, splits, validate, windows
from txnlens.plans.catalog import EV, ORD, SPLIT, W, events, orders, query, rounded, split_events, sq
from txnlens.plans.row_queries import COMBO_SQL, UID_SQL, with_uid
from txnlens.session import cut_lineage
from txnlens.sources.tables import read_table


def _kind(df):
    return df.withColumn("kind", F.expr("nullif(event_type, 'error')"))


# ---------------------------------------------------------------- aggregates


@query("freq_table", f"""WITH {EV}, k AS (SELECT nullif(event_type, 'error') AS kind FROM ev)
SELECT kind, count(*) / (SELECT count(kind) FROM k) AS kind_freq FROM k WHERE kind IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return encoders.frequency(_kind(events(spark, d)), "kind")


@query("cohort_stats", f"""WITH {EV}, {UID_SQL.format(src="ev")}
SELECT uid, count(*) AS uid_count, {sq("CASE WHEN count(*) >= 3 THEN avg(value) END")} AS uid_amt_mean,
  {sq("CASE WHEN count(*) >= 3 THEN stddev_pop(value) END")} AS uid_amt_std, {sq("CASE WHEN count(*) >= 3 THEN avg(age) END")} AS uid_age_mean FROM uid GROUP BY 1""")
def _(spark, d):
    return rounded(encoders.cohort_stats(with_uid(events(spark, d)), "uid", "value", "age"), uid_amt_mean=4, uid_amt_std=4, uid_age_mean=4)


@query("quantile_cut", f"WITH {SPLIT} SELECT {sq('quantile_cont(value, 0.8)', 6)} AS cut FROM sp WHERE split = 'train' AND event_type = 'purchase'")
def _(spark, d):
    return rounded(encoders.fit_quantile(split_events(spark, d).where("split = 'train' AND event_type = 'purchase'"), "value"), cut=6)


@query("global_prior", f"WITH {SPLIT} SELECT {sq('avg(y)', 8)} AS prior FROM sp WHERE split = 'train'")
def _(spark, d):
    return rounded(profiles.fit_prior(split_events(spark, d).where("split = 'train'")), prior=8)


@query("class_weights", f"""WITH {SPLIT}, c AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM sp WHERE split = 'train')
SELECT p AS n_pos, n AS n_neg, n / p AS scale_pos_weight, (p + n) / (2 * n) AS weight_0, (p + n) / (2 * p) AS weight_1 FROM c""")
def _(spark, d):
    return resample.class_weights(split_events(spark, d).where("split = 'train'"))


@query("missing_profile", f"""WITH {EV}, x AS (SELECT nullif(event_type, 'error') a, CASE WHEN k < 30 THEN k END b, CASE WHEN k >= 95 THEN value END c FROM ev),
m AS (SELECT avg(CAST(a IS NULL AS INTEGER)) a, avg(CAST(b IS NULL AS INTEGER)) b, avg(CAST(c IS NULL AS INTEGER)) c FROM x)
SELECT 'M' AS family, 'a' AS "column", {sq("a", 8)} AS null_share FROM m UNION ALL SELECT 'D', 'b', {sq("b", 8)} FROM m UNION ALL SELECT 'D', 'c', {sq("c", 8)} FROM m""")
def _(spark, d):
    x = events(spark, d).select(
        F.expr("nullif(event_type, 'error')").alias("a"), F.expr("CASE WHEN k < 30 THEN k END").alias("b"),
        F.expr("CASE WHEN k >= 95 THEN value END").alias("c"))
    return rounded(profiles.missing_profile(x, {"M": ["a"], "D": ["b", "c"]}), null_share=8)


@query("missing_by_family", f"""WITH {EV}, x AS (SELECT nullif(event_type, 'error') a, CASE WHEN k < 30 THEN k END b, CASE WHEN k >= 95 THEN value END c FROM ev),
m AS (SELECT avg(CAST(a IS NULL AS INTEGER)) a, avg(CAST(b IS NULL AS INTEGER)) b, avg(CAST(c IS NULL AS INTEGER)) c FROM x),
l AS (SELECT 'M' AS family, a AS s FROM m UNION ALL SELECT 'D', b FROM m UNION ALL SELECT 'D', c FROM m)
SELECT family, count(*) AS columns, {sq("avg(s)", 8)} AS null_share, count(*) FILTER (s > 0.5) AS over_50, count(*) FILTER (s > 0.9) AS over_90 FROM l GROUP BY 1""")
def _(spark, d):
    x = events(spark, d).select(
        F.expr("nullif(event_type, 'error')").alias("a"), F.expr("CASE WHEN k < 30 THEN k END").alias("b"),
        F.expr("CASE WHEN k >= 95 THEN value END").alias("c"))
    return rounded(profiles.missing_by_family(profiles.missing_profile(x, {"M": ["a"], "D": ["b", "c"]})), null_share=8)


@query("describe_by", f"""WITH {EV} SELECT y, count(value) AS n, {sq("avg(value)")} AS mean, {sq("stddev_samp(value)")} AS std, min(value) AS min, max(value) AS max,
  {sq("quantile_cont(value, 0.25)", 6)} AS q25, {sq("quantile_cont(value, 0.5)", 6)} AS q50, {sq("quantile_cont(value, 0.75)", 6)} AS q75 FROM ev GROUP BY 1""")
def _(spark, d):
    return rounded(profiles.describe_by(events(spark, d), "y", "value"), mean=4, std=4, q25=6, q50=6, q75=6)


def _rate_sql(keys, src="ev"):
    return f"""SELECT {keys}, count(*) AS n, CAST(sum(y) AS BIGINT) AS frauds, {sq("avg(y)", 8)} AS fraud_rate, {sq("avg(value)")} AS mean_amount,
      {sq(f"count(*) / (SELECT count(*) FROM {src})", 8)} AS share FROM {src} GROUP BY ALL"""


@query("rate_by", f"WITH {EV}, h AS (SELECT *, CAST((t // 3600000000) % 24 AS INTEGER) AS hour_of_day FROM ev) {_rate_sql('hour_of_day, event_type', 'h')}")
def _(spark, d):
    e = rowwise.temporal_features(events(spark, d))
    return rounded(profiles.rate_by(e, ["hour_of_day", "event_type"]), fraud_rate=8, mean_amount=4, share=8)


@query("pivot_rate", f"""WITH {EV}, h AS (SELECT *, CAST((t // 86400000000) % 7 AS INTEGER) AS day_of_week, (t // 3600000000) % 24 AS h FROM ev)
SELECT day_of_week, {", ".join(sq(f"avg(y) FILTER (h = {i})", 8) + f" AS h{i}" for i in range(24))} FROM h GROUP BY 1""")
def _(spark, d):
    e = rowwise.temporal_features(events(spark, d))
    out = profiles.rate_pivot(e, "day_of_week", "hour_of_day", range(24), "h")
    return rounded(out, **{f"h{i}": 8 for i in range(24)})


@query("entity_profile", f"""WITH {EV} SELECT user_id, count(*) AS n, {sq("avg(value)")} AS mean_amount, max(value) AS max_amount, {sq("stddev_samp(value)")} AS std_amount,
  {sq("avg(y)", 8)} AS fraud_rate FROM ev GROUP BY 1 HAVING count(*) >= 5""")
def _(spark, d):
    return rounded(profiles.entity_profile(events(spark, d)), mean_amount=4, std_amount=4, fraud_rate=8)


@query("round_rate", f"WITH {EV} SELECT y, count(*) AS n, {sq('avg(CAST(value % 1.0 = 0 AS INTEGER))', 8)} AS round_rate FROM ev GROUP BY 1")
def _(spark, d):
    return rounded(profiles.round_amount_rate(events(spark, d)), round_rate=8)


@query("histogram", f"""WITH {EV} SELECT y, CAST(greatest(least(floor((value - 0.0) / (300.0::DOUBLE / 50)), 49), 0) AS INTEGER) AS bin, count(*) AS n FROM ev GROUP BY 1, 2""")
def _(spark, d):
    return profiles.histogram(events(spark, d), "value", 0.0, 300.0, 50, "y")


COLS = ["value", "k", "p1", "p2", "p3"]


@query("corr_target", f"""WITH {EV}, c AS (SELECT unnest([{", ".join(f"{{'c': '{c}', 'r': abs((SELECT corr({c}, y) FROM ev))}}" for c in COLS)}], recursive := true))
SELECT c AS "column", {sq("r", 8)} AS abs_corr, CAST(row_number() OVER (ORDER BY r DESC, c) AS INTEGER) AS rank, CAST(r > 0.1 AS INTEGER) AS strong, CAST(r < 0.01 AS INTEGER) AS weak FROM c""")
def _(spark, d):
    return rounded(profiles.corr_with_label(events(spark, d), COLS), abs_corr=8)


PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1:]]


@query("corr_pairs", "WITH " + EV + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sq(f'corr({a}, {b})', 8)} AS corr FROM ev" for a, b in PAIRS))
def _(spark, d):
    return rounded(profiles.corr_pairs(events(spark, d), COLS), corr=8)


@query("corr_pairs_embedding", f"""WITH l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
u AS (SELECT a.i, b.i AS j, abs(corr(a.v, b.v)) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2)
SELECT count(*) AS pairs, count(*) FILTER (r > 0.1) AS redundant, {sq("avg(CAST(r > 0.1 AS INTEGER))", 8)} AS share FROM u""")
def _(spark, d):
    pairs = profiles.corr_block(read_table(spark, d, "embeddings"), "embedding")
    return rounded(profiles.redundant_share(pairs, 0.1), share=8)


@query("op_counters", f"""WITH {EV}, a AS (SELECT *, t + k * 3600000000 AS arrival, row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY t, event_id) AS rep,
    row_number() OVER ({W}) AS rn FROM ev),
s AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT count(*) AS processed, count(*) FILTER (p >= 0.45) AS alerts, count(*) FILTER (k = 99) AS errors, count(*) FILTER (rep > 1) AS duplicates,
  count(*) FILTER (seen > t) AS out_of_order, count(*) FILTER (rn < 10) AS partial_sequences FROM s""")
def _(spark, d):
    e = windows.arrival_flags(events(spark, d).withColumn("arrival", F.expr("t + k * 3600000000")), ["arrival", "event_id"])
    e = windows.prior(e, ["user_id"], ["t", "event_id"], {"seen": ("count", F.lit(1))})
    e = windows.prior(e, ["user_id", "event_type", "value"], ["t", "event_id"], {"rep": ("count", F.lit(1))})
    return profiles.stream_counters(e.withColumns({
        "decision": rowwise.decide(F.col("p"), 0.45), "error": (F.col("k") == 99).cast("int"),
        "duplicate": (F.col("rep") > 0).cast("int"), "partial": (F.col("seen") < 9).cast("int")}))


@query("label_distribution", f"""WITH {EV} SELECT count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos, {sq("avg(y)", 8)} AS fraud_rate,
  count(*) FILTER (y = 0) / count(*) FILTER (y = 1) AS imbalance_ratio FROM ev""")
def _(spark, d):
    return rounded(profiles.label_distribution(events(spark, d)), fraud_rate=8)


@query("known_entities", f"WITH {EV} SELECT count(DISTINCT user_id) AS known_entities FROM ev")
def _(spark, d):
    return profiles.known_entities(profiles.entity_state(events(spark, d)))


@query("state_age", f"WITH {SPLIT} SELECT ((SELECT max(t) FROM sp) - max(t)) / 1e6 AS age_seconds FROM sp WHERE split = 'train'")
def _(spark, d):
    e = split_events(spark, d)
    now = e.agg(F.max("t")).scalar()
    return profiles.state_age(profiles.entity_state(e.where("split = 'train'")), now)


@query("top_categories", f"""WITH {EV} SELECT user_id, count(*) AS n, {sq("avg(y)", 8)} AS fraud_rate FROM ev GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10""")
def _(spark, d):
    return rounded(profiles.top_categories(events(spark, d), "user_id", 10), fraud_rate=8)


@query("sort_temporal", f"WITH {EV} SELECT event_id, t FROM ev")
def _(spark, d):
    return events(spark, d).select("event_id", "t").orderBy("t", "event_id")


@query("time_bounds", f"WITH {EV} SELECT min(t) AS first_ts, max(t) AS last_ts FROM ev")
def _(spark, d):
    return events(spark, d).agg(F.min("t").alias("first_ts"), F.max("t").alias("last_ts"))


@query("head_n", f"WITH {EV} SELECT event_id, t FROM ev ORDER BY t, event_id LIMIT 100")
def _(spark, d):
    return events(spark, d).select("event_id", "t").orderBy("t", "event_id").limit(100)


@query("tail_n", f"WITH {EV} SELECT event_id, t FROM ev ORDER BY t DESC, event_id DESC LIMIT 5000")
def _(spark, d):
    return events(spark, d).select("event_id", "t").orderBy(F.desc("t"), F.desc("event_id")).limit(5000)


# ---------------------------------------------------------------- splits and set operations


@query("time_split_2", f"""WITH {EV} SELECT event_id, CASE WHEN row_number() OVER (ORDER BY t, event_id) - 1 >= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ev""")
def _(spark, d):
    return splits.time_split(events(spark, d)).select("event_id", "split")


@query("time_split_3", f"WITH {SPLIT} SELECT event_id, split FROM sp")
def _(spark, d):
    return split_events(spark, d).select("event_id", "split")


@query("split_stats", f"WITH {SPLIT} SELECT split, count(*) AS n, {sq('avg(y)', 8)} AS fraud_rate, min(t) AS first_ts, max(t) AS last_ts FROM sp GROUP BY 1")
def _(spark, d):
    return rounded(splits.split_stats(split_events(spark, d)), fraud_rate=8)


@query("tail_split", f"""WITH {EV} SELECT event_id, CAST(row_number() OVER (ORDER BY t, event_id) - 1 >= floor(count(*) OVER () * 0.85::DOUBLE) AS INTEGER) AS is_tail FROM ev""")
def _(spark, d):
    return splits.tail_fraction(events(spark, d)).select("event_id", "is_tail")


@query("sample_rows", f"WITH {EV} SELECT event_id, user_id, value FROM ev ORDER BY md5(event_id || ':42'), event_id LIMIT 500")
def _(spark, d):
    return splits.sample_rows(events(spark, d).select("event_id", "user_id", "value"), 500, "event_id")


@query("oversample", f"""WITH {SPLIT}, tr AS (SELECT *, count(*) FILTER (y = 1) OVER () AS np, count(*) FILTER (y = 0) OVER () AS nn FROM sp WHERE split = 'train')
SELECT event_id, CASE WHEN y = 1 THEN 1 / np ELSE 1 / nn END AS sample_weight FROM tr""")
def _(spark, d):
    return resample.sampling_weights(split_events(spark, d).where("split = 'train'")).select("event_id", "sample_weight")


@query("oversample_rows", f"""WITH {SPLIT}, tr AS (SELECT *, count(*) FILTER (y = 1) OVER () AS np, count(*) FILTER (y = 0) OVER () AS nn FROM sp WHERE split = 'train'),
f AS (SELECT *, CASE WHEN y = 1 THEN greatest(nn / np, 1.0) ELSE greatest(np / nn, 1.0) END AS f, CAST('0x' || substr(md5(event_id || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM tr)
SELECT event_id, y, CAST(unnest(range(1, CAST(floor(f) AS BIGINT) + CAST(u < f - floor(f) AS INTEGER) + 1)) AS INTEGER) AS copy FROM f""")
def _(spark, d):
    return resample.balance_by_weight(split_events(spark, d).where("split = 'train'"), "event_id").select("event_id", "y", "copy")


@query("concat_splits", f"WITH {SPLIT} SELECT event_id, t, split FROM sp")
def _(spark, d):
    e = split_events(spark, d).select("event_id", "t", "split")
    return splits.union_splits({s: e.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")})


@query("split_integrity", f"WITH {SPLIT} SELECT event_id, CAST(1 AS BIGINT) AS in_table, CAST(2 AS BIGINT) AS in_part FROM sp WHERE split <> 'test' AND rn >= (SELECT max(rn) FROM sp WHERE split = 'train')")
def _(spark, d):
    # The last train row is put into the validation part as well, and validation rows are listed twice,
    # so the check has something to report.
    e = split_events(spark, d)
    val = e.where("split = 'val'")
    last = e.where("split = 'train'").orderBy(F.desc("t"), F.desc("event_id")).limit(1)
    parts = [e.where("split = 'train'"), val, val, last, e.where("split = 'test'")]
    return splits.partition_violations(e, parts, "event_id")


@query("column_difference", f"""WITH {EV}, ref AS (SELECT unnest(['event_id', 'value', 'card4', 'dist1']) AS "column")
SELECT "column", (SELECT count(*) FROM ev) AS window_rows FROM ref WHERE "column" NOT IN ('event_id', 't', 'user_id', 'event_type', 'value', 'k', 'y', 'p1', 'p2', 'p3', 'p')""")
def _(spark, d):
    e = events(spark, d)
    gone = validate.missing_features(["event_id", "value", "card4", "dist1"], e.columns)
    return e.agg(F.count(F.lit(1)).alias("window_rows")).select(
        F.explode(F.array(*[F.lit(c) for c in gone])).alias("column"), "window_rows")


@query("key_overlap", f"""WITH {ORD}, sp AS (SELECT *, row_number() OVER (ORDER BY t, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM ord)
SELECT DISTINCT o_custkey FROM sp WHERE rn >= floor(n * 0.8::DOUBLE) AND o_custkey NOT IN (SELECT o_custkey FROM sp WHERE rn < floor(n * 0.8::DOUBLE))""")
def _(spark, d):
    from txnlens.plans.row_queries import ORDER_ROLES
    o = splits.time_split(orders(spark, d), 0.8, ORDER_ROLES)
    return joins.unseen_keys(o.where("split = 'train'"), o.where("split = 'test'"), "o_custkey")


# ---------------------------------------------------------------- encoders


@query("freq_encode", f"""WITH {SPLIT}, k AS (SELECT *, nullif(event_type, 'error') AS kind FROM sp),
f AS (SELECT kind, count(*) / (SELECT count(kind) FROM k WHERE split = 'train') AS f FROM k WHERE split = 'train' AND kind IS NOT NULL GROUP BY 1)
SELECT event_id, coalesce(f.f, 0) AS kind_freq FROM k LEFT JOIN f USING (kind)""")
def _(spark, d):
    e = _kind(split_events(spark, d))
    state = encoders.frequency(e.where("split = 'train'"), "kind")
    return encoders.apply_frequency(e, state, "kind").select("event_id", "kind_freq")


@query("combo_freq", f"""WITH {SPLIT}, k AS (SELECT *, {COMBO_SQL} AS combo FROM sp),
f AS (SELECT combo, count(*) / (SELECT count(*) FROM k WHERE split = 'train') AS f FROM k WHERE split = 'train' GROUP BY 1)
SELECT event_id, coalesce(f.f, 0) AS combo_freq FROM k LEFT JOIN f USING (combo)""")
def _(spark, d):
    e = _kind(split_events(spark, d))
    return encoders.combo_frequency(e.where("split = 'train'"), e, ["user_id", "kind"]).select("event_id", "combo_freq")


@query("label_encode", f"""WITH {SPLIT}, k AS (SELECT *, coalesce(CASE WHEN event_type = 'error' THEN NULL WHEN split = 'test' AND k = 1 THEN 'new' ELSE event_type END, 'MISSING') AS kind FROM sp),
v AS (SELECT kind, CAST(row_number() OVER (ORDER BY kind COLLATE "C") - 1 AS INTEGER) AS c FROM (SELECT kind FROM k WHERE split = 'train' UNION SELECT 'MISSING'))
SELECT event_id, coalesce(v.c, (SELECT c FROM v WHERE kind = 'MISSING')) AS kind_code FROM k LEFT JOIN v USING (kind)""".replace(' COLLATE "C"', ""))
def _(spark, d):
    kind = "CASE WHEN event_type = 'error' THEN NULL WHEN split = 'test' AND k = 1 THEN 'new' ELSE event_type END"
    e = split_events(spark, d).withColumn("kind", F.expr(kind))
    state = encoders.fit_labels(e.where("split = 'train'"), "kind")
    return encoders.apply_labels(e, state, "kind").select("event_id", "kind_code")


@query("uid_features", f"""WITH {SPLIT}, {UID_SQL.format(src="sp")},
s AS (SELECT uid, count(*) AS n, CASE WHEN count(*) >= 3 THEN avg(value) END AS m, CASE WHEN count(*) >= 3 THEN stddev_pop(value) END AS sd,
             CASE WHEN count(*) >= 3 THEN avg(age) END AS a FROM uid WHERE split = 'train' GROUP BY 1),
g AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, coalesce(avg(age), -1) AS a FROM uid WHERE split = 'train'),
j AS (SELECT event_id, value, coalesce(s.n, 0) AS n, coalesce(s.m, g.m) AS m, coalesce(s.sd, g.sd) AS sd, coalesce(s.a, g.a) AS a, g.n AS total FROM uid LEFT JOIN s USING (uid), g)
SELECT event_id, n AS uid_count, {sq("n / total", 8)} AS uid_freq, {sq("m")} AS uid_amt_mean, {sq("sd")} AS uid_amt_std, {sq("a")} AS uid_age_mean,
  {sq("CASE WHEN n >= 3 AND m > 0 THEN value / m ELSE 1 END")} AS uid_amt_ratio FROM j""")
def _(spark, d):
    e = with_uid(split_events(spark, d))
    out = encoders.apply_cohorts(e.where("split = 'train'"), e, "uid", "value", "age").select(
        "event_id", "uid_count", "uid_freq", "uid_amt_mean", "uid_amt_std", "uid_age_mean", "uid_amt_ratio")
    return rounded(out, uid_freq=8, uid_amt_mean=4, uid_amt_std=4, uid_age_mean=4, uid_amt_ratio=4)


@query("dist_features", f"""WITH {SPLIT}, c AS (SELECT quantile_cont(value, 0.8) AS cut FROM sp WHERE split = 'train' AND event_type = 'purchase')
SELECT event_id, {sq("CASE WHEN event_type = 'purchase' THEN ln(1 + value) ELSE -1 END", 6)} AS dist_log, CAST(event_type = 'purchase' AND value >= cut AS INTEGER) AS dist_high FROM sp, c""")
def _(spark, d):
    e = split_events(spark, d)
    scope = F.col("event_type") == "purchase"
    cut = encoders.fit_quantile(e.where("split = 'train'").where(scope), "value").scalar()
    return rounded(rowwise.scoped_gradient(e, "value", scope, cut, "dist").select("event_id", "dist_log", "dist_high"), dist_log=6)


@query("impute", f"""WITH {EV} SELECT event_id, coalesce(nullif(event_type, 'error'), 'MISSING') AS kind, CASE WHEN k < 30 THEN -999.0::DOUBLE ELSE value END AS amount,
  CASE WHEN k > 60 THEN -999 ELSE k END AS k FROM ev""")
def _(spark, d):
    e = events(spark, d).select(
        "event_id", F.expr("nullif(event_type, 'error')").alias("kind"), F.expr("CASE WHEN k >= 30 THEN value END").alias("amount"),
        F.expr("CASE WHEN k <= 60 THEN k END").alias("k"))
    return encoders.impute(e)


def _embeddings(spark, d):
    return read_table(spark, d, "embeddings")


@query("pca")
def _(spark, d):
    e = _embeddings(spark, d)
    return encoders.apply_pca(e, encoders.fit_pca(e.where("label % 5 <> 0"), "embedding", 30), "embedding")


@query("explained_variance")
def _(spark, d):
    e = _embeddings(spark, d)
    return encoders.explained_variance(spark, encoders.fit_pca(e.where("label % 5 <> 0"), "embedding", 30))


def _poly_sql(x, coef):
    return reduce(lambda a, c: f"(({a}) * ({x}) + ({c!r}::DOUBLE))", coef[1:], f"({coef[0]!r}::DOUBLE)")


def _normal_sql(u):
    e = encoders
    low, high = f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))"
    mid = f"{_poly_sql(f'({u} - 0.5) * ({u} - 0.5)', e._A)} * ({u} - 0.5) / ({_poly_sql(f'({u} - 0.5) * ({u} - 0.5)', e._B)} * (({u} - 0.5) * ({u} - 0.5)) + 1)"
    tail = lambda x: f"{_poly_sql(x, e._C)} / ({_poly_sql(x, e._D)} * {x} + 1)"
    c = e.NORMAL_CLIP
    return (f"CASE WHEN {u} <= 0 THEN -{c} WHEN {u} >= 1 THEN {c} WHEN {u} < 0.02425 THEN {tail(low)} "
            f"WHEN {u} > 0.97575 THEN -({tail(high)}) ELSE {mid} END")


@query("quantile_normal", f"""WITH {SPLIT}, qs AS (SELECT unnest(range(1000)) AS i, unnest(quantile_cont(value, [{", ".join(f"CAST('{i / 999!r}' AS DOUBLE)" for i in range(1000))}])) AS x FROM sp WHERE split = 'train'),
g AS (SELECT x, (min(i) + max(i)) / 2 / 999 AS u FROM qs GROUP BY x),
k AS (SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1, u AS u0, lead(u) OVER (ORDER BY x) AS u1 FROM g),
ends AS (SELECT min(x) AS lo, max(x) AS hi, max(u) AS top FROM g),
u AS (SELECT event_id, CASE WHEN value < lo THEN 0 WHEN value > hi THEN 1 WHEN value = hi THEN top ELSE u0 + (u1 - u0) * (value - x0) / (x1 - x0) END AS u
      FROM sp CROSS JOIN ends LEFT JOIN k ON value >= x0 AND value < x1)
SELECT event_id, {sq("greatest(least(" + _normal_sql("u") + ", 5.199337582605575), -5.199337582605575)", 6)} AS value_normal FROM u""")
def _(spark, d):
    e = split_events(spark, d)
    knots = encoders.fit_normal_scores(e.where("split = 'train'"), "value")
    return rounded(encoders.apply_normal_scores(e, "value", knots, "value_normal").select("event_id", "value_normal"), value_normal=6)


ISO = """v AS (SELECT row_number() OVER (ORDER BY p) AS i, p, sum(y) AS s, count(*) AS c FROM sp WHERE split = 'val' GROUP BY p),
cs AS (SELECT i, p, sum(s) OVER (ORDER BY i) AS cs, sum(c) OVER (ORDER BY i) AS cc, s, c FROM v),
pr AS (SELECT a.i AS lo, b.i AS hi, (b.cs - a.cs + a.s) / (b.cc - a.cc + a.c) AS m FROM cs a JOIN cs b ON b.i >= a.i),
sm AS (SELECT lo, hi AS i, min(m) OVER (PARTITION BY lo ORDER BY hi DESC) AS m FROM pr),
fit AS (SELECT v.p, max(m) AS g FROM sm JOIN v USING (i) GROUP BY 1),
kn AS (SELECT p AS x0, g AS g0, lead(p) OVER (ORDER BY p) AS x1, lead(g) OVER (ORDER BY p) AS g1 FROM fit),
en AS (SELECT min(p) AS lo, max(p) AS hi, min(g) AS glo, max(g) AS ghi FROM fit)"""


@query("isotonic", f"""WITH {SPLIT}, {ISO}
SELECT event_id, split, y, sp.p, {sq("CASE WHEN sp.p <= lo THEN glo WHEN sp.p >= hi THEN ghi ELSE g0 + (g1 - g0) * (sp.p - x0) / (x1 - x0) END", 6)} AS calibrated
FROM sp CROSS JOIN en LEFT JOIN kn ON sp.p >= x0 AND sp.p < x1 WHERE split <> 'train'""")
def _(spark, d):
    e = split_events(spark, d)
    model = isotonic.fit_isotonic(e.where("split = 'val'"))
    out = isotonic.apply_isotonic(e.where("split <> 'train'"), model).select("event_id", "split", "y", "p", "calibrated")
    return rounded(out, calibrated=6)


KNN = """m AS (SELECT vec_id, embedding AS e FROM embeddings WHERE label = 0),
pd AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i]::DOUBLE - b.e[i]::DOUBLE) ** 2))) AS dist FROM m a JOIN m b ON a.vec_id <> b.vec_id),
nn AS (SELECT vec_id, neighbour, dist, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS INTEGER) AS rank FROM pd
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) <= 5)"""


def _u_sql(*parts):
    return "(CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("smote", f"""WITH {KNN}, z AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS mm FROM embeddings),
cp AS (SELECT vec_id, floor((n - 2 * mm) / mm) + CAST(row_number() OVER (ORDER BY {_u_sql("vec_id", "'42'")}, vec_id) - 1 < (n - 2 * mm) % mm AS INTEGER) AS copies FROM m, z),
dw AS (SELECT vec_id, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy FROM cp),
pk AS (SELECT vec_id, copy, CAST(floor({_u_sql("vec_id", "copy", "'42'")} * least(5, (SELECT mm - 1 FROM z))) + 1 AS INTEGER) AS rank, {_u_sql("copy", "vec_id", "'43'")} AS share FROM dw)
SELECT pk.vec_id AS base, neighbour, CAST(copy AS INTEGER) AS copy, share, {sq("a.e[1] + (b.e[1] - a.e[1]) * share", 4)} AS x1, {sq("a.e[64] + (b.e[64] - a.e[64]) * share", 4)} AS x64
FROM pk JOIN nn USING (vec_id, rank) JOIN m a ON a.vec_id = pk.vec_id JOIN m b ON b.vec_id = neighbour""")
def _(spark, d):
    e = _embeddings(spark, d).withColumn("y", (F.col("label") == 0).cast("int"))
    out = resample.smote(e, "vec_id", "embedding").select(
        "base", "neighbour", "copy", "share", F.get("embedding", F.lit(0)).cast("double").alias("x1"), F.get("embedding", F.lit(63)).cast("double").alias("x64"))
    return rounded(out, x1=4, x64=4)


@query("smote_neighbours", f"WITH {KNN} SELECT vec_id, neighbour, {sq('dist', 6)} AS distance, rank FROM nn")
def _(spark, d):
    from txnlens.operators.neighbours import nearest_neighbours
    e = _embeddings(spark, d).where("label = 0")
    out = nearest_neighbours(e, "vec_id", "embedding", 5).select("vec_id", "neighbour", "distance", "rank")
    return rounded(out, distance=6)


# ---------------------------------------------------------------- sequences


def _seq_text(col="seq"):
    flat = F.flatten(F.transform(F.col(col), lambda v: F.transform(v, lambda x: F.floor(x.cast("double") * 100 + 0.5).cast("string"))))
    return F.array_join(flat, ",").alias("seq")


def _seq_sql(src, frame=f"({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", where=""):
    cell = "[CAST(CAST(floor(CAST(CAST(value AS FLOAT) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS VARCHAR), CAST(k * 100 AS VARCHAR)]"
    return f"""SELECT event_id, array_to_string(flatten(list_concat(list_transform(range(10 - len(s)), lambda i: ['0', '0']), s)), ',') AS seq, CAST(len(s) AS BIGINT) AS real FROM (
      SELECT *, list({cell}) OVER {frame} AS s FROM {src}) {where}"""


def _seq_out(df):
    return df.select("event_id", _seq_text(), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("real"))


@query("sequences", f"WITH {EV} {_seq_sql('ev')}")
def _(spark, d):
    return _seq_out(sequences.build_sequences(events(spark, d), ["value", "k"]))


@query("sequence_window", f"WITH {EV} SELECT event_id, array_to_string(list(event_id) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS ids FROM ev")
def _(spark, d):
    from txnlens.operators.ordered import history
    out = history(events(spark, d), ["user_id"], ["t", "event_id"], F.col("event_id").cast("string"), 5, "ids")
    return out.select("event_id", F.array_join("ids", ",").alias("ids"))


@query("resolve_imbalance", f"""WITH {SPLIT}, c AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM sp WHERE split = 'train')
SELECT 'oversample' AS sampling, 'weighted_bce' AS loss, 1 AS resampled, 1.0::DOUBLE AS positive_weight FROM c UNION ALL
SELECT 'none', 'weighted_bce', 0, n / p FROM c UNION ALL SELECT 'none', 'focal_loss', 0, 1.0 FROM c""")
def _(spark, d):
    w = resample.class_weights(split_events(spark, d).where("split = 'train'")).first()
    rows = []
    for sampling, loss in (("oversample", "weighted_bce"), ("none", "weighted_bce"), ("none", "focal_loss")):
        resampled, weight = resample.resolve_imbalance(sampling, loss, w["n_pos"], w["n_neg"])
        rows.append((sampling, loss, int(resampled), float(weight)))
    return spark.createDataFrame(rows, "sampling string, loss string, resampled int, positive_weight double")


@query("sequences_static", f"""WITH {SPLIT}, k AS (SELECT CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS c, k FROM ev)
SELECT 'kind' AS "column", CAST(max(c) + 1 AS INTEGER) AS cardinality FROM k UNION ALL SELECT 'k', CAST(max(k) + 1 AS INTEGER) FROM k""")
def _(spark, d):
    code = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
    e = events(spark, d).withColumn("kind", F.expr(code))
    return sequences.cardinalities(sequences.static_features(e, ["kind", "k"]), ["kind", "k"])


@query("sequences_capped", f"WITH {EV}, c AS (SELECT * FROM ev ORDER BY t, event_id LIMIT 2000) {_seq_sql('c')}")
def _(spark, d):
    return _seq_out(sequences.build_sequences(events(spark, d), ["value", "k"], max_rows=2000))


@query("sequences_cross_split", f"WITH {SPLIT} {_seq_sql('sp', where=chr(32) + 'WHERE split = ' + chr(39) + 'val' + chr(39))}")
def _(spark, d):
    return _seq_out(sequences.sequences_across(split_events(spark, d), ["value", "k"], "split", "val"))


@query("history_trim", f"WITH {SPLIT} SELECT event_id, user_id FROM sp WHERE split <> 'test' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) <= 9")
def _(spark, d):
    return windows.last_k(split_events(spark, d).where("split <> 'test'"), 9).select("event_id", "user_id")


@query("partial_sequence_count", f"WITH {EV} SELECT count(*) AS n, count(*) FILTER (rn < 10) AS partial_sequences FROM (SELECT row_number() OVER ({W}) AS rn FROM ev)")
def _(spark, d):
    return sequences.partial_sequence_count(sequences.build_sequences(events(spark, d), ["value"]))


@query("target_attach", f"""WITH {EV} SELECT event_id, y, least(row_number() OVER ({W}), 10) AS real FROM ev""")
def _(spark, d):
    e = events(spark, d)
    seqs = sequences.build_sequences(e.drop("y"), ["value"])
    real = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return joins.attach_labels(seqs.select("event_id", real.alias("real")), e.select("event_id", "y"), "event_id")


@query("feature_exclusion", f"""WITH {EV} SELECT 'value' AS "column", count(value) AS filled, 'sequence' AS kind FROM ev UNION ALL SELECT 'k', count(k), 'sequence' FROM ev
UNION ALL SELECT 'tx_count', count(*), 'sequence' FROM ev""")
def _(spark, d):
    df = windows.velocity_features(events(spark, d)).select("event_id", "user_id", "t", "y", "value", "k", "tx_count", "tx_count_24h", "amt_24h_mean")
    return validate.column_counts(df, sequences.sequence_feature_cols(df), "sequence")


# ---------------------------------------------------------------- graph

CARD = graph.EdgeSpec("card", ("user_id",), 10)
COMBO = graph.EdgeSpec("kind_k", ("event_type", "k"), 5, {"k": 0.0})
SPECS = [CARD, COMBO]


def _nodes(spark, d):
    """Events numbered by time: node order is temporal order."""
    from txnlens.operators.ordered import global_rank
    return global_rank(split_events(spark, d), ["t", "event_id"], "node")


NODES = SPLIT + ", nd AS (SELECT *, rn AS node FROM sp)"


def _edges_sql(spec, key, where="true", name="e"):
    return f"""{name} AS (SELECT CAST(s.src AS BIGINT) AS src, node AS dst, '{spec.name}' AS spec FROM (
      SELECT node, list(node) OVER (PARTITION BY {key} ORDER BY node ROWS BETWEEN {spec.cap} PRECEDING AND 1 PRECEDING) AS p FROM nd WHERE {where}) z, unnest(z.p) s(src))"""


CARD_SQL = _edges_sql(CARD, "user_id", name="e1")
COMBO_SQL2 = _edges_sql(COMBO, "event_type, k", "k <> 0", "e2")
ALL_EDGES = f"{CARD_SQL}, {COMBO_SQL2}, ed AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e1 UNION ALL SELECT src, dst FROM e2))"
PHASES = """cuts AS (SELECT count(*) FILTER (split = 'train') AS a, count(*) FILTER (split <> 'test') AS b FROM sp),
ph AS (SELECT src, dst, CASE WHEN dst < a THEN 'train' WHEN dst < b THEN 'val' ELSE 'test' END AS phase FROM ed, cuts)"""


def _phased(spark, d):
    # The numbered node table is read by every edge set and every hop, so it is written once.
    nodes = cut_lineage(_nodes(spark, d).select("node", "split", "user_id", "event_type", "k", "value"))
    counts = nodes.agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("split") != "test", 1).otherwise(0)).alias("b"))
    edges = graph.edges_from_specs(nodes, "node", SPECS)
    return nodes, graph.with_phase(edges, counts.select("a").scalar(), counts.select("b").scalar())


@query("capped_edges", f"WITH {NODES}, {CARD_SQL} SELECT * FROM e1")
def _(spark, d):
    return graph.capped_edges(_nodes(spark, d), "node", CARD)


@query("edge_self_join", f"WITH {NODES}, {COMBO_SQL2} SELECT * FROM e2")
def _(spark, d):
    return graph.capped_edges(_nodes(spark, d), "node", COMBO)


@query("edge_specs", f"WITH {NODES}, {ALL_EDGES} SELECT * FROM ed")
def _(spark, d):
    return graph.edges_from_specs(_nodes(spark, d), "node", SPECS)


@query("dedupe_pairs", """WITH x AS (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem)
SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM x""")
def _(spark, d):
    return graph.dedupe_pairs(read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("edge_phase", f"WITH {NODES}, {ALL_EDGES}, {PHASES} SELECT * FROM ph")
def _(spark, d):
    return _phased(spark, d)[1]


@query("symmetrize", f"WITH {NODES}, {ALL_EDGES}, {PHASES} SELECT src, dst, phase FROM ph UNION ALL SELECT dst, src, phase FROM ph")
def _(spark, d):
    return graph.directed(_phased(spark, d)[1])


@query("edge_guard", f"WITH {NODES}, {CARD_SQL}, {COMBO_SQL2} SELECT spec, count(*) AS edges FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY 1")
def _(spark, d):
    nodes = cut_lineage(_nodes(spark, d).select("node", "user_id", "event_type", "k"))
    graph.assert_edge_budget(nodes, SPECS)
    return graph.edge_estimate(nodes, SPECS)


@query("key_blocklist", f"WITH {NODES}, {CARD_SQL} SELECT count(*) AS edges, 1 AS refused FROM e1")
def _(spark, d):
    nodes = _nodes(spark, d)
    try:
        graph.capped_edges(nodes.withColumn("user_id_freq", F.lit(0.1)), "node", graph.EdgeSpec("bad", ("user_id_freq",), 3))
        refused = 0
    except ValueError:
        refused = 1
    return graph.capped_edges(nodes, "node", CARD).agg(F.count(F.lit(1)).alias("edges")).withColumn("refused", F.lit(refused))


@query("graph_invariants", f"WITH {EV}, n AS (SELECT 0 * count(*) AS violations FROM ev) SELECT unnest(['repeated_nodes', 'edges_before_node', 'one_way_edges', 'self_loops']) AS rule, violations FROM n")
def _(spark, d):
    nodes, edges = _phased(spark, d)
    return graph.graph_violations(nodes, graph.directed(edges))


@query("degree", f"WITH {NODES}, {ALL_EDGES}, {PHASES} SELECT phase, count(*) AS edges, count(DISTINCT dst) AS nodes FROM ph GROUP BY 1")
def _(spark, d):
    return graph.degrees(_phased(spark, d)[1])


NBR = """di AS (SELECT src, dst FROM ph WHERE phase = 'train' UNION ALL SELECT dst, src FROM ph WHERE phase = 'train'),
h1 AS (SELECT node, coalesce(m, 0) AS v FROM nd LEFT JOIN (SELECT di.dst AS node, avg(value) AS m FROM di JOIN nd ON nd.node = di.src GROUP BY 1) USING (node))"""


@query("neighbor_mean", f"""WITH {NODES}, {ALL_EDGES}, {PHASES}, {NBR},
h2 AS (SELECT di.dst AS node, avg(v) AS m FROM di JOIN h1 ON h1.node = di.src GROUP BY 1)
SELECT node, {sq("coalesce(m, 0)")} AS nbr_value FROM nd LEFT JOIN h2 USING (node)""")
def _(spark, d):
    nodes, edges = _phased(spark, d)
    return rounded(graph.neighbor_mean(nodes, graph.directed(edges.where("phase = 'train'")), ["value"], hops=2), nbr_value=4)


@query("feature_join_edges", f"WITH {NODES}, {ALL_EDGES}, {PHASES}, {NBR} SELECT node, {sq('v')} AS nbr_value FROM h1")
def _(spark, d):
    nodes, edges = _phased(spark, d)
    return rounded(graph.neighbor_mean(nodes, graph.directed(edges.where("phase = 'train'")), ["value"]), nbr_value=4)


@query("neighbor_cap_sample", f"""WITH {NODES}, {ALL_EDGES} SELECT src, dst FROM ed QUALIFY row_number() OVER (PARTITION BY dst ORDER BY md5(src || ':' || dst || ':42'), src) <= 4""")
def _(spark, d):
    return graph.sample_neighbors(graph.edges_from_specs(_nodes(spark, d), "node", SPECS), 4)


