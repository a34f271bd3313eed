"""Queries over rows: sources, validation, row-wise features, joins, windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions import fixed, rowwise
from txnlens.operators import joins, validate, windows
from txnlens.operators.ordered import global_rank
from txnlens.operators.profiles import entity_recent, entity_state, label_totals
from txnlens.plans.catalog import ARRIVAL, EV, ORD, PRIOR, SPLIT, W, events, orders, q, query, rounded, split_events, sq
from txnlens.roles import Roles
from txnlens.sources.tables import read_table

ORDER_ROLES = Roles("o_orderkey", "o_custkey", "t", "o_totalprice", "y", "o_orderstatus")

# ---------------------------------------------------------------- projection, filter, validation


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    return read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("validate_schema", f"""WITH {EV}
SELECT * FROM (VALUES ('required', 'event_id', 0::BIGINT), ('required', 'card1', 1), ('forbidden', 'p', 1)) v(rule, subject, violations)
UNION ALL SELECT 'label', 'k', count(*) FILTER (k NOT IN (0, 1)) FROM ev""")
def _(spark, d):
    return validate.validate_schema(events(spark, d), ["event_id", "card1"], "k", ["p"])


@query("validate_rows", f"""WITH {EV}, raw AS (
  SELECT event_id, CASE WHEN k = 0 THEN ' ' ELSE CAST(event_id AS VARCHAR) END AS id, CASE WHEN k = 1 THEN -t ELSE t END AS ts,
         CASE WHEN k = 2 THEN 0.0 WHEN k = 3 THEN 2000000.0 ELSE value END AS amount,
         CASE WHEN k = 4 THEN 'card' ELSE CAST(user_id AS VARCHAR) END AS entity FROM ev)
SELECT event_id, CASE WHEN trim(id) = '' THEN 'id' WHEN ts < 0 THEN 'ts' WHEN amount <= 0 OR amount > 1000000 THEN 'amount'
       WHEN TRY_CAST(entity AS BIGINT) IS NULL THEN 'entity' ELSE 'ok' END AS verdict FROM raw""")
def _(spark, d):
    e = events(spark, d)
    raw = e.select(
        "event_id", F.when(e.k == 0, " ").otherwise(e.event_id.cast("string")).alias("id"),
        F.when(e.k == 1, -e.t).otherwise(e.t).alias("ts"),
        F.when(e.k == 2, 0.0).when(e.k == 3, 2_000_000.0).otherwise(e.value).alias("amount"),
        F.when(e.k == 4, "card").otherwise(e.user_id.cast("string")).alias("entity"))
    valid, rejected = validate.split_valid(raw, "id", "ts", "amount", "entity")
    return valid.select("event_id", F.lit("ok").alias("verdict")).unionByName(
        rejected.select("event_id", F.col("reason").alias("verdict")))


@query("stale_filter", f"""WITH {EV}, a AS (SELECT *, {ARRIVAL} AS arrival FROM ev), s AS (
  SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT event_id, user_id FROM s WHERE seen IS NULL OR seen - t <= 86400000000""")
def _(spark, d):
    e = events(spark, d).withColumn("arrival", F.expr(ARRIVAL))
    return windows.arrival_flags(e, ["arrival", "event_id"]).where("stale = 0").select("event_id", "user_id")


@query("running_max_ts", f"""WITH {EV}, a AS (SELECT *, {ARRIVAL} AS arrival FROM ev)
SELECT event_id, CAST(coalesce(max(t) OVER (PARTITION BY user_id ORDER BY arrival, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > t, false) AS INTEGER) AS out_of_order FROM a""")
def _(spark, d):
    e = events(spark, d).withColumn("arrival", F.expr(ARRIVAL))
    return windows.arrival_flags(e, ["arrival", "event_id"]).select("event_id", "out_of_order")


@query("drop_cols", f"WITH {EV} SELECT event_id, t, value, y FROM ev")
def _(spark, d):
    return validate.drop_non_features(
        events(spark, d), ["t", "user_id", "event_type", "k", "p1", "p2", "p3", "p"])


@query("align_features", f"WITH {EV} SELECT p2, value, p1 FROM ev")
def _(spark, d):
    return validate.align(events(spark, d), ["p2", "value", "p1"])


@query("restore_raw_schema", f"WITH {EV} SELECT event_id, NULL::DOUBLE AS dist1, value, NULL::VARCHAR AS card4 FROM ev")
def _(spark, d):
    schema = T.StructType().add("event_id", "long").add("dist1", "double").add("value", "double").add("card4", "string")
    return validate.with_missing_columns(events(spark, d), schema)


@query("coerce_numeric", f"""WITH {EV}, raw AS (
  SELECT event_id, CASE WHEN k = 5 THEN 'n/a' WHEN k = 6 THEN NULL ELSE CAST(k AS VARCHAR) END AS a FROM ev)
SELECT event_id, TRY_CAST(a AS DOUBLE) AS a, CAST(a IS NOT NULL AND TRY_CAST(a AS DOUBLE) IS NULL AS INTEGER) AS corrupt FROM raw""")
def _(spark, d):
    e = events(spark, d)
    raw = e.select("event_id", F.when(e.k == 5, "n/a").when(e.k != 6, e.k.cast("string")).alias("a"))
    return validate.coerce_numeric(raw, ["a"])


@query("select_by_type", f"""WITH {EV}
SELECT 'event_type' AS "column", count(event_type) AS filled, 'categorical' AS kind FROM ev UNION ALL
SELECT 'value', count(value), 'numeric' FROM ev UNION ALL SELECT 'event_id', count(event_id), 'numeric' FROM ev UNION ALL
SELECT 'user_id', count(user_id), 'numeric' FROM ev""")
def _(spark, d):
    df = events(spark, d).select("event_id", "user_id", "event_type", "value")
    return validate.column_counts(df, validate.numeric_cols(df), "numeric").unionByName(
        validate.column_counts(df, validate.categorical_cols(df), "categorical"))


@query("restore_dtypes", f"WITH {EV} SELECT event_id, value, k, CAST(event_type AS VARCHAR) AS event_type FROM ev")
def _(spark, d):
    loose = events(spark, d).select("event_id", "value", F.col("k").cast("double").alias("k"), "event_type")
    target = T.StructType().add("event_id", "long").add("value", "long").add("k", T.IntegerType()).add("event_type", "string")
    return validate.cast_like(loose, target)


@query("table_fingerprint", """SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31),
  CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus)), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM orders""")
def _(spark, d):
    return validate.fingerprint(read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))


@query("decision", f"WITH {EV} SELECT event_id, CASE WHEN p >= 0.45 THEN 'FRAUD' ELSE 'LEGITIMATE' END AS decision FROM ev")
def _(spark, d):
    return events(spark, d).select("event_id", rowwise.decide(F.col("p"), 0.45).alias("decision"))


# ---------------------------------------------------------------- row-wise features


@query("temporal", f"""WITH {EV}, x AS (SELECT event_id, CAST((t // 3600000000) % 24 AS INTEGER) AS h, CAST((t // 86400000000) % 7 AS INTEGER) AS w FROM ev)
SELECT event_id, h AS hour_of_day, w AS day_of_week, {sq("sin(2*pi()*h/24)", 6)} AS hour_sin, {sq("cos(2*pi()*h/24)", 6)} AS hour_cos,
       {sq("sin(2*pi()*w/7)", 6)} AS dow_sin, {sq("cos(2*pi()*w/7)", 6)} AS dow_cos FROM x""")
def _(spark, d):
    out = rowwise.temporal_features(events(spark, d).select("event_id", "t")).drop("t")
    return rounded(out, hour_sin=6, hour_cos=6, dow_sin=6, dow_cos=6)


@query("amount", f"""WITH {EV} SELECT event_id, {sq("ln(1 + value)", 6)} AS amount_log, {sq("value % 1.0", 6)} AS amount_cents,
  CAST(value % 1.0 = 0 AS INTEGER) AS amount_is_round,
  CAST(length(rtrim(split_part(printf('%.10f', value), '.', 2), '0')) AS INTEGER) AS amount_decimal_len FROM ev""")
def _(spark, d):
    out = rowwise.amount_features(events(spark, d).select("event_id", "value")).drop("value")
    return rounded(out, amount_log=6, amount_cents=6)


DOMAIN = "CASE event_type WHEN 'click' THEN 'Gmail.com' WHEN 'view' THEN 'corp.example' WHEN 'signup' THEN 'yahoo.com' END"
DOMAIN_B = "CASE WHEN k % 3 = 0 THEN 'Gmail.com' WHEN k % 3 = 1 THEN 'yahoo.com' END"


@query("email", f"""WITH {EV}, x AS (SELECT event_id, {DOMAIN} AS a, {DOMAIN_B} AS b FROM ev)
SELECT event_id, CAST(a IS NOT DISTINCT FROM b AS INTEGER) AS email_match, CAST(a IS NOT NULL AND b IS NOT NULL AS INTEGER) AS email_both_present,
  CAST(coalesce(lower(a), '') IN {fixed.FREE_EMAIL_DOMAINS!r} AS INTEGER) AS a_is_free,
  CAST(coalesce(lower(b), '') IN {fixed.FREE_EMAIL_DOMAINS!r} AS INTEGER) AS b_is_free FROM x""")
def _(spark, d):
    e = events(spark, d).select("event_id", F.expr(DOMAIN).alias("a"), F.expr(DOMAIN_B).alias("b"))
    return rowwise.pair_match_features(e, "a", "b").drop("a", "b")


CELLS = ["nullif(l_tax, 0)", "nullif(l_discount, 0)", "CASE WHEN l_quantity > 25 THEN l_quantity END"]


def _cells(spark, d):
    return read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", *[F.expr(c).alias(f"c{i}") for i, c in enumerate(CELLS)])


@query("d_summary", f"""WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, list_filter([{", ".join(CELLS)}], lambda c: c IS NOT NULL) AS v FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, CAST(3 - len(v) AS INTEGER) AS d_null_count, {sq("coalesce(list_avg(v), -1)", 6)} AS d_mean,
       {sq("CASE WHEN len(v) > 1 THEN list_stddev_samp(v) ELSE -1 END", 6)} AS d_std, coalesce(list_max(v), -1) AS d_max FROM x""")
def _(spark, d):
    out = rowwise.row_summary(_cells(spark, d), ["c0", "c1", "c2"], "D", "d").drop("c0", "c1", "c2")
    return rounded(out, d_mean=6, d_std=6)


@query("c_summary", f"""WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, [{", ".join(f"coalesce({c}, 0)" for c in CELLS)}] AS v FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, {sq("list_sum(v)", 6)} AS c_sum, list_max(v) AS c_max,
       CAST(len(list_filter(v, lambda c: c <> 0)) AS INTEGER) AS c_nonzero_count FROM x""")
def _(spark, d):
    out = rowwise.row_summary(_cells(spark, d), ["c0", "c1", "c2"], "C", "c").drop("c0", "c1", "c2")
    return rounded(out, c_sum=6)


@query("null_count", f"""WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, {" + ".join(f"CAST(({c}) IS NULL AS INTEGER)" for c in CELLS)} AS n FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, n AS null_count_total, n / 3.0::DOUBLE AS null_ratio FROM x""")
def _(spark, d):
    return rowwise.null_count_features(_cells(spark, d), ["c0", "c1", "c2"]).drop("c0", "c1", "c2")


@query("presence", f"""SELECT l_orderkey, l_partkey, l_linenumber, CAST(({CELLS[0]}) IS NOT NULL AS INTEGER) AS addr_present,
  CAST(({CELLS[2]}) IS NOT NULL AS INTEGER) AS dist_present FROM lineitem""")
def _(spark, d):
    return rowwise.presence_flags(_cells(spark, d), {"addr_present": "c0", "dist_present": "c2"}).drop("c0", "c1", "c2")


def _rules_sql(col, rules):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}'){extra} THEN '{n}'" for n, p, extra in reversed(rules)) + " ELSE 'other' END"


_UA = [(n, p, f" AND NOT regexp_matches(ua, '{fixed.SAFARI_EXCLUDES}')" if n == "safari" else "") for n, p in fixed.BROWSER_PATTERNS]
_DEV = [(n, p, "") for n, p in fixed.DEVICE_PATTERNS]


@query("device", f"""WITH x AS (SELECT doc_id, lower(text) AS ua, lower(source || ' ' || text) AS dev,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'x1y' ELSE n_chars || 'x' || doc_id END AS res FROM documents),
  s AS (SELECT *, string_split(res, 'x') AS parts FROM x),
  z AS (SELECT *, coalesce(CASE WHEN len(parts) = 2 THEN TRY_CAST(parts[1] AS DOUBLE) END, 0) AS sw,
                  coalesce(CASE WHEN len(parts) = 2 THEN TRY_CAST(parts[2] AS DOUBLE) END, 0) AS sh FROM s)
SELECT doc_id, {_rules_sql('ua', _UA)} AS browser_family, CAST(regexp_matches(ua, '{fixed.MOBILE_PATTERN}') AS INTEGER) AS browser_is_mobile,
  {_rules_sql('dev', _DEV)} AS device_brand, sw AS screen_width, sh AS screen_height,
  {sq("CASE WHEN sh > 0 THEN sw / sh ELSE 0 END", 6)} AS screen_aspect_ratio FROM z""")
def _(spark, d):
    res = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'x1y' ELSE concat(n_chars, 'x', doc_id) END"
    docs = read_table(spark, d, "documents").select(
        "doc_id", "text", F.concat_ws(" ", "source", "text").alias("dev"), F.expr(res).alias("res"))
    return rounded(rowwise.device_features(docs, "text", "dev", "res").drop("text", "dev", "res"), screen_aspect_ratio=6)


EXPANDED = f"""x AS (
  SELECT *, count(*) OVER w AS n, coalesce(sum(value) OVER w, 0) AS s, coalesce(sum(value * value) OVER w, 0) AS q, max(value) OVER w AS mx
  FROM ev WINDOW w AS {PRIOR}),
m AS (SELECT *, CASE WHEN n > 0 THEN s / n ELSE 0 END AS mean,
             sqrt(greatest(CASE WHEN n > 1 THEN (q - s * s / n) / (n - 1) ELSE 0 END, 0)) AS std FROM x)"""
ZSCORE = "CASE WHEN std > 1e-9 THEN (value - mean) / (std + 1e-6) ELSE 0 END"


@query("expanding", f"""WITH {EV}, {EXPANDED}
SELECT event_id, n AS tx_count, {sq("s", 2)} AS tx_sum, {sq("mean")} AS mean_amount, coalesce(mx, 0) AS max_amount, {sq("std")} AS std_amount,
  {sq("CASE WHEN mean > 0 THEN value / mean ELSE 1 END")} AS amount_vs_mean_ratio, {sq("CASE WHEN std > 0 THEN (value - mean) / (std + 1e-6) ELSE 0 END")} AS amount_zscore FROM m""")
def _(spark, d):
    out = windows.entity_expanding(events(spark, d)).select(
        "event_id", "tx_count", "tx_sum", "mean_amount", "max_amount", "std_amount", "amount_vs_mean_ratio", "amount_zscore")
    return rounded(out, tx_sum=2, mean_amount=4, std_amount=4, amount_vs_mean_ratio=4, amount_zscore=4)


@query("interactions", f"""WITH {EV}, {EXPANDED}
SELECT event_id, {sq("((t // 3600000000) % 24) * ln(1 + value)")} AS hour_x_amount_log,
  {sq("((t // 3600000000) % 24) * CASE WHEN std > 0 THEN (value - mean) / (std + 1e-6) ELSE 0 END", 3)} AS hour_x_zscore FROM m""")
def _(spark, d):
    df = rowwise.temporal_features(windows.entity_expanding(events(spark, d)))
    return rowwise.interactions(df).select("event_id", q("hour_x_amount_log").alias("hour_x_amount_log"), q("hour_x_zscore", 3).alias("hour_x_zscore"))


@query("scoped_log_flag", f"""WITH {EV} SELECT event_id, {sq("CASE WHEN event_type = 'purchase' THEN ln(1 + value) ELSE -1 END", 6)} AS dist_log,
  CAST(event_type = 'purchase' AND value >= 60.0 AS INTEGER) AS dist_high FROM ev""")
def _(spark, d):
    e = events(spark, d)
    out = rowwise.scoped_gradient(e, "value", F.col("event_type") == "purchase", F.lit(60.0), "dist")
    return out.select("event_id", q("dist_log", 6).alias("dist_log"), "dist_high")


PLACE, AGE = "CASE WHEN k < 50 THEN k % 5 END", "CASE WHEN k % 4 <> 0 THEN k / 2 END"
AGE_SQL = "CASE WHEN k % 4 <> 0 THEN k / 2.0::DOUBLE END"
UID_SQL = f"""uid AS (SELECT *, concat_ws('_', CAST(coalesce(user_id, -1) AS VARCHAR), coalesce(CAST({PLACE} AS VARCHAR), 'naA'),
  coalesce(CAST(CAST(floor(t / 1e6 / 86400 - age) AS BIGINT) AS VARCHAR), 'naD')) AS uid FROM (SELECT *, {AGE_SQL} AS age FROM {{src}}))"""


def with_uid(df):
    df = df.withColumns({"place": F.expr(PLACE), "age": F.expr(AGE)})
    return rowwise.cohort_key(df, "user_id", "place", "age")


@query("uid_key", f"WITH {EV}, {UID_SQL.format(src='ev')} SELECT event_id, uid FROM uid")
def _(spark, d):
    return with_uid(events(spark, d)).select("event_id", "uid")


COMBO_SQL = "substr(md5(concat_ws('_', CAST(user_id AS VARCHAR), coalesce(nullif(event_type, 'error'), '-999'))), 1, 8)"


@query("combo_hash", f"WITH {EV} SELECT event_id, {COMBO_SQL} AS combo FROM ev")
def _(spark, d):
    e = events(spark, d).select("event_id", "user_id", F.expr("nullif(event_type, 'error')").alias("kind"))
    return rowwise.combo_hash(e, ["user_id", "kind"]).select("event_id", "combo")


HOUR_BUCKET = "CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END"


@query("hour_bucket", f"WITH {EV} SELECT event_id, {HOUR_BUCKET} AS bucket FROM (SELECT event_id, (t // 3600000000) % 24 AS h FROM ev)")
def _(spark, d):
    e = rowwise.temporal_features(events(spark, d))
    return e.select("event_id", rowwise.hour_bucket(F.col("hour_of_day")).alias("bucket"))


# ---------------------------------------------------------------- joins


@query("left_join_side", """SELECT d.doc_id, d.source, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "source"])
    out = joins.left_join_side(docs, read_table(spark, d, "labels"), "doc_id")
    return out.withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})


@query("match_rate", """SELECT a.n AS rows, b.m AS side_rows, b.m / a.n AS match_rate FROM (SELECT count(*) n FROM documents) a, (SELECT count(*) m FROM labels) b""")
def _(spark, d):
    return joins.match_rate(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


FREQ = "(SELECT event_type, count(*) / (SELECT count(*) FROM sp WHERE split = 'train') AS f FROM sp WHERE split = 'train' AND event_type <> 'error' GROUP BY 1)"


@query("lookup_join", f"""WITH {SPLIT} SELECT event_id, coalesce(f.f, 0.0) AS share FROM sp LEFT JOIN {FREQ} f USING (event_type)""")
def _(spark, d):
    e = split_events(spark, d)
    train = e.where("split = 'train'")
    n = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    state = train.where("event_type <> 'error'").groupBy("event_type").agg((F.count(F.lit(1)) / n).alias("share"))
    return joins.apply_map(e, state, "event_type", {"share": 0.0}).select("event_id", "share")


@query("carried_state_join", f"""WITH {SPLIT}, s AS (SELECT user_id, count(*) AS n, sum(value) AS sm, max(value) AS mx, max(t) AS last FROM sp WHERE split = 'train' GROUP BY 1)
SELECT event_id, s.n AS c_n, {sq("s.sm", 2)} AS c_sum, s.mx AS c_max, s.last AS c_last_ts FROM sp LEFT JOIN s USING (user_id) WHERE split <> 'train'""")
def _(spark, d):
    e = split_events(spark, d)
    out = windows.with_carried(e.where("split <> 'train'"), entity_state(e.where("split = 'train'")), "user_id")
    return out.select("event_id", "c_n", q("c_sum", 2).alias("c_sum"), "c_max", "c_last_ts")


@query("split_semi_join", f"WITH {SPLIT} SELECT event_id, user_id, value FROM ev WHERE event_id IN (SELECT event_id FROM sp WHERE split = 'val')")
def _(spark, d):
    e = split_events(spark, d)
    return joins.rows_in(events(spark, d), e.where("split = 'val'"), "event_id").select("event_id", "user_id", "value")


@query("entity_sample_join", f"""WITH {EV} SELECT event_id, user_id FROM ev
WHERE CAST('0x' || substr(md5(user_id || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3""")
def _(spark, d):
    from txnlens.operators.splits import sample_entities
    return sample_entities(events(spark, d), 0.3, "user_id").select("event_id", "user_id")


# ---------------------------------------------------------------- windows


@query("gap", f"""WITH {EV}, g AS (SELECT event_id, (t - lag(t) OVER ({W})) / 1e6 AS g FROM ev)
SELECT event_id, {sq("coalesce(g, -1)")} AS since_last, {sq("CASE WHEN g > 0 THEN ln(1 + g) ELSE -1 END", 6)} AS since_last_log FROM g""")
def _(spark, d):
    out = windows.time_since_last(events(spark, d))
    return out.select("event_id", q("since_last").alias("since_last"), q("since_last_log", 6).alias("since_last_log"))


def _trailing_sql(span_s):
    return (f"(row_number() OVER ({W}) - 1 - count(*) OVER (PARTITION BY user_id ORDER BY t "
            f"RANGE BETWEEN UNBOUNDED PRECEDING AND {span_s * 1_000_000 + 1} PRECEDING))")


@query("trailing_count", f"""WITH {EV} SELECT event_id, {", ".join(f"{_trailing_sql(s)} AS tx_count_{n}" for n, s in fixed.TRAILING_SPANS_S.items())} FROM ev""")
def _(spark, d):
    return windows.trailing_counts(events(spark, d)).select("event_id", *[f"tx_count_{n}" for n in fixed.TRAILING_SPANS_S])


@query("trailing_count_ties", f"""WITH {ORD} SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) - 1
  - count(*) OVER (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 7776000000001 PRECEDING) AS tx_count_90d FROM ord""")
def _(spark, d):
    return windows.trailing_counts(orders(spark, d), ORDER_ROLES, {"90d": 7_776_000}).select("o_orderkey", "tx_count_90d")


@query("trailing_count_strict", f"""WITH {ORD} SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY t
  RANGE BETWEEN 7776000000000 PRECEDING AND 1 PRECEDING) AS tx_count_90d FROM ord""")
def _(spark, d):
    return windows.trailing_counts(orders(spark, d), ORDER_ROLES, {"90d": 7_776_000}, strict=True).select("o_orderkey", "tx_count_90d")


DAY_MEAN = f"""tr AS (SELECT *, {_trailing_sql(86400)} AS wn,
  coalesce(sum(value) OVER {PRIOR}, 0) - coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000001 PRECEDING), 0) AS ws,
  coalesce(avg(value) OVER {PRIOR}, 0) AS life FROM ev),
dm AS (SELECT *, CASE WHEN wn > 0 THEN ws / wn ELSE 0 END AS day_mean FROM tr)"""


@query("trailing_mean", f"""WITH {EV}, {DAY_MEAN} SELECT event_id, {sq("day_mean")} AS amt_24h_mean FROM dm""")
def _(spark, d):
    return windows.trailing_mean(events(spark, d)).select("event_id", q("amt_24h_mean").alias("amt_24h_mean"))


@query("short_long_ratio", f"""WITH {EV}, {DAY_MEAN} SELECT event_id, {sq("CASE WHEN life > 0 AND day_mean > 0 THEN day_mean / life ELSE 1 END")} AS amt_24h_vs_mean_ratio FROM dm""")
def _(spark, d):
    return windows.short_long_ratio(events(spark, d)).select("event_id", q("amt_24h_vs_mean_ratio").alias("amt_24h_vs_mean_ratio"))


RATE = "(SELECT avg(y) FROM sp WHERE split = 'train')"


def train_rate(df):
    return df.where("split = 'train'").agg(F.avg("y")).scalar()


@query("target_enc", f"""WITH {SPLIT}, k AS (SELECT *, nullif(event_type, 'error') AS kind FROM sp)
SELECT event_id, {", ".join(sq(f"(coalesce(sum(y) OVER {c}, 0) + 10 * {RATE}) / (count(*) OVER {c} + 10)", 8) + f" AS {n}_target_enc" for n, c in
  (("user_id", "a"), ("kind", "b")))} FROM k
WINDOW a AS {PRIOR}, b AS (PARTITION BY kind ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    e = split_events(spark, d).withColumn("kind", F.expr("nullif(event_type, 'error')"))
    out = windows.target_encode(e, ["user_id", "kind"], train_rate(e))
    return out.select("event_id", q("user_id_target_enc", 8).alias("user_id_target_enc"), q("kind_target_enc", 8).alias("kind_target_enc"))


@query("target_enc_lagged", f"""WITH {SPLIT}
SELECT event_id, {sq(f"(coalesce(sum(y) OVER w, 0) + 10 * {RATE}) / (count(*) OVER w + 10)", 8)} AS user_id_target_enc FROM sp
WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 432000000000 PRECEDING)""")
def _(spark, d):
    e = split_events(spark, d)
    out = windows.target_encode_lagged(e, ["user_id"], train_rate(e), 432_000)
    return out.select("event_id", q("user_id_target_enc", 8).alias("user_id_target_enc"))


@query("expanding_split_order", f"""WITH {SPLIT}
SELECT event_id, split, {sq(f"(coalesce(sum(y) OVER {PRIOR}, 0) + 10 * {RATE}) / (count(*) OVER {PRIOR} + 10)", 8)} AS user_id_target_enc FROM sp""")
def _(spark, d):
    e = split_events(spark, d)
    # Each later split continues from the label totals of the splits before it.
    parts, earlier = None, []
    for name in ("train", "val", "test"):
        own = windows.prior(e.where(F.col("split") == name), ["user_id"], ["t", "event_id"],
                            {"_n": ("count", F.lit(1)), "_y": ("sum", F.col("y"))})
        if earlier:
            totals = label_totals(e.where(F.col("split").isin(earlier)), "user_id")
            own = own.join(totals, "user_id", "left")
        else:
            own = own.withColumns({"label_sum": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
        parts = own if parts is None else parts.unionByName(own)
        earlier.append(name)
    y = F.coalesce("_y", F.lit(0)) + F.coalesce("label_sum", F.lit(0))
    n = F.col("_n") + F.coalesce("n", F.lit(0))
    enc = windows.smoothed(y, n, train_rate(e), fixed.TARGET_PRIOR_WEIGHT)
    return parts.select("event_id", "split", q(enc, 8).alias("user_id_target_enc"))


@query("tail_per_entity", f"WITH {EV} SELECT event_id, user_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) <= 9")
def _(spark, d):
    return windows.last_k(events(spark, d), 9).select("event_id", "user_id")


TENURE_SQL = """tn AS (SELECT *, row_number() OVER (ORDER BY {col}, t, event_id) - 1 AS r, count(*) OVER () AS n FROM {src})"""


@query("tenure_bucket", f"""WITH {EV}, c AS (SELECT *, row_number() OVER ({W}) - 1 AS seen FROM ev), {TENURE_SQL.format(col="seen", src="c")}
SELECT event_id, CAST(greatest(ceil(r * 4 / (n - 1)) - 1, 0) AS INTEGER) AS tenure FROM tn""")
def _(spark, d):
    seen = windows.prior(events(spark, d), ["user_id"], ["t", "event_id"], {"seen": ("count", F.lit(1))})
    return windows.quantile_bucket(seen, "seen", 4, ["t", "event_id"], "tenure").select("event_id", "tenure")


@query("global_rank", f"WITH {EV} SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS rank FROM ev")
def _(spark, d):
    return global_rank(events(spark, d), ["value", "event_id"]).select("event_id", "rank")


@query("features_velocity", f"""WITH {EV}, {DAY_MEAN}, {EXPANDED.replace("FROM ev", "FROM dm")}
SELECT event_id, n AS tx_count, {sq("mean")} AS mean_amount, {sq("std")} AS std_amount, {sq("CASE WHEN std > 0 THEN (value - mean) / (std + 1e-6) ELSE 0 END")} AS amount_zscore,
  wn AS tx_count_24h, {sq("day_mean")} AS amt_24h_mean, {sq("CASE WHEN life > 0 AND day_mean > 0 THEN day_mean / life ELSE 1 END")} AS amt_24h_vs_mean_ratio FROM m""")
def _(spark, d):
    out = windows.velocity_features(events(spark, d)).select(
        "event_id", "tx_count", "mean_amount", "std_amount", "amount_zscore", "tx_count_24h", "amt_24h_mean", "amt_24h_vs_mean_ratio")
    return rounded(out, mean_amount=4, std_amount=4, amount_zscore=4, amt_24h_mean=4, amt_24h_vs_mean_ratio=4)


@query("entity_state", f"""WITH {EV} SELECT user_id, count(*) AS n, {sq("sum(value)", 2)} AS sum, {sq("sum(value * value)", 2)} AS sum_sq, max(value) AS max, max(t) AS last_ts FROM ev GROUP BY 1""")
def _(spark, d):
    return rounded(entity_state(events(spark, d)), sum=2, sum_sq=2)


@query("entity_recent", f"WITH {EV} SELECT user_id, t, event_id, value FROM ev QUALIFY t >= max(t) OVER (PARTITION BY user_id) - 86400000000")
def _(spark, d):
    return entity_recent(events(spark, d))


@query("entity_totals", f"""WITH {EV} SELECT nullif(event_type, 'error') AS kind, CAST(sum(y) AS BIGINT) AS label_sum, count(*) AS n FROM ev GROUP BY 1""")
def _(spark, d):
    return label_totals(events(spark, d).withColumn("kind", F.expr("nullif(event_type, 'error')")), "kind")
