"""Fit-on-train, apply-elsewhere encoders. ``fit_*`` gives state tables, ``apply_*`` uses them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import PCA, Bucketizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions import fixed
from txnlens.functions.rowwise import combo_hash
from txnlens.operators.joins import apply_map
from txnlens.operators.ordered import INF, Chunks, plan_chunks, prior
from txnlens.session import cut_lineage


def frequency(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Share of each non-null value among the non-null rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(col)).scalar()
    return counts.select(col, (F.col("_n") / total).alias(out or f"{col}_freq"))


def apply_frequency(df: DataFrame, state: DataFrame, col: str) -> DataFrame:
    out = next(c for c in state.columns if c != col)
    return apply_map(df, state, col, {out: 0.0})


def combo_frequency(train: DataFrame, df: DataFrame, cols: Sequence[str], out: str = "combo_freq") -> DataFrame:
    """Train frequency of a column combination's digest; unseen combinations get 0."""
    state = frequency(combo_hash(train, cols, "_combo"), "_combo", out)
    return apply_frequency(combo_hash(df, cols, "_combo"), state, "_combo").drop("_combo")


def fit_labels(df: DataFrame, col: str, chunks: Chunks = None) -> DataFrame:
    """Codes by position in the sorted distinct values, with MISSING always among them.

    The values are dealt out by ranges and sorted in them; a value's code is its place there after the sizes of the ranges
    before. ``chunks`` is the number of ranges, if not that of the session.
    """
    values = df.select(F.coalesce(F.col(col).cast("string"), F.lit(fixed.MISSING)).alias(col))
    spark = df.sparkSession
    distinct = values.unionByName(spark.range(1).select(F.lit(fixed.MISSING).alias(col))).distinct()
    ranges = distinct.repartitionByRange(chunks, col) if isinstance(chunks, int) else distinct.repartitionByRange(col)
    table = cut_lineage(ranges.withColumn("_range", F.spark_partition_id()))
    sizes = table.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # A row a range.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(col)) - 1
    return table.withColumn("_place", place).join(before, "_range").select(
        col, (F.col("_before") + F.col("_place")).cast("int").alias(f"{col}_code"))


def apply_labels(df: DataFrame, state: DataFrame, col: str) -> DataFrame:
    """Null and unseen values take the code of MISSING."""
    code = f"{col}_code"
    missing = state.where(F.col(col) == fixed.MISSING).select(code).scalar()
    keyed = df.withColumn("_v", F.coalesce(F.col(col).cast("string"), F.lit(fixed.MISSING)))
    return keyed.join(state.withColumnRenamed(col, "_v"), "_v", "left").withColumn(
        code, F.coalesce(F.col(code), missing)).drop("_v")


def cohort_stats(df: DataFrame, key: str, amount: str, age: str, min_count: int = fixed.COHORT_MIN_COUNT) -> DataFrame:
    """Row count of every cohort; mean, population deviation and mean age only from ``min_count`` rows on."""
    big = F.count(F.lit(1)) >= min_count
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("uid_count"),
        F.when(big, F.avg(amount)).alias("uid_amt_mean"),
        F.when(big, F.stddev_pop(amount)).alias("uid_amt_std"),
        F.when(big, F.avg(age)).alias("uid_age_mean"))


def apply_cohorts(train: DataFrame, df: DataFrame, key: str, amount: str, age: str,
                  min_count: int = fixed.COHORT_MIN_COUNT) -> DataFrame:
    """Cohort features with global train fallbacks; the ratio is neutral outside real cohorts."""
    state = cohort_stats(train, key, amount, age, min_count)
    whole = train.agg(
        F.count(F.lit(1)).alias("n"), F.avg(amount).alias("mean"), F.stddev_pop(amount).alias("std"),
        F.coalesce(F.avg(age), F.lit(fixed.HISTORY_FILL)).alias("age"))
    g = lambda c: F.coalesce(whole.select(c).scalar(), F.lit(0.0))
    out = apply_map(df, state, key, {
        "uid_count": F.lit(0).cast("long"), "uid_amt_mean": g("mean"), "uid_amt_std": g("std"), "uid_age_mean": g("age")})
    real = (F.col("uid_count") >= min_count) & (F.col("uid_amt_mean") > 0)
    return out.withColumns({
        "uid_freq": F.col("uid_count") / F.greatest(whole.select("n").scalar(), F.lit(1)),
        "uid_amt_ratio": F.when(real, F.col(amount) / F.col("uid_amt_mean")).otherwise(1.0)})


def impute(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Strings to MISSING, numbers to -999."""
    cols = {}
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.StringType):
            cols[f.name] = F.coalesce(F.col(f.name), F.lit(fixed.MISSING))
        elif isinstance(f.dataType, T.NumericType):
            cols[f.name] = F.coalesce(F.col(f.name), F.lit(fixed.NUMERIC_FILL).cast(f.dataType))
    return df.withColumns(cols)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], chunks: Chunks = None) -> DataFrame:
    """``(prob, value)`` by linear interpolation between order statistics, exact at any size.

    Distinct values are counted first; each looks only at the probabilities whose ranks can fall on it.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    plan = plan_chunks(values, "v", None, chunks)
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranked = prior(counts, [], ["v"], {"s": ("sum", F.col("c"))}, plan)
    total = df.agg(F.count(col)).scalar()
    ranked = ranked.withColumns({"s": F.coalesce("s", F.lit(0)), "n": total})
    n = F.col("n")
    probs = sorted(float(q) for q in probs)
    cell = lambda q: F.struct(q.alias("prob"), F.floor((n - 1) * q).alias("lo"), F.ceil((n - 1) * q).alias("hi"))
    here = lambda r: (F.col("s") <= r) & (r < F.col("s") + F.col("c"))
    even = len(probs) > 16 and all(abs(q - i / (len(probs) - 1)) < 1e-12 for i, q in enumerate(probs))
    if even:
        m = len(probs) - 1
        first = F.greatest(F.floor((F.col("s") - 1) / F.greatest(n - 1, F.lit(1)) * m), F.lit(0))
        last = F.least(F.ceil((F.col("s") + F.col("c") + 1) / F.greatest(n - 1, F.lit(1)) * m), F.lit(m))
        # Written as a range, so the plan doesn't hold a term a probability.
        cells = F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda i: cell(i.cast("double") / float(m)))
    else:
        cells = F.array(*[cell(F.lit(q)) for q in probs])
    hits = ranked.select("v", "s", "c", "n", F.explode(F.filter(cells, lambda x: here(x["lo"]) | here(x["hi"]))).alias("x"))
    ends = hits.groupBy("x.prob").agg(
        F.max(F.when(here(F.col("x.lo")), F.col("v"))).alias("lo"),
        F.max(F.when(here(F.col("x.hi")), F.col("v"))).alias("hi"),
        F.max((n - 1) * F.col("x.prob") - F.col("x.lo")).alias("part"))
    return ends.select("prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def grouped_quantiles(df: DataFrame, by: str, col: str, probs: Sequence[float], chunks: Chunks = None) -> DataFrame:
    """``(by, prob, value)`` as in ``exact_quantiles``, for every group of ``by``; null is a group of its own."""
    values = df.where(F.col(col).isNotNull()).select(F.struct(by).alias("_g"), F.col(col).cast("double").alias("v"))
    plan = plan_chunks(values, "v", None, chunks)
    counts = values.groupBy("_g", "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = prior(counts, ["_g"], ["v"], {"s": ("sum", F.col("c"))}, plan if plan.plain else plan.for_all())
    n = F.col("n")
    at = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("prob"), ((n - 1) * F.lit(float(q))).alias("at")) for q in probs]))
    here = lambda r: (F.col("s") <= r) & (r < F.col("s") + F.col("c"))
    lo, hi = F.floor("x.at"), F.ceil("x.at")
    hits = ranked.withColumn("s", F.coalesce("s", F.lit(0))).join(
        counts.groupBy("_g").agg(F.sum("c").alias("n")), "_g").withColumn("x", at).where(here(lo) | here(hi))
    ends = hits.groupBy("_g", "x.prob").agg(
        F.max(F.when(here(lo), F.col("v"))).alias("lo"), F.max(F.when(here(hi), F.col("v"))).alias("hi"),
        F.max(F.col("x.at") - lo).alias("part"))
    return ends.select(F.col(f"_g.{by}").alias(by), "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def fit_quantile(df: DataFrame, col: str, q: float = 0.8, chunks: Chunks = None) -> DataFrame:
    return exact_quantiles(df, col, [q], chunks).select(F.col("value").alias("cut"))


# Coefficients of a rational approximation of the inverse normal distribution function.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
# Tail limit of the middle formula, and the clip of the transformed value.
_TAIL = 0.02425
NORMAL_CLIP = 5.199337582605575


def _poly(x: Column, coef: Sequence[float]) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def with_inverse_normal(df: DataFrame, u: str, out: str) -> DataFrame:
    """Standard normal quantile of a column in (0, 1), relative error below 1.2e-9, clipped at both ends.

    The steps are columns of their own, so that no expression is repeated in generated code.
    """
    df = df.withColumn("_q", F.col(u) - 0.5).withColumns({
        "_s": F.col("_q") * F.col("_q"),
        "_r": F.sqrt(-2 * F.log(F.when(F.col("_q") < 0, F.col(u)).otherwise(1 - F.col(u))))})
    middle = _poly(F.col("_s"), _A) * F.col("_q") / (_poly(F.col("_s"), _B) * F.col("_s") + 1)
    tail = _poly(F.col("_r"), _C) / (_poly(F.col("_r"), _D) * F.col("_r") + 1)
    z = F.when(F.col(u) < _TAIL, tail).when(F.col(u) > 1 - _TAIL, -tail).otherwise(middle)
    clipped = F.greatest(F.least(z, F.lit(NORMAL_CLIP)), F.lit(-NORMAL_CLIP))
    ends = F.when(F.col(u) <= 0, -NORMAL_CLIP).when(F.col(u) >= 1, NORMAL_CLIP)
    return df.withColumn(out, F.when(F.col(u).isNotNull(), ends.otherwise(clipped))).drop("_q", "_s", "_r")


def fit_normal_scores(df: DataFrame, col: str, n: int = 1000, chunks: Chunks = None) -> list[float]:
    """The train quantiles of a column, at most ``n`` numbers."""
    rows = exact_quantiles(df, col, [i / (n - 1) for i in range(n)], chunks).orderBy("prob").collect()
    return [r["value"] for r in rows]


def apply_normal_scores(df: DataFrame, col: str, quantiles: Sequence[float], out: str) -> DataFrame:
    """Piecewise-linear rank in the train quantiles, then the normal quantile of it."""
    n = len(quantiles)
    # Equal quantiles share one knot in the middle of their ranks.
    knots: dict[float, list[int]] = {}
    for i, v in enumerate(quantiles):
        knots.setdefault(float(v), []).append(i)
    xs = sorted(knots)
    us = [(min(knots[x]) + max(knots[x])) / 2 / max(n - 1, 1) for x in xs]
    if len(xs) < 2:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(0.0)))
    keyed = df.withColumn("_x", F.col(col).cast("double"))
    binned = Bucketizer(splits=[-INF, *xs[1:-1], INF], inputCol="_x", outputCol="_k", handleInvalid="keep").transform(keyed) \
        if len(xs) > 2 else keyed.withColumn("_k", F.lit(0.0))
    # One parsed expression; a column object a knot would take longer than the query.
    knot_x, knot_u = (F.expr("array(" + ", ".join(f"double('{v!r}')" for v in values) + ")") for values in (xs, us))
    k = binned.withColumn("_k", F.least(F.col("_k"), F.lit(len(xs) - 2)).cast("int"))
    k = k.withColumns({
        "_x0": F.get(knot_x, F.col("_k")), "_x1": F.get(knot_x, F.col("_k") + 1),
        "_u0": F.get(knot_u, F.col("_k")), "_u1": F.get(knot_u, F.col("_k") + 1)})
    inside = F.col("_u0") + (F.col("_u1") - F.col("_u0")) * (F.col("_x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    u = (
        F.when(F.col("_x") < xs[0], 0.0).when(F.col("_x") > xs[-1], 1.0)
        .when(F.col("_x") == xs[0], us[0]).when(F.col("_x") == xs[-1], us[-1]).otherwise(inside))
    ranked = k.withColumn("_u", F.when(F.col("_x").isNotNull(), u)).drop("_x", "_k", "_x0", "_x1", "_u0", "_u1")
    return with_inverse_normal(ranked, "_u", out).drop("_u")


def fit_pca(train: DataFrame, vector: str, k: int = 30):
    """Centred components of a numeric block, nulls as zero. Returns the two fitted Spark ML stages."""
    first = train.select(F.size(vector).alias("d")).first()
    k = min(k, first["d"], train.count())
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred")
    block = train.select(_block(vector).alias("_raw"))
    scaler = centred.fit(block)
    return scaler, PCA(k=k, inputCol="_centred", outputCol="_pca").fit(scaler.transform(block))


def _block(vector: str) -> Column:
    return array_to_vector(F.transform(F.col(vector), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))


def apply_pca(df: DataFrame, stages, vector: str, prefix: str = "pca_v") -> DataFrame:
    """Replace the block by its component columns."""
    scaler, pca = stages
    out = pca.transform(scaler.transform(df.withColumn("_raw", _block(vector)))).withColumn("_pca", vector_to_array("_pca"))
    cols = {f"{prefix}_{i}": F.get("_pca", F.lit(i)) for i in range(pca.getK())}
    return out.withColumns(cols).drop(vector, "_raw", "_centred", "_pca")


def explained_variance(spark, stages) -> DataFrame:
    """Share of the variance each component keeps, and the running total."""
    shares = [float(x) for x in stages[1].explainedVariance]
    rows = [(i, s, math.fsum(shares[: i + 1])) for i, s in enumerate(shares)]
    return spark.createDataFrame(rows, "component int, share double, total double")
