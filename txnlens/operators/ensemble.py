"""Blends of model scores and the search for their weights."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlens import session
from txnlens.functions import fixed
from txnlens.operators.business import Costs, optimal_threshold
from txnlens.operators.curves import average_precision
from txnlens.operators.ordered import Chunks, plan_chunks
from txnlens.session import cut_lineage, rows_at_most, spread

Weights = dict[str, float]


def blend(weights: Weights) -> Column:
    """Weighted sum of score columns, without renormalising."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(m) for m, w in weights.items()])


def checked_blend(df: DataFrame, weights: Weights, scores: Sequence[str], out: str = "p") -> DataFrame:
    if set(weights) != set(scores):
        raise ValueError("weights and scores must name the same models")
    return df.withColumn(out, blend(weights))


def axis(low: float, high: float, parts: int) -> list[float]:
    return [low + (high - low) * i / parts for i in range(parts)] + [high]


def simplex_points(axes: Sequence[Sequence[float]]) -> list[tuple[float, ...]]:
    """Weight vectors from the axes of all models but the last, which takes the rest; negative rests drop out."""
    points: list[tuple[float, ...]] = [()]
    for values in axes[:-1]:
        points = [(*p, v) for p in points for v in values if sum(p) + v <= 1.0 + 1e-9]
    return [(*p, max(0.0, 1.0 - sum(p))) for p in points]


def simplex_grid(spark: SparkSession, models: Sequence[str], step: float) -> DataFrame:
    """The weight vectors of a step as a table ``(point, <model>...)``."""
    parts = max(1, round(1 / step))
    points = simplex_points([axis(0.0, 1.0, parts)] * len(models))
    return points_table(spark, models, points)


def points_table(spark: SparkSession, models: Sequence[str], points: Iterable[Sequence[float]]) -> DataFrame:
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "point int, " + ", ".join(f"w_{m} double" for m in models))


def blended_points(df: DataFrame, models: Sequence[str], grid: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Score table blended at every grid point: distinct score tuples first, then one row per point.

    The grid is a parameter list (1,326 points at the default step), carried as one array literal row.
    """
    cells = grid.agg(F.array_sort(F.collect_list(F.struct("point", *[f"w_{m}" for m in models]))).alias("g")).scalar()
    value = reduce(lambda a, b: a + b, [F.col(f"g.w_{m}") * F.col(m) for m in models])
    return df.withColumn("g", F.explode(cells)).select(*keep, F.col("g.point").alias("point"), value.alias("p"))


def _distinct_scores(df: DataFrame, models: Sequence[str], y: str, weight: Column | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    w = F.lit(1).cast("long") if weight is None else weight
    return df.groupBy(*by, *models, F.col(y).alias("y")).agg(F.sum(w).alias("w"))


def grid_ap(df: DataFrame, models: Sequence[str], grid: DataFrame, y: str = "y", by: Sequence[str] = (),
            weight: Column | None = None, chunks: Chunks = None) -> DataFrame:
    """Average precision at every grid point."""
    spark = df.sparkSession
    # Spread the tuples before each becomes one row per grid point; an explicit number is not coalesced again.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tuples = _distinct_scores(df, models, y, weight, by).repartition(parts, *by, *models)
    scored = blended_points(tuples, models, grid, [*by, "y", "w"])
    if chunks is not None or not rows_at_most(df.select(*models), session.ROWS_PER_CHUNK)[0]:
        # Boundaries from the pooled model scores; the blends lie in the same range.
        pooled = df.select(F.explode(F.array(*[-F.col(m).cast("double") for m in models])).alias("_desc"))
        plan = plan_chunks(pooled, "_desc", None, chunks).for_all()
        return average_precision(scored, "y", "p", [*by, "point"], F.col("w"), plan)
    # Every point sees each tuple once, so small tables need no second grouping: ties share a RANGE frame.
    hit = F.when(F.col("y") == 1, F.col("w")).otherwise(0)
    down = Window.partitionBy(*by, "point").orderBy(F.desc("p"))
    run = scored.select(
        *by, "point", hit.alias("pos"), F.sum(hit).over(down).alias("tp"), F.sum("w").over(down).alias("flagged"))
    total = F.sum("pos")
    return run.groupBy(*by, "point").agg(F.when(total > 0, F.sum(F.col("pos") * F.col("tp") / F.col("flagged")) / total).alias("ap"))


# Bins of a point's histogram in the first round and at most, the growth from round to round, and rows of weights a batch.
FIRST_BINS, MOST_BINS, BIN_GROWTH, ROUNDS = 256, 1 << 15, 8, 6
# Points, of one search and of each of many resamples, whose exact curves are cheaper than another round.
FEW_POINTS, FEW_RESAMPLED = 4, 4
# Resamples in one packed histogram row.
SLICE = 8
_SLACK = 1e-9


def ap_gaps(pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the share of each bin in the average precision; bins from the highest score down hold positives and all rows.

    Within a bin the precision is highest if its positives come first with one score, and lowest if its negatives come
    first and the positives one by one, a sum of a concave function, which is not below its integral from one half on.
    """
    pos, neg = pos.astype(float), (n - pos).astype(float)
    tp, fp = (np.cumsum(x) - x for x in (pos, neg))
    with np.errstate(divide="ignore", invalid="ignore"):
        high = np.where(pos > 0, pos * (tp + pos) / (tp + fp + pos), 0.0)
        seen, ahead = tp + fp + neg, fp + neg
        low = pos - ahead * np.log((seen + pos + 0.5) / (seen + 0.5))
        return low / pos.sum(), high / pos.sum()


def finer_edges(edges: np.ndarray, pos: np.ndarray, gap: np.ndarray, bins: int) -> np.ndarray:
    """Ascending ``bins`` bins or fewer: neighbours without positives are joined, the others split where the bounds are apart."""
    empty = pos == 0
    start = np.flatnonzero(~(empty & np.r_[False, empty[:-1]]))
    low, high = edges[start], edges[np.r_[start[1:], len(edges) - 1]]
    share = np.sqrt(np.maximum(np.add.reduceat(np.where(empty, 0.0, gap), start), 0.0))
    parts = np.ones(len(start), np.int64)
    if share.sum() > 0 and bins > len(start):
        parts += ((bins - len(start)) * share / share.sum()).astype(np.int64)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.unique(np.r_[np.repeat(low, parts) + np.repeat((high - low) / parts, parts) * at, edges[-1]])


# Row weights a batch of rows holds, about: rows x resamples.
BATCH_CELLS = 1 << 22
#: By point: its weights, its bin edges, and the resamples in which it is open.
Open = dict[int, tuple[tuple[float, ...], np.ndarray, list[int]]]


def gathered(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The batches joined to about ``size`` rows each, so that what is done once a batch counts less."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= size:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def score_histograms(df: DataFrame, models: Sequence[str], points: Open) -> DataFrame:
    """``(point, slice, kind, cells)`` of rows ``(y, ws, <model>...)``, ``ws`` being the weight of the row in each resample.

    ``cells`` packs negatives and positives of every bin for some resamples of the point, in the smallest integer ``kind`` that
    holds them. A batch of rows is added up before anything is sent, one point at a time; histograms of batches add up.
    """
    widest = max((max(own) for _, _, own in points.values()), default=0) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in gathered(batches, BATCH_CELLS // widest):
            y, ws = batch["y"].to_numpy() == 1, np.stack(batch["ws"].to_numpy())
            columns = [batch[m].to_numpy(float) for m in models]
            for point, (weights, edges, own) in points.items():
                # In the order of the SQL expression, so that ties are the same.
                value = reduce(lambda x, z: x + z, [v * c for v, c in zip(weights, columns)])
                cell = 2 * np.searchsorted(edges[1:-1], value, side="right") + y
                size = 2 * (len(edges) - 1)
                if len(own) > SLICE:
                    order = np.argsort(cell, kind="stable")
                    start = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    sums = np.zeros((len(own), size), np.int64)
                    sums[:, cell[order[start]]] = np.add.reduceat(ws[order], start, axis=0)[:, own].T
                else:
                    sums = np.stack([np.bincount(cell, ws[:, b], size) for b in own]).astype(np.int64)
                for i in range(0, len(own), SLICE):
                    kind = np.min_scalar_type(sums[i:i + SLICE].max())
                    packed = sums[i:i + SLICE].astype(kind).tobytes()
                    yield pd.DataFrame({"point": [point], "slice": [i // SLICE], "kind": [kind.str], "cells": [packed]})

    return df.select("y", "ws", *models).mapInPandas(run, "point int, slice int, kind string, cells binary")


def point_bounds(histograms: DataFrame, points: Open, bins: int) -> DataFrame:
    """``(b, point, low, high, edges)``: bounds of the precision of each point in each resample; ``edges``, finer bins for the
    point, come with its first resample only. A group has a row for each batch of rows."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        point, part = int(key[0]), int(key[1])
        _, edges, own = points[point]
        own = own[part * SLICE:(part + 1) * SLICE]
        sums = np.zeros(len(own) * 2 * (len(edges) - 1), np.int64)
        for kind, cells in zip(rows["kind"], rows["cells"]):
            sums += np.frombuffer(cells, kind)
        out, finer = [], None
        for b, both in zip(own, sums.reshape(len(own), -1)):
            pos, n = both[1::2], both[::2] + both[1::2]
            # Without positives there are no bounds and no precision; all points stay.
            low, high = ap_gaps(pos[::-1], n[::-1])
            if part == 0 and finer is None and pos.any():
                finer = finer_edges(edges, pos, np.nan_to_num((high - low)[::-1]), bins).tobytes()
            out.append((b, point, low.sum(), high.sum(), None))
        out[0] = (*out[0][:4], finer)
        return pd.DataFrame(out, columns=["b", "point", "low", "high", "edges"])

    return histograms.groupBy("point", "slice").applyInPandas(run, "b int, point int, low double, high double, edges binary")


def bounded_search(df: DataFrame, models: Sequence[str], points: Sequence[Sequence[float]], y: str = "y", resamples: Column | None = None,
                   b: int = 1, chunks: Chunks = None) -> DataFrame:
    """``(b, w_<model>..., ap)``: the point with the highest average precision in each resample, the first on ties; as exact as trying all.

    ``resamples`` is an array column of row weights, one a resample. Histograms bound every point from both sides, points that can't
    win drop out, and those left get finer histograms, until few are left for exact curves.
    """
    spark = df.sparkSession
    scores = [f"_s{i}" for i in range(len(models))]
    clean = reduce(Column.__and__, [F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")) for m in models])
    ws = F.array(F.lit(1).cast("long")) if resamples is None else resamples
    # Rows of one time lie together in the input; spread, no task draws their weights and bins them alone.
    rows = cut_lineage(spread(df.where(clean)).select(F.col(y).alias("y"), ws.alias("ws"), *[F.col(m).cast("double").alias(s) for m, s in zip(models, scores)]))
    ends = rows.agg(F.min(F.least(*scores, scores[0])), F.max(F.greatest(*scores, scores[0]))).first()
    own = dict(enumerate(map(tuple, points)))
    left = {i: set(own) for i in range(b)}
    if ends[0] is not None:
        first = np.linspace(*ends, FIRST_BINS + 1) if ends[0] < ends[1] else np.array([ends[0], ends[0] + 1.0])
        edges = dict.fromkeys(own, first)
        bins = FIRST_BINS
        for _ in range(ROUNDS):
            again = {i for i, some in left.items() if len(some) > (FEW_POINTS if b == 1 else FEW_RESAMPLED)}
            open_ = {p: (w, edges[p], [i for i in sorted(again) if p in left[i]]) for p, w in own.items()}
            open_ = {p: x for p, x in open_.items() if x[2]}
            if not open_:
                break
            finer = min(bins * BIN_GROWTH, MOST_BINS)
            found = point_bounds(score_histograms(rows, scores, open_), open_, finer).collect()
            edges |= {r["point"]: np.frombuffer(r["edges"]) for r in found if r["edges"] is not None}
            lows, highs = ({i: {} for i in again} for _ in range(2))
            for i, point, low, high, _ in found:
                # Without positives there are no bounds; the point stays.
                lows[i][point], highs[i][point] = (-1.0 if low is None or math.isnan(low) else low), (math.inf if high is None or math.isnan(high) else high)
            best = {i: max(low.values()) for i, low in lows.items()}
            keep = {i: {p for p, high in highs[i].items() if not high < best[i] - _SLACK} for i in again}
            # Points of equal ranking stay together however fine the bins are.
            stuck = bins == MOST_BINS and all(len(keep[i]) == len(left[i]) for i in again)
            left |= keep
            if stuck:
                break
            bins = finer
    names = [f"w_{m}" for m in models]
    table = spark.createDataFrame([(i, p, *own[p]) for i, some in left.items() for p in sorted(some)], "b int, point int, " + ", ".join(f"{n} double" for n in names))
    each = rows.select("y", *scores, F.posexplode("ws").alias("b", "w")).where("w > 0").groupBy("b", *scores, "y").agg(F.sum("w").alias("w"))
    value = reduce(lambda x, z: x + z, [F.col(f"w_{m}") * F.col(s) for m, s in zip(models, scores)])
    scored = each.join(F.broadcast(table), "b").select("b", "point", "y", "w", value.alias("p"))
    ap = average_precision(scored, "y", "p", ["b", "point"], F.col("w"), chunks)
    best = ap.groupBy("b").agg(F.max_by(F.struct("point", "ap"), F.struct(F.round("ap", 10), -F.col("point"))).alias("best")).select("b", "best.*")
    return best.join(F.broadcast(table), ["b", "point"]).select("b", *names, "ap")


def _grid(models: Sequence[str], step: float) -> list[tuple[float, ...]]:
    parts = max(1, round(1 / step))
    return simplex_points([axis(0.0, 1.0, parts)] * len(models))


def search_coarse(df: DataFrame, models: Sequence[str], step: float = 0.02, y: str = "y",
                  chunks: Chunks = None) -> DataFrame:
    """One row: the grid weights with the highest average precision, the first on ties."""
    return bounded_search(df, models, _grid(models, step), y, chunks=chunks).drop("b")


def search_weights(df: DataFrame, models: Sequence[str], step: float = 0.02, refine: float = 0.002, y: str = "y",
                   chunks: Chunks = None) -> DataFrame:
    """Coarse search, then a finer grid within one step around the winner; the better of the two.

    Only the one winning row comes to the driver between the passes.
    """
    coarse = search_coarse(df, models, step, y, chunks)
    if len(models) == 1:
        return coarse
    won = coarse.first()
    parts = max(1, round(step * 2 / refine))
    axes = [axis(max(0.0, won[f"w_{m}"] - step), min(1.0, won[f"w_{m}"] + step), parts) for m in models]
    points = simplex_points(axes)
    first = tuple(won[f"w_{m}"] for m in models)
    return bounded_search(df, models, [*points, first], y, chunks=chunks).drop("b")


# Cumulative Poisson(1) probabilities, sum of exp(-1) / i! up to each count.
POISSON_CUTS = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(8))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform column."""
    return reduce(lambda a, b: a + b, [(u >= c).cast("long") for c in POISSON_CUTS])


def resample_weights(key: str, b: int) -> Column:
    """Poisson(1) weights of a row in the resamples 0 to ``b`` - 1, as an array.

    The draws are an array of their own: inside one expression each of the cuts would compute its draw anew.
    """
    def draw(i: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), i.cast("string"))), 1, 8), 16, 10)
        return u.cast("double") / float(1 << 32)

    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), draw), poisson_weight)


def bootstrap_samples(df: DataFrame, models: Sequence[str], key: str, b: int = 50, y: str = "y") -> DataFrame:
    """Each row with its Poisson weight in each of ``b`` resamples; weight 0 drops out."""
    rows = spread(df.select(*dict.fromkeys([key, y, *models])))
    return rows.select(key, y, *models, F.posexplode(resample_weights(key, b)).alias("b", "w")).where("w > 0")


def bootstrap_best(df: DataFrame, models: Sequence[str], key: str, b: int = 50, step: float = 0.05, y: str = "y",
                   chunks: Chunks = None) -> DataFrame:
    """``(b, w_<model>..., ap)``: the best weights in each of ``b`` resamples."""
    return bounded_search(df, models, _grid(models, step), y, resample_weights(key, b), b, chunks)


def bootstrap_weights(df: DataFrame, models: Sequence[str], key: str, b: int = 50, step: float = 0.05, y: str = "y",
                      chunks: Chunks = None) -> DataFrame:
    """Mean, deviation and 5/95 percentiles of each model's best weight over the resamples."""
    best = bootstrap_best(df, models, key, b, step, y, chunks)
    long = best.select("b", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"w_{m}").alias("w")) for m in models])).alias("x")).select("b", "x.*")
    return long.groupBy("model").agg(
        F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"),
        F.percentile("w", F.lit(0.05)).alias("p05"), F.percentile("w", F.lit(0.95)).alias("p95"))


def min_lift_gate(with_third: DataFrame, without: DataFrame, lift: float = fixed.MIN_LIFT) -> DataFrame:
    """Keep the third model only when validation AP rises by at least ``lift``."""
    a, b = with_third.select("ap").scalar(), without.select("ap").scalar()
    one = with_third.select(a.alias("ap_with"), b.alias("ap_without"))
    gain = F.col("ap_with") - F.col("ap_without")
    return one.withColumns({"lift": gain, "keep": (gain >= lift).cast("int")})


def weight_curve(df: DataFrame, a: str, b: str, n: int = 101, y: str = "y", chunks: Chunks = None) -> DataFrame:
    """Average precision along the line between two models; ``weight`` is the share of ``a``."""
    grid = points_table(df.sparkSession, [a, b], [(w, 1.0 - w) for w in axis(0.0, 1.0, n - 1)])
    ap = grid_ap(df, [a, b], grid, y, chunks=chunks)
    return ap.join(F.broadcast(grid), "point").select(F.col(f"w_{a}").alias("weight"), "ap")


def mode_spec(df: DataFrame, modes: dict[str, Weights], costs: Costs = Costs(fn=0.0), y: str = "y") -> DataFrame:
    """Scoring modes with their weights and their own validation threshold."""
    scored = df.select(F.col(y).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("mode"), blend(w).alias("p")) for name, w in modes.items()])).alias("m")).select("y", "m.*")
    best = optimal_threshold(scored, costs, by=["mode"])
    pairs = [(name, m, float(w)) for name, ws in modes.items() for m, w in ws.items()]
    spec = df.sparkSession.createDataFrame(pairs, "mode string, model string, weight double")
    return spec.join(F.broadcast(best.select("mode", "threshold")), "mode")


def mode_violations(modes: DataFrame) -> DataFrame:
    """Modes whose weights do not sum to 1, repeat a model, or whose threshold leaves [0, 1]."""
    checked = modes.groupBy("mode").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("models"),
        F.min("threshold").alias("low"), F.max("threshold").alias("high"))
    bad = (F.abs(F.col("total") - 1) > 1e-6) | (F.col("n") != F.col("models")) | (F.col("low") < 0) | (F.col("high") > 1)
    return checked.withColumn("violation", bad.cast("int"))


def score_with_fallback(df: DataFrame, full: Weights, fallback: Weights, t_full: float, t_fallback: float) -> DataFrame:
    """Blend of all models, or of the fallback set with its own threshold where a score is missing."""
    complete = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in full])
    usable = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in fallback])
    p = F.when(complete, blend(full)).when(usable, blend(fallback))
    threshold = F.when(complete, t_full).otherwise(t_fallback)
    return df.withColumns({
        "mode": F.when(complete, "full").when(usable, "fallback").otherwise("failed"), "p": p,
        "decision": F.when(p.isNull(), F.lit(None).cast("string")).when(p >= threshold, "FRAUD").otherwise("LEGITIMATE")})


def compare_ensembles(val: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], step: float = 0.05, y: str = "y",
                      chunks: Chunks = None) -> DataFrame:
    """For each model set: weights found on validation, AP there and on test."""
    out = None
    for name, models in sets.items():
        best = search_coarse(val, models, step, y, chunks)
        won = best.first()
        weights = {m: won[f"w_{m}"] for m in models}
        test_ap = average_precision(test.withColumn("p", blend(weights)), y, "p", chunks=chunks).select("ap").scalar()
        label = ";".join(f"{m}={w:.4f}" for m, w in weights.items())
        one = best.select(F.lit(name).alias("model_set"), F.lit(label).alias("weights"), F.col("ap").alias("val_ap"),
                          test_ap.alias("test_ap"))
        out = one if out is None else out.unionByName(one)
    return out
