"""Exact nearest neighbours without comparing every pair.

Equal vectors are one point that keeps its least ``k + 1`` ids. Points are dealt to a tree of blocks: a block above its size is
split by the nearest of sixteen of its own points, round after round, until all are small. A first pass inside each block bounds
every point's k-th distance. By the triangle inequality a point within reach r of a block lies at most r plus the block's radius
from its centre, so pairs of tree nodes that are further apart are dropped from the root down, and only points that reach into a
block visit it. No step compares all points with all blocks; blocks, groups of visitors and the rows of a node are bounded.

Rows without a vector take no part; ids are unique. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.session import cut_lineage

ROWS_PER_BLOCK = 1_000
ROWS_PER_GROUP = 10_000
FANOUT = 16
#: Rows of a block from which its pivots are taken, about.
SAMPLED = 64
#: A split that leaves this share in one part is followed by one by id.
STUCK = 0.9
_SLACK = 1e-6
_PAIRS = "_id long, neighbour long, distance double"
_LOCAL = ("_node string, _id long, _x array<double>, near array<struct<distance: double, neighbour: long>>, reach double, "
          "centre array<double>, radius double, far double")
_NODE = "node string, centre array<double>, radius double, far double, size long"


def _closest(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    """The k closest of ``y`` for each row of ``x``, ties by id; a row is not its own neighbour."""
    order = np.argsort(other_ids, kind="stable")
    other_ids, y = other_ids[order], y[order]
    parts = []
    for at in range(0, len(x), 256):
        rows = x[at:at + 256]
        d = np.sqrt(((rows[:, None, :] - y[None, :, :]) ** 2).sum(-1)) if len(y) * rows.size < 2e7 else np.stack(
            [np.sqrt(((y - r) ** 2).sum(-1)) for r in rows])
        d[ids[at:at + 256, None] == other_ids[None, :]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        picked = np.take_along_axis(d, best, axis=1)
        frame = pd.DataFrame({
            "_id": np.repeat(ids[at:at + 256], best.shape[1]),
            "neighbour": other_ids[best].ravel(), "distance": picked.ravel()})
        parts.append(frame[np.isfinite(frame["distance"])])
    return pd.concat(parts) if parts else pd.DataFrame({"_id": [], "neighbour": [], "distance": []})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _apart(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def _salted(rows: DataFrame, sizes: DataFrame, block: str) -> DataFrame:
    """``rows`` with ``_salt``, so that a group of ``(block, _salt)`` holds about ROWS_PER_GROUP of them."""
    salts = sizes.select(block, F.ceil(F.col("_size") / ROWS_PER_GROUP).alias("_salts"))
    return rows.join(salts, block).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts"))).drop("_salts")


def _repeated(rows: DataFrame, sizes: DataFrame, block: str) -> DataFrame:
    """``rows`` once for every salt that the rows of their block have."""
    salts = sizes.select(block, F.ceil(F.col("_size") / ROWS_PER_GROUP).alias("_salts"))
    return rows.join(salts, block).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")


def blocks(points: DataFrame, rows_per_block: int) -> DataFrame:
    """``points(_id, _x)`` with the path ``_node`` of their block; a path has a digit a level."""
    def deal(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows[["_id", "_x", "_node", "_from"]]
        if pivots.empty:
            child = rows["_cut"].to_numpy()
        else:
            x, y = _matrix(rows["_x"]), _matrix(pivots["_p"])
            child = np.argmin((y ** 2).sum(1) - 2 * x @ y.T, axis=1)
        return rows[["_id", "_x"]].assign(
            _node=[n + format(int(c), "x") for n, c in zip(rows["_node"], child)], _from=rows["_size"])

    open_ = points.select("_id", "_x", F.lit("0").alias("_node"), F.lit(None).cast("long").alias("_from"))
    done = None
    while True:
        sizes = cut_lineage(open_.groupBy("_node").agg(F.count(F.lit(1)).alias("_size"), F.max("_from").alias("_from")))
        full = sizes.where(F.col("_size") > rows_per_block)
        small = open_.drop("_from").join(sizes.where(F.col("_size") <= rows_per_block).select("_node"), "_node", "left_semi")
        done = small if done is None else done.unionByName(small)
        if full.isEmpty():
            return done
        rows = open_.drop("_from").join(full, "_node")
        draw = F.xxhash64("_id", F.length("_node"))
        share = (F.shiftrightunsigned(draw, 11) / float(1 << 53)) < SAMPLED / F.col("_size")
        first = Window.partitionBy("_node").orderBy(draw, "_id")
        spread = F.col("_from").isNull() | (F.col("_size") <= STUCK * F.col("_from"))
        pivots = rows.where(share & spread).withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= FANOUT).select(
            "_node", F.col("_x").alias("_p"))
        left = _salted(rows.withColumn("_cut", F.pmod(draw, F.lit(FANOUT))).drop("_from"), full, "_node")
        right = _repeated(pivots, full, "_node").select(F.col("_node").alias("_pnode"), F.col("_salt").alias("_psalt"), "_p")
        open_ = cut_lineage(left.groupBy("_node", "_salt").cogroup(right.groupBy("_pnode", "_psalt")).applyInPandas(
            deal, "_id long, _x array<double>, _node string, _from long"))


def _within(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["_x"]), pdf["_id"].to_numpy()
        found = {i: g for i, g in _closest(ids, x, ids, x, k).groupby("_id")}
        near = [[{"distance": d, "neighbour": n} for d, n in zip(found[i]["distance"], found[i]["neighbour"])] if i in found else []
                for i in ids]
        reach = np.array([n[-1]["distance"] if len(n) >= k else np.inf for n in near])
        centre = x.mean(axis=0)
        out = pd.DataFrame({"_node": pdf["_node"], "_id": ids, "_x": list(x), "near": near, "reach": reach})
        head = np.arange(len(ids)) == 0
        out["centre"] = [centre if h else None for h in head]
        out["radius"] = np.where(head, np.sqrt(((x - centre) ** 2).sum(1)).max(), np.nan)
        out["far"] = np.where(head, reach.max(), np.nan)
        return out

    return run


def _parent(pdf: pd.DataFrame) -> pd.DataFrame:
    """One node around its children, at most FANOUT rows."""
    c, size = _matrix(pdf["centre"]), pdf["size"].to_numpy()
    centre = (c * size[:, None]).sum(0) / size.sum()
    radius = (np.sqrt(((c - centre) ** 2).sum(1)) + pdf["radius"].to_numpy()).max()
    return pd.DataFrame({"node": [pdf["node"].iloc[0][:-1]], "centre": [centre], "radius": [radius], "far": [pdf["far"].max()],
                         "size": [size.sum()]})


def visits(local: DataFrame) -> DataFrame:
    """``(_block, _id, _x)``: the points of ``local`` and the other blocks that they reach into."""
    sizes = local.groupBy("_node").agg(F.count(F.lit(1)).alias("size"))
    leaves = cut_lineage(local.where("centre IS NOT NULL").join(sizes, "_node").select(
        F.col("_node").alias("node"), "centre", "radius", "far", "size"))
    depth = leaves.agg(F.max(F.length("node"))).first()[0] or 1
    levels = {depth: leaves.where(F.length("node") == depth)}
    for d in range(depth - 1, 0, -1):
        above = levels[d + 1].groupBy(F.substring("node", 1, d)).applyInPandas(_parent, _NODE)
        levels[d] = cut_lineage(leaves.where(F.length("node") == d).unionByName(above))
    pairs = levels[1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for d in range(2, depth + 1):
        kids = levels[d].withColumn("up", F.substring("node", 1, d - 1)).unionByName(
            leaves.where(F.length("node") < d).withColumn("up", F.col("node")))
        sides = [kids.select(F.col("up").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("node", "centre", "radius", "far")])
                 for s in ("a", "b")]
        reached = _apart("centre_a", "centre_b") <= F.col("far_a") + F.col("radius_a") + F.col("radius_b") + _SLACK
        pairs = cut_lineage(pairs.join(sides[0], "a").join(sides[1], "b").where(reached).select(
            F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    aims = pairs.where("a <> b").join(leaves.select(F.col("node").alias("b"), "centre", "radius"), "b")
    return local.select(F.col("_node").alias("a"), "_id", "_x", "reach").join(aims, "a").where(
        _apart("_x", "centre") <= F.col("reach") + F.col("radius") + _SLACK).select(F.col("b").alias("_block"), "_id", "_x")


def _search(points: DataFrame, k: int, rows_per_block: int) -> DataFrame:
    """``(_id, neighbour, distance)`` of distinct ``points(_id, _x)``; the k nearest of each are among them."""
    local = cut_lineage(blocks(points, rows_per_block).groupBy("_node").applyInPandas(_within(k), _LOCAL))
    found = local.select("_id", F.explode("near").alias("n")).select("_id", "n.neighbour", "n.distance")
    if local.where("centre IS NOT NULL").limit(2).count() < 2:
        return found
    reaching = cut_lineage(visits(local))
    busy = cut_lineage(reaching.groupBy("_block").agg(F.count(F.lit(1)).alias("_size")))
    if busy.isEmpty():
        return found
    left = _salted(reaching, busy, "_block")
    members = _repeated(local.select(F.col("_node").alias("_block"), F.col("_id").alias("_mid"), F.col("_x").alias("_mx")), busy, "_block")
    members = members.select(F.col("_block").alias("_mblock"), F.col("_salt").alias("_msalt"), "_mid", "_mx")

    def across(visitors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty or rows.empty:
            return pd.DataFrame({"_id": [], "neighbour": [], "distance": []})
        return _closest(visitors["_id"].to_numpy(), _matrix(visitors["_x"]), rows["_mid"].to_numpy(), _matrix(rows["_mx"]), k)

    return found.unionByName(left.groupBy("_block", "_salt").cogroup(members.groupBy("_mblock", "_msalt")).applyInPandas(across, _PAIRS))


def nearest_neighbours(df: DataFrame, key: str, vector: str, k: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``(key, neighbour, distance, rank)`` for the k nearest other rows of every row, ties by id."""
    points = df.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_x")).where("_x IS NOT NULL")
    least = Window.partitionBy("_x").orderBy("_id")
    kept = points.withColumn("_at", F.row_number().over(least)).where(F.col("_at") <= k + 1)
    distinct = cut_lineage(kept.groupBy("_x").agg(F.sort_array(F.collect_list("_id")).alias("_ids")).select(
        F.element_at("_ids", 1).alias("_id"), "_x", "_ids"))
    found = _search(distinct.select("_id", "_x"), k, rows_per_block)
    nearest = Window.partitionBy("_id").orderBy("distance", "neighbour")
    found = found.withColumn("_at", F.row_number().over(nearest)).where(F.col("_at") <= k)
    copies = distinct.select(F.col("_id").alias("neighbour"), "_ids")
    entries = found.join(copies, "neighbour").select("_id", "distance", F.explode("_ids").alias("neighbour")).unionByName(
        distinct.select("_id", F.lit(0.0).alias("distance"), F.explode("_ids").alias("neighbour")))
    # At most (k + 1) ** 2 entries a point.
    lists = entries.groupBy("_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k + 1).alias("_near"))
    named = points.join(distinct.select("_x", F.col("_id").alias("_least")), "_x").select("_id", "_least")
    others = F.filter("_near", lambda n: n["neighbour"] != F.col("_id"))
    ranked = named.join(lists.withColumnRenamed("_id", "_least"), "_least").select("_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "_n"))
    return ranked.select(F.col("_id").alias(key), "_n.neighbour", "_n.distance", (F.col("_at") + 1).alias("rank"))
