"""Nearest neighbours by cosine from a forest of random-projection trees, searched through one priority queue for all trees.

A tree splits the unit vectors along orthonormal random directions at medians. The squared margins that separate a query from a
leaf add up to a lower bound of its squared distance to any vector there; the queue hands out the leaves of all trees in the
order of that bound, until the visited leaves hold a calibrated share of the rows. The share is the least at which
probes out of the sample found ``TARGET`` of their true neighbours within the sample; neighbours in the whole table are nearer and
so are met earlier. Where no share below one full tree does, one tree is read completely, which is exact.
The forest is fitted on at most about ``SAMPLE`` vectors; every row is indexed.

Equal vectors are one entry with their least k + 1 ids: more can't be among the nearest. Rows with a null id, a null or empty
vector, null or non-finite components or zero length take no part; repeated rows count once, and a row never finds its own id.
Two vectors under one id are two queries under that id. Shorter vectors count as filled up with zeros. Ties go to the smaller id.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlens.llm.common import kept_table

TREES = 4
#: Distinct vectors that the forest is fitted on, about.
SAMPLE = 16_384
#: Sampled vectors in a leaf, at least.
LEAF_SAMPLE = 16
PROBES = 256
TARGET = 0.96
#: Rows of the index and queries that one task compares.
REGION_ROWS = 16_384
QUERY_ROWS = 16_384
#: Scores in one block, and pairs kept before they are reduced to the nearest.
_BLOCK = 1 << 21
_PAIRS = 1 << 19
_SLACK = 1e-9
SEED = 42


def matrix(vectors, dim: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros, scaled by a power of two so that squares stay finite; the angles don't change."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0.0))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


class Forest:
    """Directions and cuts of all trees; node n of a level has the children 2n and 2n + 1 in the next one."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF_SAMPLE, seed: int = SEED):
        n, dim = sample.shape
        self.depth = min(dim, max(0, int(math.log2(max(n, 1) / leaf)))) if n > leaf else 0
        self.trees = trees if self.depth else 1
        rng = np.random.default_rng(seed)
        self.directions = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :self.depth] for _ in range(self.trees)]
        self.cuts = []
        for d in self.directions:
            along, node, cuts = sample @ d, np.zeros(n, np.int64), []
            for level in range(self.depth):
                order = np.lexsort((along[:, level], node))
                ends = np.searchsorted(node[order], np.arange(2 ** level + 1))
                middle = np.minimum((ends[:-1] + ends[1:]) // 2, n - 1)
                cuts.append(np.where(ends[1:] > ends[:-1], along[order[middle], level], 0.0))
                node = 2 * node + (along[:, level] >= cuts[-1][node])
            self.cuts.append(cuts)

    @property
    def leaves(self) -> int:
        return 2 ** self.depth

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((self.trees, len(rows)), np.int64)
        for t, (d, cuts) in enumerate(zip(self.directions, self.cuts)):
            along = rows @ d
            for level in range(self.depth):
                out[t] = 2 * out[t] + (along[:, level] >= cuts[level][out[t]])
        return out

    def nearest_leaves(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(tree, leaf)`` of all trees, nearest first by the bound of the squared distance."""
        along = [(query @ d).tolist() for d in self.directions]
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        while queue:
            bound, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = along[t][level] - self.cuts[t][level][node]
                near = 2 * node + (margin >= 0)
                level += 1
                heapq.heappush(queue, (bound + margin * margin, t, level, near ^ 1))
                node = near
            yield t, node

    def visited(self, query: np.ndarray, weights: np.ndarray, share: float) -> list[tuple[int, int]]:
        """The leaves to read: up to ``share`` of the rows, ``weights`` being the rows of each leaf of each tree."""
        if share >= 1:
            return [(0, leaf) for leaf in range(self.leaves)]
        out, left = [], share * weights[0].sum()
        for t, leaf in self.nearest_leaves(query):
            out.append((t, leaf))
            left -= weights[t, leaf]
            if left <= 0:
                break
        return out


def calibrated_share(forest: Forest, sample: np.ndarray, k: int, probes: int = PROBES, target: float = TARGET) -> float:
    """Share of the rows to visit so that probes find ``target`` of their ``k`` nearest others in the sample; 1 is everything."""
    n = len(sample)
    if forest.depth == 0 or n <= k:
        return 1.0
    places = forest.place(sample)
    weights = np.stack([np.bincount(p, minlength=forest.leaves) for p in places])
    needed = []
    for at in range(min(probes, n)):
        scores = sample @ sample[at]
        scores[at] = -np.inf
        truth = np.argpartition(-scores, k - 1)[:k]
        wanted: dict[tuple[int, int], list[int]] = defaultdict(list)
        for t in range(forest.trees):
            for x in truth:
                wanted[t, places[t, x]].append(x)
        seen, open_, found = 0, set(truth.tolist()), []
        for t, leaf in forest.nearest_leaves(sample[at]):
            seen += weights[t, leaf]
            for x in wanted.get((t, leaf), ()):
                if x in open_:
                    open_.discard(x)
                    found.append(seen / n)
            if not open_:
                break
        needed += found
    share = float(np.quantile(needed, target, method="higher"))
    return min(1.0, share)


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)`` of the rows that take part, each once."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id).cast("long").alias("id"), v.alias("v")).distinct()


class Regions:
    """Leaves grouped to about ``size`` rows; a larger leaf is dealt to several regions by a hash of the row."""

    def __init__(self, weights: np.ndarray, size: int):
        self.first, self.parts = np.zeros(weights.shape, np.int64), np.maximum(1, -(-weights // size))
        at = 0
        for t in range(len(weights)):
            held = size
            for leaf, n in enumerate(weights[t].tolist()):
                if held + n > size:
                    at, held = at + 1, 0
                self.first[t, leaf] = at
                at += int(self.parts[t, leaf]) - 1
                held = size if self.parts[t, leaf] > 1 else held + n

    def of(self, t: int, leaf: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        return self.first[t, leaf] + hashed % self.parts[t, leaf]


def _nearest_pairs(q, e, s, first, top: int) -> np.ndarray:
    """Places of the ``top`` best pairs of each query."""
    order = np.lexsort((first[e], -s, q))
    starts = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < top]


def rerank(queries: np.ndarray, leaves: list, rows: np.ndarray, leaf_of: np.ndarray, first: np.ndarray, top: int):
    """``(query, row, score)`` places of the ``top`` nearest rows of each query among the leaves it visits.

    Blocks of products preselect; the score of every pair that may stay is computed by itself, so equal vectors tie exactly.
    """
    uq, ur = unit(queries), unit(rows)
    nq, nr = (np.sqrt((x * x).sum(axis=1)) for x in (queries, rows))
    by_leaf = defaultdict(list)
    for i, own in enumerate(leaves):
        for leaf in own:
            by_leaf[leaf].append(i)
    order = np.argsort(leaf_of, kind="stable")
    bounds = {leaf: (a, b) for leaf, a, b in zip(*_runs(leaf_of[order]))}
    worst = np.full(len(queries), -np.inf)
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    fresh: list[tuple] = []
    size = 0

    def reduced():
        nonlocal kept, fresh, size
        q, e = (np.concatenate([kept[i], *(x[i] for x in fresh)]) for i in (0, 1))
        s = np.concatenate([kept[2], *(_cosines(queries, rows, nq, nr, x[0], x[1]) for x in fresh)])
        best = _nearest_pairs(q, e, s, first, top)
        kept, fresh, size = (q[best], e[best], s[best]), [], 0
        counts = np.bincount(kept[0], minlength=len(queries))
        ends = np.cumsum(counts)
        full = counts == top
        worst[full] = kept[2][ends[full] - 1]

    for leaf, asking in by_leaf.items():
        if leaf not in bounds:
            continue
        own = order[slice(*bounds[leaf])]
        asking = np.array(asking)
        step = max(1, _BLOCK // len(own))
        for a in range(0, len(asking), step):
            some = asking[a:a + step]
            scores = uq[some] @ ur[own].T
            least = worst[some]
            if len(own) > top:
                least = np.maximum(least, -np.partition(-scores, top - 1, axis=1)[:, top - 1])
            i, j = np.nonzero(scores >= least[:, None] - _SLACK)
            fresh.append((some[i], own[j]))
            size += len(i)
            if size > _PAIRS:
                reduced()
    reduced()
    return kept


def _cosines(queries, rows, nq, nr, q, e) -> np.ndarray:
    out = np.empty(len(q))
    for a in range(0, len(q), 1 << 15):
        i, j = q[a:a + (1 << 15)], e[a:a + (1 << 15)]
        out[a:a + len(i)] = (queries[i] * rows[j]).sum(axis=1) / (nq[i] * nr[j])
    return out


def _runs(values: np.ndarray):
    starts = np.flatnonzero(np.r_[True, np.diff(values) != 0]) if len(values) else np.zeros(0, np.int64)
    return values[starts].tolist(), starts.tolist(), np.r_[starts[1:], len(values)].astype(int).tolist()


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, is_query, k: int = 5, trees: int = TREES, target: float = TARGET, sample: int = SAMPLE,
            region_rows: int = REGION_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row of ``vectors(vec_id, embedding)`` with ``is_query(id)``."""
    spark = vectors.sparkSession
    top = k + 1
    rows, _ = kept_table(usable(vectors), "forest-rows")
    least = Window.partitionBy("v").orderBy("id")
    entries, _ = kept_table(
        rows.withColumn("_place", F.row_number().over(least)).where(F.col("_place") <= top)
        .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "forest-entries")
    n, dim = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    asked, _ = kept_table(
        rows.where(is_query(F.col("id"))).groupBy("v").agg(F.min("id").alias("_id"))
        .select("v", F.concat_ws(":", "_id", F.xxhash64("v")).alias("q")), "forest-queries")
    n_asked = asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], RESULT)
    parts = 1 << 20
    seen = entries.where(F.pmod(F.xxhash64("v"), F.lit(parts)) < math.ceil(min(1.0, sample / n) * parts)).select("v", F.xxhash64("v").alias("h"))
    fitted = unit(matrix(seen.toPandas().sort_values("h")["v"], dim)) if n else np.zeros((0, dim))
    forest = Forest(fitted, trees)
    share = calibrated_share(forest, fitted, k, target=target)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((forest.trees, forest.leaves), np.int64)
        for batch in batches:
            for t, leaf in enumerate(forest.place(unit(matrix(batch["v"], dim)))):
                total[t] += np.bincount(leaf, minlength=forest.leaves)
        t, leaf = np.nonzero(total)
        yield pd.DataFrame({"t": t, "leaf": leaf, "n": total[t, leaf]})

    # One row a leaf of the fitted forest: bounded by the sample.
    weights = np.zeros((forest.trees, forest.leaves), np.int64)
    for t, leaf, rows_there in entries.select("v").mapInPandas(counted, "t long, leaf long, n long").groupBy("t", "leaf").agg(F.sum("n")).toLocalIterator():
        weights[t, leaf] = rows_there
    regions = Regions(weights, region_rows)
    groups = -(-n_asked // query_rows)
    used = range(1 if share >= 1 else forest.trees)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = forest.place(unit(matrix(batch["v"], dim)))
            for t in used:
                region = regions.of(t, places[t], batch["h"].to_numpy())
                yield pd.DataFrame({"region": region, "leaf": t * forest.leaves + places[t], "v": batch["v"], "ids": batch["ids"]})

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, h, v, u in zip(batch["q"], batch["h"], batch["v"], unit(matrix(batch["v"], dim))):
                to = defaultdict(list)
                for t, leaf in forest.visited(u, weights, share):
                    for part in range(int(regions.parts[t, leaf])):
                        to[int(regions.first[t, leaf]) + part].append(t * forest.leaves + leaf)
                out += [(region, h % groups, q, v, own) for region, own in to.items()]
            yield pd.DataFrame(out, columns=["region", "g", "q", "v", "leaves"])

    hashed = F.pmod(F.xxhash64("v"), F.lit(1 << 31)).alias("h")
    kind = rows.schema["v"].dataType.simpleString()
    index = entries.select("v", "ids", hashed).mapInPandas(indexed, f"region long, leaf long, v {kind}, ids array<long>")
    index = index.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    visits = asked.select("q", "v", hashed).mapInPandas(searched, f"region long, g long, q string, v {kind}, leaves array<long>")

    def compare(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or own.empty:
            return pd.DataFrame([], columns=["q", "ids", "score"], dtype=object)
        first = own["ids"].map(lambda x: x[0]).to_numpy(np.int64)
        q, e, s = rerank(matrix(queries["v"], dim), list(queries["leaves"]), matrix(own["v"], dim), own["leaf"].to_numpy(), first, top)
        return pd.DataFrame({"q": queries["q"].to_numpy()[q], "ids": own["ids"].to_numpy()[e], "score": s})

    found = visits.groupBy("region", "g").cogroup(index.groupBy("region", "g")).applyInPandas(compare, "q string, ids array<long>, score double")
    # The same entry may come out of several trees.
    each = found.select("q", "score", F.explode("ids").alias("vec_id")).distinct()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= top)
    of_query = rows.where(is_query(F.col("id"))).join(asked, "v").select("q", F.col("id").alias("query_id"))
    others = of_query.join(ranked, "q").where("vec_id <> query_id")
    last = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``embeddings``: queries are the ids divisible by 50, five neighbours each."""
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), lambda id: id % 50 == 0)
