"""Gradient-boosted trees grown from histograms that Spark adds up.

Features are cut into bins once. For each level of a tree every task sums the gradients of its rows by node, feature and bin, one
aggregation adds the sums of all tasks, and only these sums, whose number depends on nodes, features and bins, come to the driver.
Of two siblings the smaller one is summed, the other is its parent less that one. Gradients are whole numbers of 2^-16, so sums don't
depend on the order of rows. Training stops when the average precision on held-out rows hasn't risen for some rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.session import cut_lineage

BINS = 64
UNIT = float(1 << 16)
#: Cells of a score histogram, for the average precision of a round.
CELLS = 1 << 14
#: Trees between two writings of the margins.
EVERY = 10


@dataclass
class Tree:
    """A complete binary tree by level; a node sends rows right whose bin is above ``cut``, one that isn't split sends all left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    #: What the splits of each feature gained.
    gains: np.ndarray

    def leaf(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node of each row ``depth`` levels down, counted within its level."""
        depth = int(math.log2(len(self.value))) if depth is None else depth
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(depth):
            node = 2 ** level - 1 + at
            at = 2 * at + (bins[rows, self.feature[node]] > self.cut[node])
        return at

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(bins)]


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: Average precision on the held-out rows after each round.
    history: list[float] = field(default_factory=list)

    def binned(self, columns: Sequence[pd.Series]) -> np.ndarray:
        """Bin numbers; a missing value is bin 0."""
        out = np.zeros((len(columns[0]), len(columns)), np.int16)
        for i, (c, edges) in enumerate(zip(columns, self.edges)):
            x = c.to_numpy(float)
            out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(edges, x, side="right") + 1)
        return out

    def probability(self) -> Column:
        """The probability of the label as a column over the features."""
        model = self

        @F.pandas_udf("double")
        def score(block: pd.DataFrame) -> pd.Series:
            bins = model.binned([block[c] for c in block.columns])
            margin = np.full(len(bins), model.base)
            for tree in model.trees:
                margin += tree.margin(bins)
            return pd.Series(1 / (1 + np.exp(-margin)))

        return score(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]))

    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        gains = sum((t.gains for t in self.trees), np.zeros(len(self.features)))
        total = float(gains.sum())
        return {f: float(g) / total if total else 0.0 for f, g in zip(self.features, gains)}


def _gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return np.rint(w * (p - y) * UNIT).astype(np.int64), np.rint(w * p * (1 - p) * UNIT).astype(np.int64)


def _columns(batch: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    return (np.stack([batch[f"b{i}"].to_numpy() for i in range(width)], axis=1), *(batch[c].to_numpy() for c in ("y", "w", "margin")))


def level_sums(rows: DataFrame, width: int, ahead: Sequence[Tree], tree: Tree, depth: int, slots: np.ndarray) -> np.ndarray:
    """``(slot, feature, bin, (g, h, n))`` over the training rows; ``slots`` gives the slot of each node of the level, -1 for none.

    ``ahead`` are whole trees that ``margin`` doesn't hold yet.
    """
    shape = (int(slots.max()) + 1, width, BINS + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, int(np.prod(shape))), np.int64)
        for batch in batches:
            bins, y, w, margin = _columns(batch, width)
            slot = slots[tree.leaf(bins, depth)]
            used = slot >= 0
            bins, slot = bins[used], slot[used]
            margin = margin[used] + sum((t.margin(bins) for t in ahead), np.zeros(len(bins)))
            g, h = _gradients(margin, y[used], w[used])
            for f in range(width):
                cell = (slot * width + f) * (BINS + 1) + bins[:, f]
                # Sums of whole numbers below 2^53 a batch are exact in doubles.
                sums[0] += np.bincount(cell, g, sums.shape[1]).astype(np.int64)
                sums[1] += np.bincount(cell, h, sums.shape[1]).astype(np.int64)
                sums[2] += np.bincount(cell, minlength=sums.shape[1])
        at = np.flatnonzero(sums[2])
        yield pd.DataFrame({"cell": at, "g": sums[0, at], "h": sums[1, at], "n": sums[2, at]})

    found = rows.where("NOT held").mapInPandas(run, "cell long, g long, h long, n long").groupBy("cell").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
    out = np.zeros((int(np.prod(shape)), 3), np.int64)
    out[found["cell"]] = found[["g", "h", "n"]]
    return out.reshape(*shape, 3)


def best_splits(sums: np.ndarray, reg: float, least: float) -> tuple[np.ndarray, ...]:
    """Per node: gain, feature and cut of the best split, the first on ties; a gain of 0 is none."""
    left = sums.cumsum(axis=2)[:, :, :-1]
    total = sums.sum(axis=2)[:, :, None]
    right = total - left
    score = lambda s: (s[..., 0] / UNIT) ** 2 / (s[..., 1] / UNIT + reg)
    gain = score(left) + score(right) - score(total)
    allowed = (left[..., 1] >= least * UNIT) & (right[..., 1] >= least * UNIT) & (left[..., 2] > 0) & (right[..., 2] > 0)
    flat = np.where(allowed & (gain > 1e-9), gain, 0.0).reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), at], at // (sums.shape[2] - 1), at % (sums.shape[2] - 1)


def grow_tree(rows: DataFrame, width: int, ahead: Sequence[Tree], depth: int, rate: float, reg: float, least: float) -> Tree:
    tree = Tree(np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, BINS + 1), np.zeros(2 ** depth), np.zeros(width))
    sums = level_sums(rows, width, ahead, tree, 0, np.zeros(1, np.int64))
    nodes = np.zeros(1, np.int64)
    for level in range(depth):
        gain, feature, cut = best_splits(sums, reg, least)
        split = gain > 0
        at = 2 ** level - 1 + nodes
        tree.feature[at[split]], tree.cut[at[split]] = feature[split], cut[split]
        np.add.at(tree.gains, feature[split], gain[split])
        # What isn't split is a leaf: all its rows go left from here on.
        whole = sums[~split][:, 0].sum(axis=1)
        tree.value[nodes[~split] << (depth - level)] = -rate * whole[:, 0] / (whole[:, 1] + reg * UNIT)
        nodes, parents = nodes[split], sums[split]
        if not len(nodes):
            break
        left = np.stack([parents[i, f, :c + 1].sum(axis=0) for i, (f, c) in enumerate(zip(feature[split], cut[split]))])
        whole = parents[:, 0].sum(axis=1)
        if level == depth - 1:
            both = np.stack([left, whole - left], axis=1).reshape(-1, 3)
            kids = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
            tree.value[kids] = -rate * both[:, 0] / (both[:, 1] + reg * UNIT)
            break
        right_smaller = 2 * left[:, 2] > whole[:, 2]
        slots = np.full(2 ** (level + 1), -1)
        slots[2 * nodes + right_smaller] = np.arange(len(nodes))
        small = level_sums(rows, width, ahead, tree, level + 1, slots)
        sums = np.stack([small, parents - small], axis=1)
        sums[right_smaller] = sums[right_smaller][:, ::-1]
        sums = sums.reshape(-1, *small.shape[1:])
        nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
    return tree


def held_out_precision(rows: DataFrame, width: int, fresh: Sequence[Tree]) -> list[float]:
    """Average precision on the held-out rows after each of the ``fresh`` trees, on ``CELLS`` equal steps of the probability."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, len(fresh) * CELLS), np.int64)
        for batch in batches:
            bins, y, _, margin = _columns(batch, width)
            for i, tree in enumerate(fresh):
                margin = margin + tree.margin(bins)
                cell = i * CELLS + np.minimum((CELLS / (1 + np.exp(-margin))).astype(np.int64), CELLS - 1)
                sums[0] += np.bincount(cell[y == 1], minlength=sums.shape[1])
                sums[1] += np.bincount(cell, minlength=sums.shape[1])
        at = np.flatnonzero(sums[1])
        yield pd.DataFrame({"cell": at, "pos": sums[0, at], "n": sums[1, at]})

    found = rows.where("held").mapInPandas(run, "cell long, pos long, n long").groupBy("cell").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n")).toPandas()
    cells = np.zeros((2, len(fresh) * CELLS))
    cells[0, found["cell"]], cells[1, found["cell"]] = found["pos"], found["n"]
    pos, n = cells.reshape(2, len(fresh), CELLS)[:, :, ::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(pos > 0, pos * pos.cumsum(axis=1) / n.cumsum(axis=1), 0.0).sum(axis=1) / pos.sum(axis=1)
    return [float(x) for x in np.nan_to_num(part)]


def train(df: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None, validation: str | None = None,
          trees: int = 100, depth: int = 6, rate: float = 0.1, reg: float = 1.0, least: float = 1.0, patience: int = 10) -> Boosted:
    """Fit up to ``trees`` trees; with ``validation``, a boolean column, only the rounds up to the best one on its rows are kept.

    Rows without a label take no part. Missing features have a bin of their own.
    """
    narrow = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        (F.col(validation) if validation else F.lit(False)).cast("boolean").alias("held"),
        *[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f"x{i}") for i, f in enumerate(features)])
    own = narrow.where("NOT held")
    cuts = own.approxQuantile([f"x{i}" for i in range(len(features))], [i / BINS for i in range(1, BINS)], 1 / (8 * BINS))
    total, hits = own.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    share = min(max((hits or 0.0) / total, 1e-6), 1 - 1e-6) if total else 0.5
    model = Boosted(list(features), [np.unique(c) for c in cuts], math.log(share / (1 - share)))
    if not total:
        return model

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = model.binned([batch[f"x{i}"] for i in range(len(features))])
            yield batch[["y", "w", "held"]].assign(margin=model.base, **{f"b{i}": bins[:, i] for i in range(len(features))})

    schema = "y double, w double, held boolean, margin double, " + ", ".join(f"b{i} short" for i in range(len(features)))
    rows = cut_lineage(narrow.mapInPandas(placed, schema))
    width, best = len(features), 0
    while len(model.trees) < trees:
        fresh: list[Tree] = []
        for _ in range(min(EVERY, trees - len(model.trees))):
            fresh.append(grow_tree(rows, width, fresh, depth, rate, reg, least))
        if validation:
            model.history += held_out_precision(rows, width, fresh)
        model.trees += fresh
        if validation:
            best = int(np.argmax(model.history))
            if len(model.history) - 1 - best >= patience:
                break
        if len(model.trees) < trees:
            rows = cut_lineage(rows.mapInPandas(_moved(width, fresh), schema))
    if validation:
        model.trees = model.trees[:best + 1]
    return model


def _moved(width: int, fresh: list[Tree]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins, _, _, margin = _columns(batch, width)
            yield batch.assign(margin=margin + sum((t.margin(bins) for t in fresh), np.zeros(len(bins))))
    return run
