"""Product-quantisation codes from Lloyd's rounds over partition-local cover trees.

Every block of rows gets a cover tree for each part of the vectors: centres at halving radii cover the points below them, and points
lie in the order of the tree, so cumulative sums give the sum of any subtree. In a round a whole subtree goes to the nearest
entry of the codebook if, by the triangle inequality, no other entry can be as near to any of its points; only ambiguous nodes
hand their children on, and points of ambiguous leaves are compared one by one. The trees are built once and written to a table
that every round reads; a round returns sums and counts of an entry a block, added up by Spark. All of it is in whole numbers,
so the order of rows and blocks doesn't matter.

Rows whose vector is null or empty or holds null or non-finite components are dropped; repeated rows stay. Shorter vectors count as
filled up with zeros to the longest one, and that length to a multiple of the parts. Components are limited to 2^26 after scaling, so
that squares fit in a long. Rows with a null id keep their code, and start a codebook only if there are too few others; among
equal ids the lesser vector comes first. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.common import drop_table, kept_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of one block of trees, at most.
BLOCK = 16_384
#: Points of a node that isn't split further.
LEAF = 8
LIMIT = 1 << 26
#: Labels that are sent to every task, at most.
SMALL_LABELS = 100_000


class CoverTree:
    """A tree over whole points as arrays: nodes of a level lie together, the points of a node are one run of ``order``.

    ``centre`` and ``reach`` (the largest distance of a point of the node from it, rounded up) bound a node, ``first`` and ``kids`` name its
    children, and ``sums`` are cumulative sums of the points in order.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        self.order = np.arange(n)
        centre, start, end = points[:1], np.zeros(1, np.int64), np.array([n])
        reach = np.sqrt(_squares(points - points[0]).max(keepdims=True))
        levels, radius = [], float(reach[0])
        while len(centre):
            wide = (end - start > leaf) & (reach > 0)
            kids, parts = np.zeros(len(centre), np.int64), []
            radius /= 2
            if wide.any():
                at = np.flatnonzero(wide)
                # A node can be narrow already where its parent's radius was far from used up.
                parts = self._split(points, at, start, end, centre, np.minimum(radius, reach[at] / 2))
                kids = np.bincount(parts[0], minlength=len(centre))
            levels.append((centre, reach, start, end, kids))
            if not wide.any():
                break
            _, centre, start, end, reach = parts
        self.centre, self.reach, self.start, self.end, self.kids = (np.concatenate(x) for x in zip(*levels))
        self.reach = self.reach * (1 + 1e-9)
        self.first = 1 + np.r_[0, np.cumsum(self.kids)[:-1]]
        self.points = points[self.order]
        self.sums = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])

    def _split(self, points, at, start, end, centre, radius):
        """Children of the nodes ``at``: every round takes one uncovered point a node as a centre and covers what is within the radius.

        The node's own centre comes first, so that centres are nested; later ones are further than the radius from all before.
        """
        size = end[at] - start[at]
        node = np.repeat(np.arange(len(at)), size)
        spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[at], size)
        row = self.order[spot]
        child, far = np.full(len(row), -1), np.zeros(len(row))
        open_ = np.arange(len(row))
        heads, made, now = [], 0, centre[at]
        owner = np.arange(len(at))
        place = np.arange(len(at))
        while len(open_):
            place[owner] = np.arange(len(owner))
            mine = place[node[open_]]
            d = np.sqrt(_squares(points[row[open_]] - now[mine]))
            inside = d <= radius[node[open_]]
            child[open_[inside]] = made + mine[inside]
            far[open_[inside]] = d[inside]
            heads.append((owner, now))
            made += len(owner)
            open_ = open_[~inside]
            owner, lead = np.unique(node[open_], return_index=True)
            now = points[row[open_[lead]]]
        owners, centres = np.concatenate([h[0] for h in heads]), np.concatenate([h[1] for h in heads])
        # Children of a node next to each other, in the order they were made.
        rank = np.lexsort((np.arange(made), owners))
        renamed = np.empty(made, np.int64)
        renamed[rank] = np.arange(made)
        child = renamed[child]
        turn = np.argsort(child, kind="stable")
        counts = np.bincount(child, minlength=made)
        held = np.flatnonzero(counts)
        self.order[spot] = row[turn]
        begins = np.cumsum(counts) - counts
        reach = np.zeros(made)
        np.maximum.at(reach, child, far)
        new_start = spot[np.minimum(begins, len(spot) - 1)]
        return at[owners[rank][held]], centres[rank][held], new_start[held], (new_start + counts)[held], reach[held]

    def nearest(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of every point in the order of the tree, ties to the lower index."""
        out = np.empty(len(self.points), np.int64)
        nodes = np.zeros(1, np.int64)
        while len(nodes):
            d = np.sqrt(_distances(self.centre[nodes], entries))
            best = d.argmin(axis=1)
            least = d[np.arange(len(d)), best]
            d[np.arange(len(d)), best] = np.inf
            second = d.min(axis=1, initial=np.inf)
            # Nearest for all below; the margin covers the rounding of roots.
            whole = least + 2 * self.reach[nodes] < second * (1 - 1e-9) - 1e-6
            _fill(out, self.start[nodes[whole]], self.end[nodes[whole]], best[whole])
            nodes = nodes[~whole]
            leaf = self.kids[nodes] == 0
            spots = _ranges(self.start[nodes[leaf]], self.end[nodes[leaf]])
            out[spots] = _distances(self.points[spots], entries).argmin(axis=1)
            nodes = _ranges(self.first[nodes[~leaf]], self.first[nodes[~leaf]] + self.kids[nodes[~leaf]])
        return out

    def totals(self, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points of each entry, from runs of equal codes and the cumulative sums."""
        starts = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
        ends = np.r_[starts[1:], len(codes)]
        sums, counts = np.zeros((entries, self.points.shape[1]), np.int64), np.zeros(entries, np.int64)
        np.add.at(sums, codes[starts], self.sums[ends] - self.sums[starts])
        np.add.at(counts, codes[starts], ends - starts)
        return sums, counts


def _squares(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(axis=1)


def _distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for c in range(points.shape[1]):
        d = points[:, c, None] - entries[None, :, c]
        out += d * d
    return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _fill(out: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> None:
    out[_ranges(starts, ends)] = np.repeat(values, ends - starts)


_ARRAYS = {"centre": "<i4", "reach": "<f8", "start": "<i4", "end": "<i4", "kids": "<i4", "first": "<i4", "order": "<i4", "points": "<i4"}


def _packed(tree: CoverTree) -> list[bytes]:
    return [getattr(tree, a).astype(kind).tobytes() for a, kind in _ARRAYS.items()]


def _unpacked(packed, width: int) -> CoverTree:
    tree = CoverTree.__new__(CoverTree)
    for data, (a, kind) in zip(packed, _ARRAYS.items()):
        values = np.frombuffer(data, kind).astype("f8" if kind == "<f8" else "i8")
        setattr(tree, a, values.reshape(-1, width) if a in ("centre", "points") else values)
    tree.sums = np.vstack([np.zeros((1, width), np.int64), np.cumsum(tree.points, axis=0)])
    return tree


def whole_numbers(vectors, dim: int, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale * x), filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.clip(np.floor(out * scale), -LIMIT, LIMIT).astype(np.int64)


def kept_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(v.isNotNull()).where((F.size(v) > 0) & finite).select(
        F.col(id).cast("long").alias("id"), v.alias("v"), F.col(label).alias("label"))


class Codebooks:
    """``entries[part]``: whole components of the entries of a part, all of the same ``width``."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.count, self.width = entries.shape

    def moved(self, sums: DataFrame) -> Codebooks:
        """Each used entry at the mean of its points, rounded down; ``sums(part, entry, place, s, n)``, a row a component."""
        out = self.entries.copy()
        for part, entry, place, s, n in sums.toLocalIterator():
            out[part, entry, place] = int(s) // int(n)
        return Codebooks(out)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def trees_table(rows: DataFrame, dim: int, parts: int, block: int = BLOCK) -> tuple[DataFrame, str]:
    """A row a block: its ids and labels as text, and a cover tree a part."""
    width = dim // parts

    def grown(part: pd.DataFrame) -> pd.DataFrame:
        points = whole_numbers(part["v"], dim)
        return pd.DataFrame({"id": [part["id"].tolist()], "label": [part["label"].tolist()], "trees": [
            [_packed(CoverTree(np.ascontiguousarray(points[:, p * width:(p + 1) * width]))) for p in range(parts)]]})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= block:
                whole = pd.concat(held, ignore_index=True)
                yield grown(whole[:block])
                held, n = [whole[block:]], n - block
        if n:
            yield grown(pd.concat(held, ignore_index=True))

    text = rows.select(F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), "v")
    return kept_table(text.mapInPandas(build, "id array<string>, label array<string>, trees array<array<binary>>"), "cover-trees")


def round_sums(trees: DataFrame, books: Codebooks) -> DataFrame:
    """``(part, entry, place, s, n)``: sums of the components and the number of points of each used entry."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((books.parts, books.count, books.width), np.int64)
        counts = np.zeros((books.parts, books.count), np.int64)
        for batch in batches:
            for packed in batch["trees"]:
                for p, own in enumerate(packed):
                    tree = _unpacked(own, books.width)
                    s, n = tree.totals(tree.nearest(books.entries[p]), books.count)
                    sums[p] += s
                    counts[p] += n
        p, e = np.nonzero(counts)
        for place in range(books.width):
            yield pd.DataFrame({"part": p, "entry": e, "place": place, "s": sums[p, e, place], "n": counts[p, e]})

    found = trees.select("trees").mapInPandas(assign, "part int, entry int, place int, s long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))


def coded(trees: DataFrame, books: Codebooks) -> DataFrame:
    """``(id, label, code, error)`` of every row."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, labels, packed in zip(batch["id"], batch["label"], batch["trees"]):
                codes, error = np.zeros((len(ids), books.parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, own in enumerate(packed):
                    tree = _unpacked(own, books.width)
                    found = tree.nearest(books.entries[p])
                    codes[tree.order, p] = found
                    error[tree.order] += _squares(tree.points - books.entries[p][found])
                yield pd.DataFrame({"id": ids, "label": labels, "code": [c.tobytes().hex() for c in codes], "error": error})

    return trees.mapInPandas(assign, "id string, label string, code string, error long")


RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Codes and errors of all rows under codebooks moved ``rounds`` times; ``entries`` is 256 at most."""
    spark, rows = vectors.sparkSession, kept_vectors(vectors)
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], RESULT)
    dim = -(-dim // parts) * parts
    # As many rows as a codebook has entries.
    start = whole_numbers([r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()], dim)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2)))
    trees, path = trees_table(rows, dim, parts, block)
    for _ in range(rounds):
        books = books.moved(round_sums(trees, books))
    found, _ = kept_table(coded(trees, books), "cover-codes")
    drop_table(spark, path)
    by_label, _ = kept_table(found.groupBy("label").agg(F.sum("error").alias("label_error")), "cover-labels")
    other = by_label.withColumnRenamed("label", "_label")
    if by_label.count() <= SMALL_LABELS:
        other = F.broadcast(other)
    return found.join(other, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``embeddings``: 16 parts, 64 entries, two rounds."""
    return encode(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _assigned(name: str, books: str) -> str:
    """The nearest entry of every part of every row under the entries of ``books(p, e, c)``."""
    return f"""{name} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT r, part.p, b.e, list_sum(list_transform(range(1, 5), lambda i: (part.c[i] - b.c[i]) * (part.c[i] - b.c[i]))) AS d
        FROM part JOIN {books} b USING (p)) GROUP BY r, p)"""


def _moved(name: str, assigned: str, books: str) -> str:
    # Whole-number division rounds to zero, so the remainder decides.
    means = ", ".join(
        f"(sum(part.c[{i}]) - ((sum(part.c[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, 5))
    return f"""{name} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
        SELECT a.p, a.e, [{means}]::BIGINT[] AS c FROM {assigned} a JOIN part USING (r, p) GROUP BY a.p, a.e) m USING (p, e))"""


#: For vectors of 64 components under distinct ids.
ORACLE = f"""WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
        FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
    part AS (SELECT r, p, c[4 * p + 1:4 * p + 4] AS c FROM kept, range(16) t(p)),
    b0 AS (SELECT p, r - 1 AS e, c FROM part WHERE r <= 64),
    {_assigned("a0", "b0")}, {_moved("b1", "a0", "b0")}, {_assigned("a1", "b1")}, {_moved("b2", "a1", "b1")}, {_assigned("a2", "b2")},
    code AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
    whole AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN code USING (r), whole"""
