"""The trie of conversation prefixes, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by a digest of position-bound hashes of its turns, which are added up along a
conversation, so a conversation of any length can be cut into chunks. Totals go up in shards: nodes are sorted by reverse level order,
and every node sends its total to its parent through a priority queue that spills to the task's own unnamed file. A node's weight,
the turns of its members from there on, bounds its subtree without walking it; nodes of equal weight // ``limit`` that hang
together are a shard, which has fewer than ``limit`` nodes. Shards are then nodes of a smaller tree, which is treated alike, and its totals
come back to the heavy shards as messages.

Rows with a null conv_id belong to no conversation. Turns are ordered by ``turn``, null first, and a digest of role and text where that ties;
repeated rows are turns of their own. Null roles and texts are empty. An empty table has no node at all.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.common import kept_table
from txnlens.operators.ordered import prior

#: Turns below a node from which on its subtree is several shards.
LIMIT = 20_000
#: Messages held in memory by one queue.
HELD = 200_000
#: Turns taken over at most, and conversations that share their source.
SHARED, FAMILY = 6, 100
SMALL_NODES = 100_000
_SUMS = ("s0", "s1", "s2", "s3")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, digest, chars)`` of every turn; texts aren't needed after this."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.length(text).cast("long").alias("chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns ``(conv, pos, size, digest, chars)`` and all conversations ``(conv, size)``."""
    placed, _ = kept_table(
        prior(turns, ["conv"], ["turn", "digest"], {"_before": ("count", F.lit(1))}).select(
            "conv", (F.col("_before") + 1).alias("pos"), "digest", "chars"), "trie-turns")
    base, taken = F.col("conv") - F.col("conv") % FAMILY, F.crc32(F.col("conv").cast("string")) % SHARED
    counts, _ = kept_table(placed.groupBy("conv").agg(F.max("pos").alias("n")), "trie-counts")
    sources = counts.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs, _ = kept_table(
        counts.select("conv", "n", base.alias("base"), taken.alias("h")).join(sources, "base", "left")
        .withColumn("got", F.least("h", F.coalesce("base_n", F.lit(0))))
        .select("conv", "base", "h", "got", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "trie-convs")
    own = placed.where(F.col("pos") > taken).join(convs.select("conv", "h", "got", "size"), "conv")
    heads = placed.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < SHARED)).select(
        F.col("conv").alias("base"), "pos", "digest", "chars")
    copied = convs.join(heads, "base").where("pos <= h").select("conv", "pos", "size", "digest", "chars")
    turns, _ = kept_table(own.select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "size", "digest", "chars").unionByName(copied),
                          "trie-rebuilt")
    return turns, convs.select("conv", "size")


def paths_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv, pos, size, node, parent, chars, proof)``: the nodes that each conversation is a member of, from the root."""
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = F.xxhash64("pos", "digest"), F.xxhash64("digest", "pos")
    hashed = turns.withColumns(dict(zip(_SUMS, (low(a), F.shiftrightunsigned(a, 32), low(b), F.shiftrightunsigned(b, 32)))))
    name = lambda pos, sums: F.md5(F.concat_ws(",", pos, *sums))
    earlier = prior(hashed, ["conv"], ["pos"], {f"p{s}": ("sum", F.col(s)) for s in _SUMS})
    before = [F.coalesce(F.col(f"p{s}"), F.lit(0)) for s in _SUMS]
    below = earlier.select(
        "conv", "pos", "size", name(F.col("pos"), [p + F.col(s) for p, s in zip(before, _SUMS)]).alias("node"),
        name(F.col("pos") - 1, before).alias("parent"), "chars", F.xxhash64("digest").alias("proof"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("pos"), "size", name(zero, [zero] * 4).alias("node"),
                        F.lit(None).cast("string").alias("parent"), zero.alias("chars"), zero.alias("proof"))
    return kept_table(below.unionByName(root), "trie-paths")[0]


def nodes_of(paths: DataFrame) -> DataFrame:
    """A row a node; members of one node with unlike last turns or parents would be a collision of digests and end the query."""
    parent = F.xxhash64("parent")
    same = (F.min("proof") == F.max("proof")) & (F.min(parent) == F.max(parent))
    found = paths.groupBy("node", "parent").agg(
        F.min("pos").alias("depth"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.sum(F.col("size") - F.col("pos") + 1).alias("weight"), F.sum((F.col("pos") == F.col("size")).cast("long")).alias("ends"),
        F.when(same, 0).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).alias("checked"))
    return found.select(
        "node", "parent", "depth", (F.col("depth") - 1).alias("up"), "conv", "n_convs", "weight", "ends", "checked", F.lit(0).cast("long").alias("children"),
        (F.col("ends") == F.col("n_convs")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))


class SpillingQueue:
    """A priority queue of tuples; what exceeds ``held`` entries is written as a sorted run to an unnamed file of this task."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.files = held, [], []
        #: The next entry of each run, and its place.
        self.heads: list[tuple] = []
        self.runs: list[Iterator] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            file = tempfile.TemporaryFile()
            self.heap.sort()
            for at in range(0, len(self.heap), 1_000):
                pickle.dump(self.heap[at:at + 1_000], file)
            file.seek(0)
            self.heap = []
            self.files.append(file)
            self.runs.append(self._read(file))
            self._advance(len(self.runs) - 1)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                file.close()
                return

    def _advance(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heads, (item, run))

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = heapq.heappop(self.heads)
            self._advance(run)
            return item
        return heapq.heappop(self.heap)


FORWARD = ["node", "parent", "depth", "up", "conv", "n_convs", "shard", "children", "leaves", "saved"]


def forward(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """Totals of each node over its subtree within its shard; ``children``, ``leaves`` and ``saved`` come in as what it has by itself.

    ``up`` is the depth of the parent.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = SpillingQueue(held)
        for batch in batches:
            out = []
            for node, parent, depth, up, shard, children, leaves, saved in zip(
                    *(batch[c].tolist() for c in ("node", "parent", "depth", "up", "shard", "children", "leaves", "saved"))):
                while (m := queue.peek()) is not None and m[0] == -depth and m[1] == node:
                    queue.pop()
                    children, leaves, saved = children + 1, leaves + m[2], saved + m[3]
                out.append((children, leaves, saved))
                if node != shard:
                    queue.push((-up, parent, leaves, saved))
            yield batch.assign(**dict(zip(("children", "leaves", "saved"), map(list, zip(*out))))) if out else batch

    ordered = nodes.select(*FORWARD).repartition("shard").sortWithinPartitions(F.desc("depth"), "node")
    return ordered.mapInPandas(run, "node string, parent string, depth long, up long, conv long, n_convs long, shard string, children long, leaves long, saved long")


def _with_messages(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """``nodes`` with what the tops of other shards, ``totals``, send them."""
    sent = totals.groupBy(F.col("parent").alias("_to")).agg(
        F.count(F.lit(1)).alias("_children"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    joined = nodes.join(sent, F.col("node") == F.col("_to"), "left")
    return joined.select(*[
        (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) if c in ("children", "leaves", "saved") else F.col(c) for c in nodes.columns])


def subtree_totals(paths: DataFrame, nodes: DataFrame, limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """``nodes`` with ``children``, ``leaves`` and ``saved`` of their whole subtrees.

    ``paths(conv, pos, node)`` are the nodes of each conversation, of which that of ``nodes.conv`` is used; ``weight`` of a node exceeds the sum of
    its children's.
    """
    step = F.floor(F.col("weight") / limit).cast("long")
    heavy, _ = kept_table(nodes.where(F.col("weight") >= limit).select("node", step.alias("q")), "trie-heavy")
    count = heavy.count()
    if not count:
        # The root is one row, if there is any.
        root = nodes.where("parent IS NULL").select(F.col("node").alias("shard"))
        return forward(nodes.join(F.broadcast(root)), held)
    told = paths.join(F.broadcast(heavy) if count <= SMALL_NODES else heavy, "node", "left").withColumn("q", F.coalesce("q", F.lit(0)))
    tops, _ = kept_table(told.groupBy("conv", "q").agg(F.min(F.struct("pos", "node")).alias("t")).select("conv", "q", "t.pos", F.col("t.node").alias("shard")), "trie-tops")
    sharded, _ = kept_table(nodes.withColumn("q", step).join(tops.drop("pos"), ["conv", "q"]), "trie-shards")
    low, _ = kept_table(forward(sharded.where("q = 0"), held), "trie-low")
    high, _ = kept_table(_with_messages(sharded.where("q > 0"), low.where("node = shard")), "trie-high")
    local, _ = kept_table(forward(high, held), "trie-local")
    # The heavy shards as a tree: a path of a conversation holds each of them once.
    first = local.where("node = shard").select("node", F.col("parent").alias("_parent"), "depth", "conv", "n_convs", "leaves", "saved")
    owner = high.select(F.col("node").alias("_parent"), F.col("shard").alias("parent"))
    weights = high.where("node = shard").select("node", (2 * F.col("q") - 1).alias("weight"))
    above_top = first.select(F.col("node").alias("parent"), F.col("depth").alias("up"))
    smaller, _ = kept_table(
        first.join(owner, "_parent", "left").join(above_top, "parent", "left").join(weights, "node").select(
            "node", "parent", "depth", F.coalesce("up", F.lit(-1).cast("long")).alias("up"), "conv", "n_convs", "weight", F.lit(0).cast("long").alias("children"), "leaves", "saved"), "trie-contracted")
    above = subtree_totals(tops.where("q > 0").select("conv", "pos", F.col("shard").alias("node")), smaller, limit, held)
    # Their totals belong to the node that the top of the shard hangs on.
    sent = above.select("node", "leaves", "saved").join(first.select("node", F.col("_parent").alias("parent")), "node").where("parent IS NOT NULL")
    return low.unionByName(forward(_with_messages(high, sent), held))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def end_hashes(paths: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of the nodes at which conversations end: ids in pieces of 256 numbers, hashed one after the other."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch["node"], batch["ids"]):
                if node != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["node", "ends_sha256"])

    pieces = paths.where("pos = size").groupBy("node", F.shiftright("conv", 8).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInPandas(run, "node string, ends_sha256 string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """A row a node, with the digest ``node`` of its prefix and that of its parent."""
    turns, convs = rebuilt(kept_table(turns_of(conversations), "trie-input")[0])
    paths = paths_of(turns, convs)
    nodes, _ = kept_table(nodes_of(paths), "trie-nodes")
    totals, _ = kept_table(subtree_totals(paths.select("conv", "pos", "node"), nodes.drop("ends", "checked"), limit, held), "trie-totals")
    parents = totals.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return totals.join(parents, "parent", "left").join(end_hashes(paths), "node", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "node", "parent")


def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``conversations``."""
    return prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet")).select(*RESULT)


#: The parent's id is a double here, as a column of whole numbers and nulls is one in pandas. CRC-32 bit by bit for the table, then byte by byte over the decimal digits.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda k: ord(substr(conv_id::VARCHAR, k, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
ORACLE = f"""WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM range(256) r(i)),
    own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS l
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    cut AS (SELECT conv_id, conv_id - conv_id % 100 AS base, l, ({_CRC}) % 6 AS h FROM own, crc),
    whole AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.l, 1, a.h), []), list_slice(a.l, a.h + 1, len(a.l))) AS l
        FROM cut a LEFT JOIN own b ON a.base = b.conv_id),
    node AS (SELECT d AS depth, list_slice(l, 1, d) AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(string_agg(CASE WHEN d = len(l) THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
        FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM whole) GROUP BY ALL),
    kids AS (SELECT depth - 1 AS depth, list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
    full_node AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(key[-1].t) ELSE 0 END AS saved
        FROM node n LEFT JOIN kids k USING (depth, key)),
    total AS (SELECT depth, key, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (
        SELECT d AS depth, list_slice(key, 1, d) AS key, n_children, saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_node)) GROUP BY ALL)
    SELECT n.conv_id, n.depth, p.conv_id::DOUBLE AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, sha256(n.ends) AS ends_sha256
    FROM full_node n JOIN total t USING (depth, key) LEFT JOIN node p ON p.depth = n.depth - 1 AND p.key = list_slice(n.key, 1, n.depth - 1)"""
