"""Entity graph: capped edges between rows that share a key, limited to what each phase may see."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.ordered import Chunks, history
from txnlens.session import cut_lineage

# Edges of one graph that always pass, and edges a node above that: the first limit over the nodes it was set for (590,540).
MAX_EDGES, MAX_EDGES_PER_NODE = 50_000_000, 84


@dataclass(frozen=True)
class EdgeSpec:
    """Rows sharing ``columns`` are linked to their next ``cap`` rows; sentinel values take part in no edge."""

    name: str
    columns: tuple[str, ...]
    cap: int
    sentinels: dict[str, float] = field(default_factory=dict)


def assert_edge_key_allowed(columns: Sequence[str]) -> None:
    """Encoded columns carry statistics of the label or the table and may not link rows."""
    bad = [c for c in columns if c.endswith(("_freq", "_target_enc", "_te"))]
    if bad:
        raise ValueError(f"encoded columns cannot be edge keys: {bad}")


def _eligible(spec: EdgeSpec) -> Column:
    tests = [F.col(c).isNotNull() for c in spec.columns]
    tests += [F.abs(F.col(c) - F.lit(v)) > 1e-8 for c, v in spec.sentinels.items()]
    if len(spec.columns) == 1:
        key = F.col(spec.columns[0]).try_cast("double")
        tests.append(F.coalesce(key >= 0, F.lit(True)))
    return reduce(lambda a, b: a & b, tests)


def capped_edges(df: DataFrame, node: str, spec: EdgeSpec, chunks: Chunks = None) -> DataFrame:
    """``(src, dst, spec)`` with ``src < dst``: pairs at rank distance 1 to ``cap`` among rows sharing the key.

    For groups of up to ``cap + 1`` rows this is the complete graph; every row emits at most ``cap`` edges.
    """
    assert_edge_key_allowed(spec.columns)
    rows = df.where(_eligible(spec)).select(node, *spec.columns)
    linked = history(rows, list(spec.columns), [node], F.col(node), spec.cap, "_prev", False, chunks)
    return linked.select(F.explode("_prev").alias("src"), F.col(node).alias("dst"), F.lit(spec.name).alias("spec"))


def edges_from_specs(df: DataFrame, node: str, specs: Sequence[EdgeSpec], chunks: Chunks = None) -> DataFrame:
    """Distinct undirected edges over several key sets."""
    parts = [capped_edges(df, node, s, chunks).select("src", "dst") for s in specs]
    # Caps bound the edges into a node, so they can be told apart where those of the node are: no further shuffle by ``dst``.
    return _undirected(reduce(DataFrame.unionByName, parts)).repartition("dst").distinct()


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def dedupe_pairs(edges: DataFrame) -> DataFrame:
    return _undirected(edges).distinct()


def with_phase(edges: DataFrame, n_train: Column | int, n_val_end: Column | int) -> DataFrame:
    """First phase that may use the edge, from its later endpoint."""
    late = F.greatest("src", "dst")
    return edges.withColumn("phase", F.when(late < n_train, "train").when(late < n_val_end, "val").otherwise("test"))


def directed(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without a second pass over the input."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ends).alias("_e"), *rest).select("_e.*", *rest)


def edge_estimate(df: DataFrame, specs: Sequence[EdgeSpec]) -> DataFrame:
    """Edges each spec will produce, from group sizes alone."""
    parts = []
    for s in specs:
        g = df.where(_eligible(s)).groupBy(*s.columns).agg(F.count(F.lit(1)).alias("g"))
        c = F.lit(s.cap)
        edges = F.when(F.col("g") <= c + 1, F.col("g") * (F.col("g") - 1) / 2).otherwise(
            c * F.col("g") - c * (c + 1) / 2)
        parts.append(g.agg(F.sum(edges.cast("long")).alias("edges")).select(F.lit(s.name).alias("spec"), "edges"))
    return reduce(DataFrame.unionByName, parts)


def assert_edge_budget(df: DataFrame, specs: Sequence[EdgeSpec], limit: int | None = None) -> None:
    """Refuse keys and caps that link rows too densely; without a ``limit`` the budget grows with the nodes."""
    total = edge_estimate(df, specs).agg(F.sum("edges")).first()[0] or 0
    if limit is None:
        limit = MAX_EDGES if total <= MAX_EDGES else max(MAX_EDGES, MAX_EDGES_PER_NODE * df.count())
    if total > limit:
        raise ValueError(f"{total} edges exceed the budget of {limit}")


def degrees(edges: DataFrame, by: Sequence[str] = ("phase",)) -> DataFrame:
    return edges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("dst").alias("nodes"))


def graph_violations(nodes: DataFrame, edges: DataFrame, node: str = "node", split: str = "split") -> DataFrame:
    """Counts that must be zero: repeated nodes, edges seen before both ends exist, one-way edges, self loops."""
    level = lambda c: F.when(F.col(c) == "train", 0).when(F.col(c) == "val", 1).otherwise(2)
    repeated = nodes.groupBy(node).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    late = nodes.select(F.col(node).alias("dst"), level(split).alias("_node_level"))
    both = edges.select("src", "dst", level("phase").alias("_edge_level"))
    early = both.join(late, "dst").where("_node_level > _edge_level").agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    one_way = edges.groupBy(pair.alias("pair"), "phase").agg(
        F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(-1)).alias("balance")).where("balance <> 0").agg(
        F.count(F.lit(1)).alias("n"))
    loops = edges.where("src = dst").agg(F.count(F.lit(1)).alias("n"))
    named = {"repeated_nodes": repeated, "edges_before_node": early, "one_way_edges": one_way, "self_loops": loops}
    return reduce(DataFrame.unionByName, [
        d.select(F.lit(k).alias("rule"), F.col("n").alias("violations")) for k, d in named.items()])


def neighbor_mean(nodes: DataFrame, edges: DataFrame, cols: Sequence[str], node: str = "node", hops: int = 1) -> DataFrame:
    """Mean of each column over the neighbours, repeated ``hops`` times; nodes without neighbours keep 0.

    ``edges`` are directed and already limited to one phase. Sums are combined before the shuffle, so a
    node with very many neighbours costs one partial row per task.
    """
    if hops > 1:
        edges = cut_lineage(edges.select("src", "dst"))
    current = nodes.select(node, *cols)
    for hop in range(hops):
        gathered = (
            edges.select("src", "dst").join(current.withColumnRenamed(node, "src"), "src")
            .groupBy(F.col("dst").alias(node)).agg(*[F.avg(c).alias(f"_{c}") for c in cols]))
        current = nodes.select(node).join(gathered, node, "left").select(
            node, *[F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in cols])
        if hop + 1 < hops:
            current = cut_lineage(current)
    return current.select(node, *[F.col(c).alias(f"nbr_{c}") for c in cols])


def sample_neighbors(edges: DataFrame, fanout: int, seed: int = 42) -> DataFrame:
    """At most ``fanout`` edges into each node, in hash order."""
    # The bytes order like their hex digits and take half the room in the sort.
    u = F.unhex(F.md5(F.concat_ws(":", F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(str(seed)))))
    w = Window.partitionBy("dst").orderBy("_u", "src")
    return edges.withColumn("_u", u).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= fanout).drop("_u", "_rn")
