"""SimHash near-duplicates: fingerprints within a few bits are found by blocks they must share, then verified.

Fingerprints of ``bits`` or fewer differing bits, cut into m blocks, agree on at least m - bits whole blocks. Every choice of
m - bits blocks is a join key, so no link is missed whatever m is; m grows with the number of fingerprints, so that a key of
unrelated ones stays small. Equal fingerprints are one node. Null texts count as empty, and texts without words have the
fingerprint zero. Rows with a null doc_id keep their fingerprint; the group takes the least id that is not null. Rows that
repeat a doc_id each get their own output row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat
from math import log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.common import clean_docs, components, drop_table, kept_alone, kept_table, read_documents, unused

SEED = 42
#: Independent fingerprints of the distinct words; near copies are close in one of them, at least.
SEEDS = (SEED, SEED + 1, SEED + 2)
#: Shingles whose bits are unpacked at once.
_SLAB = 1 << 15
#: Bits of the parity of a shingle set, at least; there are as many as shingles, so long texts are told apart as well as short ones.
LEAST_PARITY = 64
#: Nodes that share a key by chance and are compared in one task, about; nodes that are compared without cutting them further.
GROUP_NODES, BRUTE_NODES = 1 << 15, 1 << 12
#: Nodes that are compared with all others of their group at once; words of parities that are compared at once.
ROWS_AT_ONCE, WORDS_AT_ONCE = 256, 1 << 20
#: Pairs that a task gathers before it reduces them to a forest.
MANY_PAIRS = 1 << 17
#: Ids that are sent to every task, at most.
SMALL_IDS = 1_000_000


def shingles_of(parts: list[bytes], words: int) -> list[bytes]:
    """Runs of ``words`` words, repeats included; of fewer words the whole."""
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[s:e] for s, e in zip(starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist())]


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _hashes(shingles: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))


def fingerprint(text: str, words: int = 4, seed: int = SEED) -> int:
    """64 bits; a bit is 1 where it is set in over half the hashes of the shingles. With no ``words``, of the distinct words."""
    parts = split_words(text)
    return _majority(_hashes(shingles_of(parts, words) if words else list(dict.fromkeys(parts)), seed))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLAB):
        octets = hashes[at:at + _SLAB].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits in a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.view(np.int64)})

    return clean_docs(docs).mapInPandas(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_count(nodes: int, bits: int) -> int:
    """Least number of blocks whose keys hold two bits more than the count of fingerprints has."""
    m = bits + 1
    while m < 32 and 64 * (m - bits) / m < log2(max(nodes, 2)) + 2:
        m += 1
    return m


def block_masks(m: int, bits: int) -> list[int]:
    """One mask for each choice of ``m - bits`` of the m blocks."""
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    return [sum(blocks[i] for i in kept) for kept in combinations(range(m), m - bits)]


def links(nodes: DataFrame, count: int, bits: int = 4) -> DataFrame:
    """``(a, b)`` fingerprints of ``nodes(fp)`` (distinct) whose components are those of all pairs within ``bits`` bits.

    First every fingerprint is compared with the least one under each of its keys, which costs one comparison a key and
    joins most of a large group. After that only fingerprints outside the component of that least one are compared with the
    others under the key, so a group of near copies isn't multiplied out.
    """
    spark = nodes.sparkSession
    masks = block_masks(block_count(count, bits), bits)
    keys = nodes.select("fp", F.explode(block_keys("fp", masks)).alias("k")).select("fp", "k.c", "k.v")
    heads = keys.groupBy("c", "v").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared, shared_path = kept_table(keys.join(heads, ["c", "v"]), "simhash-keys")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    to_head, _ = kept_table(
        shared.select(F.col("fp").alias("a"), F.col("head").alias("b")).where("a <> b").where(near).distinct(), "simhash-links")
    group, _ = kept_table(components(to_head), "simhash-groups")
    grouped = shared.join(group, F.col("fp") == F.col("node"), "left").select(
        "c", "v", "fp", "head", F.coalesce("root", "fp").alias("g"))
    head_group = group.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    tagged, tagged_path = kept_table(
        grouped.join(head_group, "head", "left").select(
            "c", "v", "fp", "g", (F.col("g") != F.coalesce("head_root", "head")).alias("apart")), "simhash-tagged")
    left = tagged.where("apart").select("c", "v", F.col("fp").alias("a"), F.col("g").alias("ga"))
    right = tagged.select(
        F.col("c").alias("_c"), F.col("v").alias("_v"), F.col("fp").alias("b"), F.col("g").alias("gb"), "apart")
    across, _ = kept_table(left.join(right, (F.col("c") == F.col("_c")) & (F.col("v") == F.col("_v")) & (F.col("ga") != F.col("gb"))
                                     & (~F.col("apart") | (F.col("a") < F.col("b"))) & near).select("a", "b").distinct(), "simhash-links")
    drop_table(spark, shared_path, tagged_path)
    return to_head.unionByName(across)


def block_keys(fp: str, masks: list[int], first: int = 0) -> Column:
    """The keys ``(c, v, f)`` of a fingerprint: the number of a choice of blocks, the bits in them, and the fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("c"), F.col(fp).bitwiseAND(F.lit(_signed(x))).alias("v"), F.col(fp).alias("f"))
                     for i, x in enumerate(masks, first)])


def wide_masks(nodes: int, bits: int) -> list[int]:
    """Masks of as few blocks as leave groups of ``GROUP_NODES`` unrelated fingerprints, about: few keys a node, so few rows to move."""
    m = bits + 1
    while m < 32 and nodes >> (64 * (m - bits) // m) > GROUP_NODES:
        m += 1
    return block_masks(m, bits)


def close_pairs(f: np.ndarray, bits: int, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``a, b`` of all pairs of ``f`` within ``bits`` bits, each once; ``mask`` has the bits in which all agree.

    A large group is cut by further blocks: pairs agree in one of ``bits + 1`` blocks of the other bits.
    """
    rest = np.array_split([i for i in range(64) if not mask >> i & 1], bits + 1)
    parts = [np.uint64(sum(1 << int(i) for i in part)) for part in rest] if len(f) > BRUTE_NODES else [np.uint64(0)]
    for k, part in enumerate(parts):
        order = np.argsort(f & part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff((f & part)[order])) + 1):
            x = f[own]
            for at in range(0, len(own), ROWS_AT_ONCE):
                end = min(at + ROWS_AT_ONCE, len(own))
                a, b = np.nonzero(np.bitwise_count(x[at:end, None] ^ x[None, :end]) <= bits)
                a += at
                keep = b < a
                for earlier in parts[:k]:
                    keep &= (x[a] ^ x[b]) & earlier != 0
                yield own[a[keep]], own[b[keep]]


def bits_apart(parities: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the parities at ``a`` and ``b`` differ. A longer one is folded: so it would be with fewer bits."""
    words = np.fromiter((len(p) // 8 for p in parities), np.int64, len(parities))
    least, out = np.minimum(words[a], words[b]), np.zeros(len(a), np.int64)
    for width in np.unique(least):
        at = np.flatnonzero(least == width)
        own, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(parities[i], "<u8").reshape(-1, width), axis=0) for i in own])
        x, y, step = place[:len(at)], place[len(at):], max(WORDS_AT_ONCE // int(width), 1)
        for s in range(0, len(at), step):
            out[at[s:s + step]] = np.bitwise_count(folded[x[s:s + step]] ^ folded[y[s:s + step]]).sum(axis=1, dtype=np.int64)
    return out


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges ``a, b`` of a spanning forest of least weight, the lightest first."""
    order = np.argsort(weight, kind="stable")
    a, b, weight = a[order], b[order], weight[order]
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root, left, chosen = list(range(len(nodes))), np.arange(len(a)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    while len(left):
        # The lightest edge of every tree is in the forest; equal weights are told apart by the order.
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, x[left], left)
        np.minimum.at(best, y[left], left)
        for e in np.unique(best[best < len(a)]).tolist():
            root[find(x[e])] = find(y[e])
            chosen.append(e)
        label = np.array([find(i) for i in range(len(nodes))])
        x, y = label[x], label[y]
        left = left[x[left] != y[left]]
    chosen = np.array(sorted(chosen), np.int64)
    return a[chosen], b[chosen], weight[chosen]


def group_pairs(group: pd.DataFrame, masks: list[int], c: int, bits: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one key's rows ``(f, n, p, g)`` that may be similar: all in different groups ``g``, or a spanning forest.

    Two sets with a Jaccard similarity of 0.8 or more differ in a ninth of the sum of their sizes at most, and every bit in
    which the parities differ is one shingle. A pair that agrees under an earlier mask belongs there.
    """
    f, n, g = group["f"].to_numpy().view(np.uint64), group["n"].to_numpy(), group["g"].to_numpy()
    parities = group["p"].tolist()
    a, b, w = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for x, y in close_pairs(f, bits, masks[c]):
        keep = (g[x] != g[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
        for earlier in masks[:c]:
            keep &= (f[x] ^ f[y]) & np.uint64(earlier) != 0
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        apart, both = bits_apart(parities, x, y), n[x] + n[y]
        may = 9 * apart <= both
        a, b, w = np.concatenate([a, x[may]]), np.concatenate([b, y[may]]), np.concatenate([w, apart[may] / both[may]])
        if not every and len(a) > MANY_PAIRS:
            a, b, w = spanning(a, b, w)
    return (a, b) if every else spanning(a, b, w)[:2]


def candidates(nodes: DataFrame, count: int, bits: int, names: list[str], every: bool) -> DataFrame:
    """``(a, b)`` of ``nodes(node, g, n, p, …)`` within ``bits`` bits by one of the fingerprints ``names`` that may be similar.

    Under each key come all pairs of different ``g``, or only a spanning forest of them, the closest pairs first. Either way the
    pairs under all keys join the same nodes; a forest has fewer pairs than nodes, however large a group of near copies is.
    """
    masks = wide_masks(count, bits)

    def found(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if sum(map(len, parts)) > 1:
            group = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            a, b = group_pairs(group, masks, int(group["c"].iat[0]) % len(masks), bits, every)
            if len(a):
                node = group["node"].to_numpy()
                yield pd.DataFrame({"a": np.maximum(node[a], node[b]), "b": np.minimum(node[a], node[b])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, key = [], None
        for batch in batches:
            c, v = batch["c"].to_numpy(), batch["v"].to_numpy()
            starts = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(v) != 0)) + 1).tolist()]
            for s, e in zip(starts, [*starts[1:], len(batch)]):
                if s < e and key != (c[s], v[s]):
                    yield from found(waiting)
                    waiting, key = [], (c[s], v[s])
                waiting.append(batch.iloc[s:e])
        yield from found(waiting)

    keys = F.concat(*[block_keys(f, masks, i * len(masks)) for i, f in enumerate(names)])
    rows = nodes.select("node", "g", "n", "p", F.explode(keys).alias("k")).select("k.c", "k.v", "node", "k.f", "n", "g", "p")
    return rows.repartition("c", "v").sortWithinPartitions("c", "v").mapInPandas(run, "a long, b long").distinct()


def verified_links(nodes: DataFrame, count: int, bits: int, names: list[str], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` of ``nodes(node, n, p, …)``: their components are those of all pairs with fingerprints within ``bits`` bits
    under one of ``names`` that ``verify`` keeps.

    ``verify`` only sees pairs whose sizes ``n`` and parities ``p`` allow a similarity. First it sees a spanning forest of these pairs. Where
    it keeps the whole tree, nothing else can be joined. Only nodes of the other trees are compared again, and all pairs across
    the groups found by then are verified.
    """
    first, _ = kept_table(candidates(nodes.withColumn("g", F.col("node")), count, bits, names, False), "simhash-forest")
    found, _ = kept_table(verify(first), "simhash-links")
    if found.count() == first.count():
        return found
    tree, _ = kept_table(components(first), "simhash-trees")
    group = components(found).withColumnRenamed("root", "g")
    tagged, _ = kept_table(tree.join(group, "node", "left").select("node", "root", F.coalesce("g", "node").alias("g")), "simhash-groups")
    torn = tagged.groupBy("root").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("root")
    left = nodes.join(tagged.join(torn, "root", "left_semi").select("node", "g"), "node")
    more = candidates(left, count, bits, names, True).join(first, ["a", "b"], "left_anti")
    return found.unionByName(verify(more))


def near_groups(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; ``component_id`` is the least ``doc_id`` that chains of links reach."""
    fps, nodes = fingerprint_nodes(docs, words)
    groups = components(links(nodes.select("fp"), nodes.count(), bits))
    rooted = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("g"))
    ids = rooted.groupBy("g").agg(F.min("least_id").alias("component_id"))
    return fps.join(rooted.select("fp", "g").join(ids, "g").drop("g"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_nodes(docs: DataFrame, words: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The rows ``(doc_id, fp)``, and the distinct fingerprints with their least id."""
    fps, _ = kept_table(fingerprints(docs, words, seed), "simhash-rows")
    nodes, _ = kept_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    return fps, nodes


def as_ids(nodes: DataFrame, found: DataFrame, key: str = "fp") -> DataFrame:
    """Links between nodes as links ``(x, y)`` between their least ids, with the nodes."""
    a, b = (nodes.select(F.col(key).alias(k), F.col("least_id").alias(i)) for k, i in (("a", "x"), ("b", "y")))
    return found.join(a, "a").join(b, "b").where("x IS NOT NULL AND y IS NOT NULL")


def to_least(rows: DataFrame, nodes: DataFrame, key: str = "fp") -> DataFrame:
    """``(x, y)``: each other id of a node with its least one."""
    return rows.join(nodes, key).where("doc_id > least_id").select(F.col("doc_id").alias("x"), F.col("least_id").alias("y")).distinct()


def shingle_set(text: str, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    return np.unique(_hashes(shingles_of(split_words(text), words)))


def parity(hashes: np.ndarray) -> bytes:
    """Bits, each flipped by every hash that falls on it; a power of two of them, not fewer than hashes."""
    size = max(LEAST_PARITY, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def text_nodes(docs: DataFrame, words: int, seeds: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows ``(doc_id, node)`` with a digest of the shingle set, and the distinct nodes with their least id.

    Nodes have the fingerprints of the distinct words under each of ``seeds``, ``f0`` and so on, the number ``n`` of shingles and
    their parity ``p``.
    """
    names = [f"f{i}" for i in range(len(seeds))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                shingles = shingle_set(text, words)
                fps = np.array([_digest(shingles), *(fingerprint(text, 0, s) for s in seeds)], np.uint64).view(np.int64)
                rows.append([*fps.tolist(), len(shingles), parity(shingles)])
            out = pd.DataFrame(rows, columns=["node", *names, "n", "p"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    found = clean_docs(docs).mapInPandas(
        run, ", ".join(f"{c} long" for c in ["doc_id", "node", *names, "n"]) + ", p binary")
    rows, _ = kept_table(found.where("doc_id IS NOT NULL"), "simhash-texts")
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    # Nodes that stand for one row take its columns; the rows of one node have equal shingles.
    nodes, _ = kept_table(least.join(rows.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & (
        F.col("least_id") == F.col("doc_id"))).select("node", "least_id", *names, "n", "p").dropDuplicates(["node"]),
        "simhash-nodes")
    return rows.select("doc_id", "node"), nodes


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)`` of the documents in ``ids(doc_id)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            nodes = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": nodes, "shingles": [s.view(np.int64) for s in sets]})

    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    sets = clean_docs(docs).join(ids, "doc_id", "left_semi").mapInPandas(run, "node long, shingles array<long>")
    return sets.groupBy("node").agg(F.max("shingles").alias("shingles"))


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Those of ``pairs(a, b)`` of nodes whose shingle sets have a Jaccard similarity of 0.8 or more."""
    pairs, _ = kept_table(pairs, "simhash-candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets, _ = kept_table(shingle_sets(docs, nodes.join(ends, "node").select(F.col("least_id").alias("doc_id")).distinct(), words), "simhash-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    return both.where(9 * F.size(F.array_intersect("_a", "_b")) >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b")


def similar_links(docs: DataFrame, words: int = 5, bits: int = 6, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """``(x, y)`` ids of near copies: within ``bits`` bits by their distinct words, and similar by shingles of ``words`` words.

    A few changed words move a fingerprint of shingles by more bits than one of distinct words, so these find the pairs and the
    shingles decide. How far it moves differs from one hash to another, so the words are hashed under several ``seeds`` and one
    close fingerprint is enough. Only documents of equal shingle sets are one node: the same words in another order are
    another node under the same fingerprint, with near copies of its own.
    """
    rows, nodes = text_nodes(docs, words, seeds)
    # The tables of the search go once its links are written.
    found = kept_alone(docs.sparkSession, lambda: verified_links(
        nodes, nodes.count(), bits, [f"f{i}" for i in range(len(seeds))], lambda pairs: similar(docs, nodes, pairs, words)), "simhash-found")
    return as_ids(nodes, found, "node").select("x", "y").unionByName(to_least(rows, nodes, "node"))


def drop_near(docs: DataFrame, words: int = 5, bits: int = 4, word_bits: int = 6, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """The rows of ``docs`` that are the least of their group, with all their columns; rows without doc_id stay.

    Groups are joined by fingerprints within ``bits`` bits and by near copies, those within ``word_bits`` bits by their words
    under one of ``seeds``.
    """
    (other,) = unused(docs, "_gone")
    fps, nodes = fingerprint_nodes(docs, words)
    close = as_ids(nodes, links(nodes.select("fp"), nodes.count(), bits)).select("x", "y").unionByName(to_least(fps, nodes))
    groups = components(close.unionByName(similar_links(docs, words, word_bits, seeds)).toDF("a", "b"))
    gone, _ = kept_table(groups.where("node <> root").select(F.col("node").alias(other)), "simhash-gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone[other], "left_anti")


def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``documents``: 4-word shingles, 4 bits."""
    return near_groups(read_documents(spark, folder)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
