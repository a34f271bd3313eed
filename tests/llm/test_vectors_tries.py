"""Vector search, vector codes and the prefix trie against brute force on rows with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.llm import cover_codes, prefix_trie, projection_forest

VECTORS = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("label", "integer")


def vector_frame(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("v", "id", "ids", "q", "code", "error", "part", "_label", "rank", "score", "leaf"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(3)
    some = lambda n=16: [float(x) for x in rng.normal(size=n).astype(np.float32)]
    hot, far = some(), some()
    rows = [(None, some(), 1), (1, None, 1), (2, [], 2), (3, [0.0] * 16, 2), (4, [1.0, None] * 8, None), (5, [float("nan")] * 16, 3),
            (6, [float("inf")] + some(15), 3), (7, some(5), None), (8, [-0.0, 0.0] * 7 + [1.0, 2.0], 1), (8, some(), 4), (9, [1e30] * 16, 5),
            (50, some(), 1), (50, hot, 1), (50, hot, 1)]
    rows += [(100 + i, hot, None) for i in range(120)] + [(300 + i, [2 * x for x in hot], 7) for i in range(9)]
    return rows + [(1000 + i, some() if i % 5 else [float(np.float32(a + 0.01 * b)) for a, b in zip(far, some())], i % 3) for i in range(300)]


def brute_neighbours(rows, k, every):
    """Per query row, its nearest others; vectors as tuples of floats, equal ones tie exactly."""
    fit = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    dim = max(len(v) for _, v in fit)
    items = sorted((i, *v, *[0.0] * (dim - len(v))) for i, v in fit)
    ids, x = [i[0] for i in items], np.array([i[1:] for i in items], float)
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    out = []
    for a, i in enumerate(ids):
        if i % every == 0:
            s = np.round((x * x[a]).sum(axis=1), 12)
            best = sorted((-s[b], ids[b]) for b in range(len(ids)) if ids[b] != i)[:k]
            out += [(i, r + 1, j, float(-v)) for r, (v, j) in enumerate(best)]
    return sorted(out)


def test_small_tables_are_searched_exactly(spark, odd_vectors):
    found = projection_forest.nearest(vector_frame(spark, odd_vectors), lambda i: i % 50 == 0, region_rows=40, query_rows=3)
    got, truth = sorted(map(tuple, found.collect())), brute_neighbours(odd_vectors, 5, 50)
    assert [(g, t) for g, t in zip(got, truth) if g[:3] != t[:3]] == [] and len(got) == len(truth)
    assert np.allclose([g[3] for g in got], [t[3] for t in truth], rtol=0, atol=1e-11)


def test_few_and_no_vectors(spark):
    few = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (50, [0.0, 1.0], 0)]
    run = lambda rows: projection_forest.nearest(vector_frame(spark, rows), lambda i: i % 50 == 0)
    assert [tuple(r)[:3] for r in run(few).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert run([]).count() == run([(3, [1.0], 0)]).count() == run([(50, [1.0], 0)]).count() == 0


def test_forest_recall_on_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(150, 32))
    x = (centres[rng.integers(0, 150, 9000)] + 0.35 * rng.normal(size=(9000, 32))).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    unit = projection_forest.unit(x.astype(float))
    forest = projection_forest.Forest(unit)
    share = projection_forest.calibrated_share(forest, unit, 5)
    assert share < 0.5
    found = projection_forest.nearest(spark.createDataFrame(rows, VECTORS), lambda i: i % 50 == 0, sample=3000, region_rows=2000)
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    truth = {(i, j) for i, _, j, _ in brute_neighbours(rows, 5, 50)}
    assert len(got & truth) >= 0.9 * len(truth)


def test_queue_gives_leaves_by_their_bound():
    rng = np.random.default_rng(1)
    x = projection_forest.unit(rng.normal(size=(2000, 12)))
    forest = projection_forest.Forest(x, trees=3)
    places, q = forest.place(x), projection_forest.unit(rng.normal(size=(1, 12)))[0]
    order = list(forest.nearest_leaves(q))
    assert len(order) == len(set(order)) == 3 * forest.leaves
    bounds = []
    for t, leaf in order:
        bound, node = 0.0, 0
        for level in range(forest.depth):
            margin = q @ forest.directions[t][:, level] - forest.cuts[t][level][node]
            right = leaf >> (forest.depth - 1 - level) & 1
            bound += margin * margin * (right != (margin >= 0))
            node = 2 * node + right
        bounds.append(bound)
        own = x[places[t] == leaf]
        assert not len(own) or ((own - q) ** 2).sum(axis=1).min() >= bound - 1e-9
    assert bounds == sorted(bounds)


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    dim = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    whole = [[max(-cover_codes.LIMIT, min(cover_codes.LIMIT, int(np.floor(256 * float(x))))) for x in v] + [0] * (dim - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    w = dim // parts
    cut = lambda r, p: whole[r][p * w:(p + 1) * w]
    books = [[cut(r, p) for r in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(r, p), e)), n) for n, e in enumerate(books[p])) for p in range(parts)] for r in range(len(kept))]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            members = defaultdict(list)
            for r in range(len(kept)):
                members[found[r][p][1]].append(cut(r, p))
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, error):
        by_label[lab] += e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[lab], digest) for (i, _, lab), f, err in zip(kept, found, error)), key=repr)


@pytest.mark.parametrize("block", [37, 16_384])
def test_codes_match_plain_rounds(spark, odd_vectors, block):
    got = cover_codes.encode(vector_frame(spark, odd_vectors), parts=4, entries=11, rounds=2, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(odd_vectors, 4, 11, 2)


def test_codes_of_few_and_no_rows(spark):
    assert cover_codes.encode(vector_frame(spark, [])).count() == cover_codes.encode(vector_frame(spark, [(1, None, 1)])).count() == 0
    few = [(2, [0.5] * 16, 1), (1, [-0.5] * 16, None)]
    assert sorted(map(tuple, cover_codes.encode(vector_frame(spark, few)).collect()), key=repr) == brute_codes(few, 16, 64, 2)


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-90, 90, (700, 3)), np.tile([[5, 5, 5]], (300, 1))])
    tree = cover_codes.CoverTree(points)
    assert (np.sort(tree.order) == np.arange(1000)).all() and (points[tree.order] == tree.points).all()
    for n in range(len(tree.centre)):
        own = tree.points[tree.start[n]:tree.end[n]]
        assert (np.sqrt(((own - tree.centre[n]) ** 2).sum(axis=1)) <= tree.reach[n] + 1e-9).all()
        kids = range(tree.first[n], tree.first[n] + tree.kids[n])
        if kids:
            spans = sorted((tree.start[k], tree.end[k]) for k in kids)
            assert spans[0][0] == tree.start[n] and spans[-1][1] == tree.end[n] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    entries = rng.integers(-90, 90, (9, 3))
    entries[4] = entries[2]
    plain = ((tree.points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (tree.nearest(entries) == plain).all()
    sums, counts = tree.totals(plain, 9)
    assert (sums == np.array([tree.points[plain == e].sum(axis=0) for e in range(9)])).all() and (counts == np.bincount(plain, minlength=9)).all()


TALKS = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string")


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    lists = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], digest(*x[2:])))] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100
        new = tuple(lists.get(base, [])[:h] + turns[h:])
        for d in range(len(new) + 1):
            members[new[:d]].add(c)
        ends[new].append(c)
    leaves, saved, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1]) if key else 0
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()), key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 1, "user", None), (5, 1, "user", None), (5, 1, "user", "É🎉"), (6, 2, "a", "bc"), (6, 3, "ab", "c"),
            (-7, 0, "user", "hi"), (-100, 0, "user", "hi"), (-100, 1, "user", "ho"), (1 << 40, 3, "user", "far")]
    for c in range(0, 420):
        common = c % 3 == 0
        rows += [(c, t, "user" if t % 2 else "bot", f"t{t}" if common else f"t{rng.randrange(2)}") for t in range(rng.randrange(9) if not common else 7)]
    rows += [(900, t, "user", f"long {t}" * (t % 3)) for t in range(700)] + [(901, t, "user", f"long {t}" * (t % 3)) for t in range(650)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("limit", "held"), [(prefix_trie.LIMIT, prefix_trie.HELD), (40, 3), (9, 50)])
def test_trie_matches_plain_walk(spark, talks, limit, held):
    df = spark.createDataFrame(talks, TALKS).repartition(4)
    for name in ("conv", "pos", "node", "shard", "q", "digest"):
        df = df.withColumn(name, F.lit("x"))
    got = prefix_trie.prefix_trie(df, limit, held).select(*prefix_trie.RESULT)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(talks)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALKS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TALKS)).count() == 0


def test_queue_spills_and_keeps_order():
    rng, queue = random.Random(1), prefix_trie.SpillingQueue(held=7)
    items = [(rng.randrange(50), str(i)) for i in range(300)]
    for i in items[:200]:
        queue.push(i)
    first = [queue.pop() for _ in range(60)]
    assert first == sorted(items[:200])[:60]
    for i in items[200:]:
        queue.push(i)
    rest = []
    while queue.peek() is not None:
        rest.append(queue.pop())
    assert rest == sorted(sorted(items[:200])[60:] + items[200:]) and queue.files
