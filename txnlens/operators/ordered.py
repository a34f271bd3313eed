"""Ordered computation over groups of any size.

Window functions put a whole group into one task, which fails when one entity, category or score
column holds a large part of the table. The functions here give the same answers with every task
bounded: the order key is cut into chunks at approximate quantiles of the whole table, so a
(group, chunk) pair never holds more than one chunk of rows, and each chunk is started from a
carry computed out of per-chunk subtotals (small) or the few rows right before it.

Sizes are checked first. Tables below ``ROWS_PER_CHUNK`` rows take the plain window form, and so do
the groups below that size in larger tables; only the hot groups are cut.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens import session
from txnlens.session import cut_lineage, rows_at_most

INF = float("inf")
# Places for the parts of one range in a chunk number.
PART_SPACE = 1 << 20
# Quantiles that are looked up at once; with more chunks than that, ranges between them are cut evenly.
QUANTILES = 8192
# Sampled rows for each part of a tied value, when its ties aren't numbers.
TIE_SAMPLE = 50
Measures = dict[str, tuple[str, Column]]
_FOLD = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


# By tied value: lowest and highest numeric tie, or the bounds of its parts, and the number of parts.
Ties = dict[float, tuple[float, float, int] | tuple[None, list, int]]


class ChunkPlan:
    """Boundaries that cut an ascending order key into chunks of similar row counts.

    ``scope`` says which groups are cut: none (``plain``), those above the size limit (``hot``), or ``all``.
    A plan may be passed on to further calls over the same rows, so that the sizes are looked up once.
    """

    def __init__(self, splits: list[float], ties: Ties, scope: str = "all"):
        self.splits = [-INF, *splits, INF]
        self.ties = ties
        self.scope = scope

    @property
    def plain(self) -> bool:
        return self.scope == "plain"

    def parts(self, bucket: Column) -> Column:
        """The part numbers of a bucket: 0, or several for a tied value."""
        out = F.array(F.lit(0).cast("long"))
        for v, (_, _, n) in self.ties.items():
            at = bisect.bisect_right(self.splits, v) - 1
            out = F.when(bucket == at, F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).otherwise(out)
        return out

    def copies(self, reach: int) -> float:
        """How often a row is repeated when every chunk also gets the rows up to ``reach`` before its start."""
        inner = self.splits[1:-1]
        weight = {bisect.bisect_right(self.splits, v) - 1: n for v, (_, _, n) in self.ties.items()}
        load = [0.0]
        for b in range(1, len(self.splits) - 1):
            load.append(load[-1] + weight.get(b, 1))
        total = 0.0
        for b in range(len(inner)):
            total += load[bisect.bisect_right(inner, inner[b] + reach)] - load[b]
        return total / max(len(inner), 1)

    def for_all(self) -> ChunkPlan:
        out = ChunkPlan([], self.ties)
        out.splits = self.splits
        return out

    def assign(self, df: DataFrame, value: Column, tie: Column | None) -> DataFrame:
        """Add ``_chunk``; it never decreases along (value, tie)."""
        if len(self.splits) < 3:
            return df.withColumn("_chunk", F.lit(0).cast("long"))
        keyed = df.withColumn("_v", F.coalesce(value.cast("double"), F.lit(-INF)))
        out = Bucketizer(splits=self.splits, inputCol="_v", outputCol="_b", handleInvalid="keep").transform(keyed)
        sub = F.lit(0).cast("long")
        if tie is not None:
            for v, (low, high, parts) in self.ties.items():
                if low is None:
                    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, high)), lambda b: b <= tie)), F.lit(0)).cast("long")
                else:
                    share = (tie.cast("double") - F.lit(low)) / F.lit(max(high - low, 1.0))
                    part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * parts), F.lit(parts - 1))
                sub = F.when(F.col("_v") == F.lit(v), part).otherwise(sub)
        return out.withColumn("_chunk", F.col("_b").cast("long") * PART_SPACE + sub).drop("_v", "_b")


Chunks = int | ChunkPlan | None


def plan_chunks(df: DataFrame, value: str, tie: str | None = None, chunks: Chunks = None) -> ChunkPlan:
    """Choose chunk boundaries from the size of the table, or for a given number of chunks.

    A value that alone fills several chunks is cut further along ``tie``: evenly if that is numeric, else at bounds from a sample.
    """
    if isinstance(chunks, ChunkPlan):
        return chunks
    narrow = df.select(F.col(value).cast("double").alias("_v"))
    scope = "all" if chunks else "hot"
    if chunks is None:
        small, n = rows_at_most(narrow, session.ROWS_PER_CHUNK)
        if small:
            return ChunkPlan([], {}, "plain")
        chunks = max(2, -(-n // (session.ROWS_PER_CHUNK // 2)))
    coarse = min(chunks, QUANTILES)
    quantiles = narrow.approxQuantile("_v", [i / coarse for i in range(1, coarse)], 1 / (4 * coarse))
    within = -(-chunks // coarse)
    ties: Ties = {}
    if tie is not None:
        least = max(2, coarse // 64)
        counted = Counter(quantiles)
        hot = {v: (c + 1) * within for v, c in counted.items() if c >= least}
        if hot and isinstance(df.schema[tie].dataType, T.NumericType):
            spans = (
                df.where(F.col(value).cast("double").isin(list(hot)))
                .groupBy(F.col(value).cast("double").alias("_v"))
                .agg(F.min(F.col(tie).cast("double")).alias("lo"), F.max(F.col(tie).cast("double")).alias("hi"))
            )
            ties = {r["_v"]: (r["lo"], r["hi"], hot[r["_v"]]) for r in spans.collect()}
        elif hot:
            ties = _sampled_ties(df.select(F.col(value).cast("double").alias("_v"), F.col(tie).alias("_tie")), hot)
    # Ranges between neighbouring quantiles are cut evenly when there are more chunks than quantiles.
    inner = []
    if within > 1:
        ends = narrow.agg(F.min("_v"), F.max("_v")).first()
        points = sorted({*quantiles, *(e for e in ends if e is not None and math.isfinite(e))})
        inner = [a + (b - a) * k / within for a, b in zip(points, points[1:]) for k in range(1, within)]
    # A split right after a tied value keeps larger values out of its parts.
    after = {math.nextafter(v, INF) for v in ties}
    return ChunkPlan(sorted({*quantiles, *inner, *after}), ties, scope)


def _sampled_ties(rows: DataFrame, hot: dict[float, int]) -> Ties:
    """Bounds of the parts of each tied value ``_v`` along ``_tie``; the sample is a fixed number of rows a part."""
    tied = rows.where(F.col("_v").isin(list(hot)) & F.col("_tie").isNotNull())
    share = min(1.0, TIE_SAMPLE * sum(hot.values()) / max(tied.count(), 1))
    seen: dict[float, list] = {v: [] for v in hot}
    for r in tied.sample(share, seed=11).collect():
        seen[r["_v"]].append(r["_tie"])
    out: Ties = {}
    for v, parts in hot.items():
        own = sorted(seen[v])
        bounds = sorted({own[len(own) * i // parts] for i in range(1, parts)}) if own else []
        out[v] = (None, bounds, len(bounds) + 1)
    return {v: t for v, t in out.items() if t[2] > 1}


def by_heat(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[DataFrame, ChunkPlan], DataFrame],
    chunks: Chunks = None,
) -> DataFrame:
    """Apply ``run`` with the plain form to ordinary groups and with the chunked form to hot ones.

    One count per key finds the groups above ``ROWS_PER_CHUNK`` rows; rows are told apart by a join with them.
    Both forms read the rows from one table, so that several keys in a row don't multiply the plan.
    """
    plan = plan_chunks(df, order[0], order[1] if len(order) > 1 else None, chunks)
    if plan.scope != "hot":
        return run(df, plan)
    if not keys:
        return run(df, plan.for_all())
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > session.ROWS_PER_CHUNK)
    if not sizes.head(1):
        return run(df, ChunkPlan([], {}, "plain"))
    rows = cut_lineage(df)
    hot = cut_lineage(sizes.select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)]))
    same = reduce(Column.__and__, [rows[k].eqNullSafe(hot[f"_hot{i}"]) for i, k in enumerate(keys)])
    cold, warm = (rows.join(hot, same, kind).select(*df.columns) for kind in ("left_anti", "left_semi"))
    return run(cold, ChunkPlan([], {}, "plain")).unionByName(run(warm, plan.for_all()))


def _key(keys: Sequence[str]) -> Column:
    # A struct key keeps nulls as a group of their own and still co-partitions joins and windows.
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def _measured(df: DataFrame, measures: Measures) -> DataFrame:
    return df.withColumns({f"_m_{n}": (F.lit(1).cast("long") if k == "count" else e) for n, (k, e) in measures.items()})


def _finish(name: str, kind: str, folded: Column) -> Column:
    return F.coalesce(folded, F.lit(0).cast("long")) if kind == "count" else folded


def prior(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Measures, chunks: Chunks = None
) -> DataFrame:
    """Aggregates over the strictly earlier rows of the same key.

    ``order`` is ascending and total; its first column is numeric. ``measures`` maps an output name to
    ``(sum|count|max|min, expression)``.
    """
    return by_heat(df, keys, order, lambda d, plan: _prior(d, keys, order, measures, plan), chunks)


def _prior(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Measures, plan: ChunkPlan) -> DataFrame:
    tie = order[1] if len(order) > 1 else None
    if plan.plain:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({
            n: (F.count(F.lit(1)) if k == "count" else _FOLD[k](e)).over(w) for n, (k, e) in measures.items()
        })
    base = plan.assign(_measured(df, measures), F.col(order[0]), F.col(tie) if tie else None)
    base = base.withColumn("_key", _key(keys)).withColumn("_kind", F.lit(1))
    rows = base.unionByName(_carry(base, measures), allowMissingColumns=True)
    w = Window.partitionBy("_key", "_chunk").orderBy("_kind", *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({n: _finish(n, k, _FOLD[k](F.col(f"_m_{n}")).over(w)) for n, (k, _) in measures.items()})
    return out.where("_kind = 1").select(*df.columns, *measures)


def _carry(base: DataFrame, measures: Measures) -> DataFrame:
    """One row per (key, chunk) holding the totals of all earlier chunks of that key."""
    sub = base.groupBy("_key", "_chunk").agg(*[_FOLD[k](f"_m_{n}").alias(f"_m_{n}") for n, (k, _) in measures.items()])
    w = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sub.select(
        "_key", "_chunk", F.lit(0).alias("_kind"),
        *[_FOLD[k](f"_m_{n}").over(w).alias(f"_m_{n}") for n, (k, _) in measures.items()],
    )


def before(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, measures: Measures, offsets: dict[str, int],
    chunks: Chunks = None,
) -> DataFrame:
    """Sums over the key's rows with ``ts < row.ts - offset``, one column ``{measure}_{offset}`` each.

    In the chunked form a chunk either receives the rows within reach before its start (few when chunks are
    longer than the largest offset), or, when that would copy rows more often than there are offsets, each
    row sends a probe to the chunk that holds ``ts - offset``. ``tie`` must be unique.
    """
    return by_heat(df, keys, [ts, tie], lambda d, plan: _before(d, keys, ts, tie, measures, offsets, plan), chunks)


def _before(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, measures: Measures, offsets: dict[str, int], plan: ChunkPlan,
) -> DataFrame:
    names = {(m, o): f"{m}_{o}" for m in measures for o in offsets}
    if plan.plain:
        out = {}
        for (m, o), name in names.items():
            kind, expr = measures[m]
            w = Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, -offsets[o] - 1)
            out[name] = F.count(F.lit(1)).over(w) if kind == "count" else F.coalesce(_FOLD[kind](expr).over(w), F.lit(0))
        return df.withColumns(out)
    additive = all(kind in ("sum", "count") for kind, _ in measures.values())
    if additive and plan.copies(max(offsets.values()) + 1) <= len(offsets):
        return _before_by_halo(df, keys, ts, tie, measures, offsets, plan)
    return _before_by_probe(df, keys, ts, tie, measures, offsets, plan)


_LONG_AGO = -(1 << 62)


def _before_by_halo(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, measures: Measures, offsets: dict[str, int], plan: ChunkPlan,
) -> DataFrame:
    """One shuffle: a chunk's rows, copies of the rows within reach before it, and totals of all older rows.

    The totals are those of the earlier buckets less the copied rows, put at a time before everything.
    """
    reach = max(offsets.values()) + 1
    folded = [f"_m_{m}" for m in measures]
    own = plan.assign(_measured(df, measures).withColumn("_key", _key(keys)), F.col(ts), F.col(tie))
    own = own.withColumns({"_bucket": F.floor(F.col("_chunk") / PART_SPACE), "_at": F.col(ts), "_kind": F.lit(1)})
    narrow = own.select("_key", "_at", "_bucket", *folded)
    ahead = plan.assign(narrow, F.col("_at") + reach, None).withColumn("_last", F.floor(F.col("_chunk") / PART_SPACE))
    ahead = ahead.where("_last > _bucket").withColumn("_bucket", F.explode(F.sequence(F.col("_bucket") + 1, F.col("_last"))))

    def placed(rows: DataFrame) -> DataFrame:
        part = rows.withColumn("_part", F.explode(plan.parts(F.col("_bucket"))))
        return part.withColumn("_chunk", F.col("_bucket") * PART_SPACE + F.col("_part")).withColumn("_kind", F.lit(0))

    halo = placed(ahead.select("_key", "_at", "_bucket", *folded))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = narrow.groupBy("_key", "_bucket").agg(*[F.sum(m).alias(m) for m in folded])
    carry = placed(totals.select("_key", "_bucket", *[F.sum(m).over(earlier).alias(m) for m in folded]))
    copied = halo.groupBy("_key", "_chunk").agg(*[(-F.sum(m)).alias(m) for m in folded]).withColumn("_kind", F.lit(0))
    rows = own
    for extra in (halo, *(x.withColumn("_at", F.lit(_LONG_AGO)) for x in (carry, copied))):
        rows = rows.unionByName(extra.select("_key", "_chunk", "_at", "_kind", *folded), allowMissingColumns=True)
    out = {}
    for m in measures:
        for o, micros in offsets.items():
            w = Window.partitionBy("_key", "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, -micros - 1)
            out[f"{m}_{o}"] = F.coalesce(F.sum(f"_m_{m}").over(w), F.lit(0))
    return rows.withColumns(out).where("_kind = 1").select(*df.columns, *out)


def _before_by_probe(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, measures: Measures, offsets: dict[str, int], plan: ChunkPlan,
) -> DataFrame:
    """Probes join the rows of the chunk they ask; the answers are brought back by ``tie``."""
    names = {(m, o): f"{m}_{o}" for m in measures for o in offsets}
    narrow = (
        _measured(df, measures)
        .withColumn("_key", _key(keys))
        .select("_key", F.col(tie).alias("_id"), F.col(ts).alias("_at"), *[f"_m_{m}" for m in measures])
    )
    data = narrow.select(
        "*", F.explode(F.array(F.lit("").alias("p"), *[F.lit(o) for o in offsets])).alias("_probe")
    )
    shift = F.lit(0)
    for o, micros in offsets.items():
        shift = F.when(F.col("_probe") == o, F.lit(micros)).otherwise(shift)
    is_row = F.col("_probe") == ""
    data = data.withColumn("_at", F.col("_at") - shift).withColumn("_kind", F.when(is_row, 2).otherwise(1))
    data = data.withColumns({f"_m_{m}": F.when(is_row, F.col(f"_m_{m}")) for m in measures})
    # A probe must meet all rows at its own time, so it goes to the first part of a tied value.
    data = plan.assign(data, F.col("_at"), F.when(is_row, F.col("_id")))
    rows = data.unionByName(_carry(data, measures), allowMissingColumns=True)
    w = Window.partitionBy("_key", "_chunk").orderBy(
        F.when(F.col("_kind") == 0, 0).otherwise(1), "_at", "_kind", "_id"
    ).rowsBetween(Window.unboundedPreceding, -1)
    answered = rows.withColumns({f"_r_{m}": _FOLD[k](F.col(f"_m_{m}")).over(w) for m, (k, _) in measures.items()})
    answers = (
        answered.where("_kind = 1")
        .groupBy(F.col("_id").alias(tie))
        .agg(*[F.coalesce(F.max(F.when(F.col("_probe") == o, F.col(f"_r_{m}"))), F.lit(0)).alias(n)
               for (m, o), n in names.items()])
    )
    return df.join(answers, tie, "left").select(*df.columns, *names.values())


def history(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, n: int, out: str,
    include_current: bool = True, chunks: Chunks = None,
) -> DataFrame:
    """Array of ``item`` over the last ``n`` rows of the key, oldest first (current row included or not)."""
    frame = (-(n - 1), 0) if include_current else (-n, -1)
    return by_heat(df, keys, order, lambda d, plan: _history(d, keys, order, item, n, out, frame, plan), chunks)


def _history(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, n: int, out: str, frame: tuple[int, int],
    plan: ChunkPlan,
) -> DataFrame:
    tie = order[1] if len(order) > 1 else None
    if plan.plain:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return df.withColumn(out, F.collect_list(item).over(w))
    base = plan.assign(df.withColumn("_item", item), F.col(order[0]), F.col(tie) if tie else None)
    base = base.withColumn("_key", _key(keys)).withColumn("_kind", F.lit(1))
    newest = Window.partitionBy("_key", "_chunk").orderBy(*[F.desc(c) for c in order])
    tails = (
        base.select("_key", "_chunk", *order, "_item", F.row_number().over(newest).alias("_rn"))
        .where(F.col("_rn") <= n)
        .groupBy("_key", "_chunk")
        .agg(F.array_sort(F.collect_list(F.struct(*order, "_item"))).alias("_tail"))
    )
    earlier = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(-n, -1)
    halo = (
        tails.select("_key", "_chunk", F.flatten(F.collect_list("_tail").over(earlier)).alias("_rows"))
        .select("_key", "_chunk", F.explode(F.slice("_rows", F.greatest(F.size("_rows") - n + 1, F.lit(1)), n)).alias("_r"))
        .select("_key", "_chunk", F.lit(0).alias("_kind"), *[F.col(f"_r.{c}").alias(c) for c in order],
                F.col("_r._item").alias("_item"))
    )
    rows = base.unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy("_key", "_chunk").orderBy("_kind", *order).rowsBetween(*frame)
    return rows.withColumn(out, F.collect_list("_item").over(w)).where("_kind = 1").select(*df.columns, out)


def global_rank(df: DataFrame, order: Sequence[str], out: str = "rank", chunks: Chunks = None) -> DataFrame:
    """Zero-based position of every row in the total order."""
    return prior(df, [], order, {out: ("count", F.lit(1))}, chunks)


def rows_at(df: DataFrame, order: Sequence[str], positions: Sequence[int], chunks: Chunks = None) -> list[Row]:
    """The rows at the given positions of the total order, None past the end, found without ranking the table.

    Chunk sizes tell which chunks hold the positions; only those are sorted. The driver sees one row per
    chunk and one per position.
    """
    narrow = df.select(*order)
    tie = order[1] if len(order) > 1 else None
    plan = plan_chunks(narrow, order[0], tie, chunks)
    if plan.plain:
        ranked = narrow.withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)
        found = {r["_rank"]: r for r in ranked.where(F.col("_rank").isin(list(positions))).collect()}
        return [found.get(p) for p in positions]
    cut = plan.assign(narrow, F.col(order[0]), F.col(tie) if tie else None)
    start, starts = 0, {}
    for r in cut.groupBy("_chunk").count().orderBy("_chunk").collect():
        for p in positions:
            if start <= p < start + r["count"]:
                starts[r["_chunk"]] = start
        start += r["count"]
    inside = cut.where(F.col("_chunk").isin(list(starts)))
    ranked = inside.withColumn("_rank", F.row_number().over(Window.partitionBy("_chunk").orderBy(*order)) - 1)
    wanted = F.lit(False)
    for chunk, first in starts.items():
        here = [p - first for p in positions if p >= first]
        wanted = wanted | ((F.col("_chunk") == chunk) & F.col("_rank").isin(here))
    found = {r["_rank"] + starts[r["_chunk"]]: r for r in ranked.where(wanted).collect()} if starts else {}
    return [found.get(p) for p in positions]
