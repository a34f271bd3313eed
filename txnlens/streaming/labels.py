"""Target encoding of a stream whose labels come in a feed of their own.

Transactions and confirmed labels meet in one keyed operator. A transaction waits until the watermark has passed it, that is until
every label that was known by then has come in, in whatever order; then it reads the labels whose transactions are at least the lag
older. Labels wait in slices of time and are promoted into two ready counters as the answered time moves on, so the counters never run
ahead of a row that is still to be answered. The result is that of the batch encoding. Entities share calls, timers and state by bucket,
as in ``streaming.state``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txnlens.functions import fixed
from txnlens.roles import MICROS, Roles
from txnlens.streaming.state import BUCKETS, bucketed, ids_of

#: Time that is answered at once, and how finely waiting rows and labels are stored.
SLICE_S = 86_400
TTL_DAYS = 180
DELAY = "1 day"
_DAY_MS = 86_400_000


class Promotion(StatefulProcessor):
    """Per bucket of entities: ready counters, waiting labels by slice of their transaction time, waiting transactions by the time they are due."""

    def __init__(self, prior: float, lag_s: int, weight: float, slice_s: int, ttl_days: int, entity: str, id_type: str):
        self.prior, self.lag, self.weight = prior, lag_s * MICROS, weight
        self.slice, self.ttl_ms, self.entity, self.id_type = slice_s * MICROS, ttl_days * _DAY_MS, entity, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Labels of an entity's transactions up to ``upto`` are in its counters; its state goes at ``until``, ``next`` is the first of these times.
        self.ready = handle.getValueState(
            "ready", f"next long, held array<struct<entity: {self.entity}, n: long, y: long, upto: long, until: long>>")
        self.labels = handle.getMapState("labels", "slice long", f"entity array<{self.entity}>, t array<long>, y array<long>")
        self.asked = handle.getMapState("asked", "due long", f"entity array<{self.entity}>, id array<{self.id_type}>, t array<long>")

    def _counters(self) -> tuple[int, dict[Any, tuple[int, int, int, int]]]:
        if not self.ready.exists():
            return -1, {}
        first, held = self.ready.get()
        return first, {r[0]: tuple(r[1:]) for r in held}

    def _keep(self, first: int, held: dict[Any, tuple[int, int, int, int]]) -> None:
        """Stores the counters, with a timer for the entity that goes next."""
        until = min((h[3] for h in held.values()), default=-1)
        if until != first:
            if first >= 0:
                self.handle.deleteTimer(first)
            if until >= 0:
                self.handle.registerTimer(until)
        if held:
            self.ready.update((until, [(e, *h) for e, h in held.items()]))
        else:
            self.ready.clear()

    def _append(self, state, at: int, columns: list[list]) -> None:
        held = state.getValue((at,)) if state.containsKey((at,)) else [[] for _ in columns]
        state.updateValue((at,), tuple(list(old) + new for old, new in zip(held, columns)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, held = self._counters()
        now = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            names = [None if pd.isna(e) else e for e in batch["entity"].tolist()]
            newest: dict[Any, int] = {}
            for e, at in zip(names, batch["at_ms"].tolist()):
                newest[e] = max(newest.get(e, now), at)
            for e, at in newest.items():
                n, y, upto, until = held.get(e, (0, 0, -(1 << 62), -1))
                # Moved at most once a day, so that a busy entity doesn't set a timer with every row.
                held[e] = (n, y, upto, at + self.ttl_ms if at + self.ttl_ms >= until + _DAY_MS else until)
            labels: dict[int, list[list]] = {}
            asked: dict[int, list[list]] = {}
            for e, kind, i, t, y_own in zip(names, batch["kind"].tolist(), ids_of(batch), batch["t"].tolist(), batch["y"].tolist()):
                at = t // self.slice
                if kind == 0:
                    # Rows in front of the watermark only reach this; their slice may be over already.
                    to, row = asked.setdefault(max(self._end_ms(at), now + 1), [[], [], []]), (e, i, t)
                else:
                    n, y, upto, until = held[e]
                    if t <= upto:
                        held[e] = (n + 1, y + y_own, upto, until)
                        continue
                    to, row = labels.setdefault(at, [[], [], []]), (e, t, y_own)
                for column, v in zip(to, row):
                    column.append(v)
            for at, columns in labels.items():
                self._append(self.labels, at, columns)
            for due, columns in asked.items():
                self._append(self.asked, due, columns)
                self.handle.registerTimer(due)
        self._keep(first, held)
        return iter(())

    def _end_ms(self, at: int) -> int:
        return -(-(at + 1) * self.slice // 1000)

    def _waiting(self, last: int | None) -> dict[int, tuple]:
        """The slices of labels that begin by ``last``, all without it."""
        return {k[0]: self.labels.getValue(k) for k in list(self.labels.keys()) if last is None or k[0] * self.slice <= last}

    def _put(self, waiting: dict[int, tuple], entity: list, t: np.ndarray, y: np.ndarray, left: np.ndarray) -> None:
        """Stores what is ``left`` of the slices, whose columns are given end to end."""
        start = 0
        for at, (own, *_) in waiting.items():
            end = start + len(own)
            rest = (start + np.flatnonzero(left[start:end])).tolist()
            if not rest:
                self.labels.removeKey((at,))
            elif len(rest) < end - start:
                self.labels.updateValue((at,), ([entity[i] for i in rest], t[rest].tolist(), y[rest].tolist()))
            start = end

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        first, held = self._counters()
        dues = sorted(k[0] for k in list(self.asked.keys()))
        over = [due for due in dues if due <= fired]
        out = []
        if over:
            names, ids, times = [], [], []
            for due in over:
                for to, column in zip((names, ids, times), self.asked.getValue((due,))):
                    to += list(column)
                self.asked.removeKey((due,))
            place = {e: c for c, e in enumerate(dict.fromkeys(names))}
            code, t = np.array([place[e] for e in names], np.int64), np.array(times, np.int64)
            last = np.full(len(place), -(1 << 62))
            np.maximum.at(last, code, t - self.lag)
            waiting = self._waiting(int(last.max()))
            label_e, label_t, label_y = ([v for h in waiting.values() for v in h[i]] for i in range(3))
            label_t, label_y = np.array(label_t, np.int64), np.array(label_y, np.int64)
            label_code = np.array([place.get(e, -1) for e in label_e], np.int64)
            own = np.flatnonzero(label_code >= 0)
            # Labels and questions of an entity in one order of time, labels first; what stands before a question is ready for it.
            every = np.concatenate((label_code[own], code))
            order = np.lexsort((np.repeat([0, 1], [len(own), len(code)]), np.concatenate((label_t[own], t - self.lag)), every))
            at = np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            starts = np.concatenate(([0], np.cumsum(np.bincount(every, minlength=len(place)))[:-1]))
            counters = np.array([held.get(e, (0, 0, -(1 << 62), -1))[:3] for e in place], np.int64)

            def before(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate(([0], np.cumsum(np.concatenate((values, np.zeros(len(code), np.int64)))[order])))
                return sums[at[len(own):]] - sums[starts[code]]

            ready = counters[code, 0] + before(np.ones(len(own), np.int64))
            hits = counters[code, 1] + before(label_y[own])
            out.append(pd.DataFrame({
                "entity": pd.Series(names, dtype=object), "id": pd.Series(ids, dtype=object), "ready": ready,
                "target_enc": (hits + self.weight * self.prior) / (ready + self.weight)}))
            # What later rows can't but see is promoted; the rest of the last slices waits on.
            done = np.zeros(len(label_t), bool)
            done[own] = label_t[own] <= last[label_code[own]]
            some = label_code[done]
            more = np.bincount(some, minlength=len(place)), np.bincount(some, label_y[done], len(place)).astype(np.int64)
            for e, c in place.items():
                if e in held:
                    held[e] = (int(counters[c, 0] + more[0][c]), int(counters[c, 1] + more[1][c]), int(max(counters[c, 2], last[c])), held[e][3])
            self._put(waiting, label_e, label_t, label_y, ~done)
        # Timers set here may fire a trigger later, so the last one in front of the watermark drops all entities that are due by then.
        now = fired if any(fired < due <= timerValues.getCurrentWatermarkInMs() for due in dues) else max(fired, timerValues.getCurrentWatermarkInMs())
        gone = {e for e, h in held.items() if h[3] <= now}
        if gone:
            waiting = self._waiting(None)
            label_e, label_t, label_y = ([v for h in waiting.values() for v in h[i]] for i in range(3))
            self._put(waiting, label_e, np.array(label_t, np.int64), np.array(label_y, np.int64), np.array([e not in gone for e in label_e], bool))
        # The timer that fired is gone by itself.
        self._keep(-1 if first == fired else first, {e: h for e, h in held.items() if e not in gone})
        return iter(out)

    def close(self) -> None:
        pass


def promoted_label_encoding(
    transactions: DataFrame, labels: DataFrame, prior: float, lag_s: int, roles: Roles = Roles(), known: str = "known",
    delay: str = DELAY, weight: float = fixed.TARGET_PRIOR_WEIGHT, slice_s: int = SLICE_S, ttl_days: int = TTL_DAYS, buckets: int = BUCKETS,
) -> DataFrame:
    """``(entity, id, ready, target_enc)`` of every transaction, labels taken from the feed ``labels(entity, id, ts, label, known)``.

    ``ts`` of a label is the time of its transaction and ``known`` the time at which it was confirmed; both in microseconds. Each input has
    its own watermark, and the slower one counts. A label repeated within ``delay`` is taken once, a null one never. Rows that come in
    behind the watermark are dropped by it. Entities without rows for ``ttl_days`` are forgotten. Needs the RocksDB state store.
    """
    kinds = transactions.schema
    entity, id_type = (kinds[c].dataType.simpleString() for c in (roles.entity, roles.id))
    stamped = lambda df, at: df.withColumn("at", F.timestamp_micros(F.col(at).cast("long"))).withWatermark("at", delay)
    asking = stamped(transactions, roles.ts).select(
        F.col(roles.entity).alias("entity"), F.lit(0).alias("kind"), F.col(roles.id).alias("id"), F.col(roles.ts).cast("long").alias("t"),
        F.lit(0).cast("long").alias("y"), "at")
    feed = stamped(labels.where(F.col(roles.label).isNotNull()), known).dropDuplicatesWithinWatermark([roles.id]).select(
        F.col(roles.entity).cast(entity).alias("entity"), F.lit(1).alias("kind"), F.col(roles.id).cast(id_type).alias("id"),
        F.col(roles.ts).cast("long").alias("t"), F.col(roles.label).cast("long").alias("y"), "at")
    both = bucketed(asking.unionByName(feed).where("t IS NOT NULL"), Roles(id="id", entity="entity"), F.col("kind"), F.col("t"), F.col("y"), F.col("at"),
                    F.coalesce(F.unix_millis("at"), F.lit(-1)).alias("at_ms"), buckets=buckets)
    return both.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Promotion(prior, lag_s, weight, slice_s, ttl_days, entity, id_type),
        outputStructType=f"entity {entity}, id {id_type}, ready long, target_enc double", outputMode="Append", timeMode="EventTime")
