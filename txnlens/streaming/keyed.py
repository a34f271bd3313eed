"""Keyed state that starts from a batch table, keeps feature vectors, ignores repeated rows and judges lateness by arrival.

The same features as ``streaming.state``, on an operator that takes an initial state: an entity's totals, the entries of its last day and
its last vectors are computed in batch, and the stream goes on from there. A repeated id is recognised among the entries that are still
held; such a row, one that is too late, and one without a time or an amount leave the state as it is. With an arrival number from the
source a row is late or stale against the rows that arrived before it, so the verdict doesn't depend on how rows are dealt to triggers.
Entities share calls and state by bucket, as in ``streaming.state``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txnlens.functions import fixed
from txnlens.operators.windows import last_k
from txnlens.roles import DAY_S, MICROS, Roles
from txnlens.streaming.state import _EMPTY, BUCKETS, RING, Answers, bucket_of, bucketed, by_entity, features_of, held_as, ids_of

#: What a row that is still taken in may look back on.
REACH = (DAY_S + fixed.MAX_BACKDATE_S) * MICROS
_FEATURES = ("tx_count long, tx_sum double, mean_amount double, max_amount double, std_amount double, amount_zscore double, since_last double, "
             "tx_count_10min long, tx_count_1h long, tx_count_24h long, amt_24h_mean double")


def state_fields(id_type: str) -> str:
    return (f"n long, s double, q double, mx double, last long, hist_t array<long>, hist_x array<double>, hist_id array<{id_type}>, "
            "ring array<array<double>>")


def batch_state(df: DataFrame, roles: Roles = Roles(), vector: Sequence[str] = (), ring: int = RING) -> DataFrame:
    """The state of every entity at the end of a table, one row each; ``vector`` names the columns of a feature vector, the amount by default."""
    e, t, x = F.col(roles.entity), F.col(roles.ts), F.col(roles.amount).cast("double")
    rows = df.where(t.isNotNull() & x.isNotNull()).select(
        e.alias("entity"), F.col(roles.id).alias("id"), t.cast("long").alias("t"), x.alias("x"),
        F.array(*[F.col(c).cast("double") for c in vector or [roles.amount]]).alias("v"))
    totals = rows.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.max("x").alias("mx"), F.max("t").alias("last"))
    newest = totals.select(F.col("entity").alias("_e"), F.col("last").alias("_last"))
    entries = F.array_sort(F.collect_list(F.struct("t", "id", "x")))
    recent = rows.join(newest, F.col("entity").eqNullSafe(F.col("_e"))).where(F.col("t") >= F.col("_last") - REACH).groupBy("entity").agg(entries.alias("h"))
    vectors = F.array_sort(F.collect_list(F.struct("t", "id", "v")))
    tail = last_k(rows, ring, Roles(id="id", entity="entity", ts="t")).groupBy("entity").agg(vectors.alias("r"))
    other = lambda part, to: part.withColumnRenamed("entity", to)
    out = totals.join(other(recent, "_h"), F.col("entity").eqNullSafe(F.col("_h"))).join(other(tail, "_r"), F.col("entity").eqNullSafe(F.col("_r")))
    return out.select("entity", "n", "s", "q", "mx", "last", F.col("h.t").alias("hist_t"), F.col("h.x").alias("hist_x"),
                      F.col("h.id").alias("hist_id"), F.col("r.v").alias("ring"))


def _vector(v) -> list:
    return [None if x is None or x != x else float(x) for x in v]


class KeyedFeatures(StatefulProcessor):
    def __init__(self, entity: str, id_type: str, ring: int):
        self.entity, self.id_type, self.ring = entity, id_type, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", held_as(self.entity, state_fields(self.id_type)))

    def _states(self) -> dict[Any, tuple]:
        return {r[0]: tuple(r[1:]) for r in self.held.get()[0]} if self.held.exists() else {}

    def _keep(self, states: dict[Any, tuple]) -> None:
        self.held.update(([(e, *v) for e, v in states.items()],))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        states = self._states()
        for entity, r in zip(initialState["entity"].tolist(), initialState.to_dict("records")):
            states[None if pd.isna(entity) else entity] = (
                int(r["n"]), float(r["s"]), float(r["q"]), float(r["mx"]), int(r["last"]), [int(v) for v in r["hist_t"]],
                [float(v) for v in r["hist_x"]], np.asarray(r["hist_id"]).tolist(), [_vector(z) for z in r["ring"]])
        self._keep(states)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        states = self._states()
        pdf, groups = by_entity(pd.concat(list(rows), ignore_index=True), ["arrival", "no_t", "t", "no_id", "id"])
        ids, vectors = ids_of(pdf), pdf["v"].tolist()
        no_t, t, x = pdf["no_t"].to_numpy(bool), pdf["t"].to_numpy(np.int64), pdf["amount"].to_numpy(float)
        rank = np.empty(len(pdf), np.int64)
        rank[pdf.sort_values(["t", "no_id", "id"], kind="stable").index.to_numpy()] = np.arange(len(pdf))
        lacking = no_t | np.isnan(x)
        stale, late, duplicate = np.zeros((3, len(pdf)), bool)
        answers = Answers(len(pdf))
        for entity, start, end in groups:
            n, s, q, mx, last, hist_t, hist_x, hist_id, ring = states.get(entity, (*_EMPTY[:7], [], []))
            own = slice(start, end)
            seen = set(hist_id)
            for i in range(start, end):
                duplicate[i] = ids[i] in seen
                if ids[i] is not None:
                    seen.add(ids[i])
            counted = ~(lacking[own] | duplicate[own])
            # The newest time among the rows that arrived before.
            run = np.maximum.accumulate(np.concatenate(([last], np.where(counted, t[own], last))))[:-1]
            stale[own] = counted & (run >= 0) & (run - t[own] > fixed.MAX_BACKDATE_S * MICROS)
            late[own] = counted & (run >= 0) & (t[own] < run)
            at = start + np.flatnonzero(counted & ~stale[own])
            if not len(at):
                continue
            at = at[np.argsort(rank[at])]
            found, after = features_of(t[at], x[at], (n, s, q, mx, last, hist_t, hist_x))
            line = [*map(list, ring), *(_vector(vectors[i]) for i in at.tolist())]
            answers.put(at, found, [line[max(0, e - self.ring):e] for e in range(len(ring) + 1, len(line) + 1)])
            entries = sorted(zip([*hist_t, *t[at].tolist()], [*hist_id, *(ids[i] for i in at.tolist())]), key=lambda z: z[0])
            states[entity] = (*after, [i for since, i in entries if since >= after[4] - REACH], line[-self.ring:])
        self._keep(states)
        yield pd.DataFrame({
            "entity": pdf["entity"], "id": pd.Series(ids, dtype=object), "t": pd.arrays.IntegerArray(t, no_t.copy()), "amount": pdf["amount"],
            "stale": stale.astype(int), "out_of_order": late.astype(int), "duplicate": duplicate.astype(int), "lacking": lacking.astype(int),
            **answers.columns()})

    def close(self) -> None:
        pass


def keyed_features(stream: DataFrame, roles: Roles = Roles(), vector: Sequence[str] = (), seed: DataFrame | None = None,
                   arrival: str | None = None, ring: int = RING, buckets: int = BUCKETS) -> DataFrame:
    """Flags and features of every row; ``seq`` holds the last ``ring`` vectors up to the row. Needs the RocksDB state store.

    ``seed`` is a table of ``batch_state`` with the same ``vector``. Without ``arrival`` the rows of a trigger count as arrived in time order.
    """
    entity, id_type = (stream.schema[c].dataType.simpleString() for c in (roles.entity, roles.id))
    at = F.col(roles.ts).cast("long")
    narrow = bucketed(
        stream, roles, F.coalesce(at, F.lit(-1)).alias("t"), at.isNull().alias("no_t"), F.col(roles.amount).cast("double").alias("amount"),
        F.array(*[F.col(c).cast("double") for c in vector or [roles.amount]]).alias("v"),
        (F.col(arrival).cast("long") if arrival else F.lit(0).cast("long")).alias("arrival"), buckets=buckets)
    start = None if seed is None else seed.withColumn("entity", F.col("entity").cast(entity)).withColumn("bucket", bucket_of("entity", buckets))
    return narrow.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=KeyedFeatures(entity, id_type, ring),
        outputStructType=(f"entity {entity}, id {id_type}, t long, amount double, stale int, out_of_order int, duplicate int, lacking int, {_FEATURES}, "
                          "seq array<array<double>>, seq_len int"),
        outputMode="Append", timeMode="None", initialState=None if start is None else start.groupBy("bucket"))
