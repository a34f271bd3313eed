"""Keyed state: the batch per-entity features computed row by row as data arrives.

Entities are dealt to buckets by a hash, and each trigger hands a bucket's new rows to one function, which sorts them by (entity, time,
id), answers every row from the stored state of its entity plus the rows before it, and stores the new states: calls, data frames and
reads of the state cost more than the rows of an ordinary entity do. The work on an entity is vectorised; its state holds the
running sums, the entries that a row may still ask for (24 hours before the latest row taken in) and the last feature vectors. A trigger
rewrites the states of the buckets it has rows of. Bound the rows per trigger at the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txnlens.functions import fixed
from txnlens.roles import MICROS, Roles

_DAY = 86_400 * MICROS
RING = 10
TTL_DAYS = 180
#: Buckets of entities. State is kept by bucket, so the number is fixed for the life of a query's offsets folder.
BUCKETS = 1_024

#: Of one entity; ``gone`` is the time in ms at which it may be dropped.
STATE = ("n long, s double, q double, mx double, last long, hist_t array<long>, hist_x array<double>, "
         "ring array<double>, gone long")
OUTPUT = ("entity long, id long, t long, amount double, stale int, out_of_order int, tx_count long, tx_sum double, "
          "mean_amount double, max_amount double, std_amount double, amount_zscore double, since_last double, "
          "tx_count_10min long, tx_count_1h long, tx_count_24h long, amt_24h_mean double, seq array<double>, seq_len int")
_EMPTY = (0, 0.0, 0.0, float("-inf"), -1, [], [], [])
_WHOLE = ("byte", "short", "integer", "long")


def bucket_of(entity: str, buckets: int) -> Column:
    """Rows without an entity have a bucket of their own."""
    return F.when(F.col(entity).isNull(), -1).otherwise(F.pmod(F.xxhash64(entity), F.lit(buckets))).cast("int")


def bucketed(stream: DataFrame, roles: Roles, *columns: Column, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, entity, id, no_id, …)``; whole ids are never null, as one null would turn those of a bucket into floats, ``no_id`` marks them."""
    ident = F.col(roles.id)
    kind = stream.schema[roles.id].dataType
    filled = F.coalesce(ident, F.lit(0).cast(kind)) if kind.typeName() in _WHOLE else ident
    return stream.select(bucket_of(roles.entity, buckets).alias("bucket"), F.col(roles.entity).alias("entity"), filled.alias("id"), ident.isNull().alias("no_id"), *columns)


def by_entity(pdf: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, list[tuple[Any, int, int]]]:
    """The rows sorted by entity and ``order``, and the entities with the places of their rows; a missing entity is None."""
    code, names = pd.factorize(pdf["entity"], use_na_sentinel=False)
    pdf = pdf.assign(_code=code).sort_values(["_code", *order], kind="stable").reset_index(drop=True)
    names = [None if pd.isna(v) else v for v in names.tolist()]
    ends = np.cumsum(np.bincount(code, minlength=len(names))).tolist()
    return pdf, list(zip(names, [0, *ends[:-1]], ends))


def ids_of(pdf: pd.DataFrame) -> list:
    return [None if no else i for i, no in zip(pdf["id"].tolist(), pdf["no_id"].tolist())]


class Answers:
    """Feature columns of ``size`` rows, empty where nothing is put."""

    def __init__(self, size: int):
        self.values = {c: np.zeros(size, np.int64 if c in _INTS else float) for c in _FEATURES}
        self.seq: list = [None] * size
        self.given = np.zeros(size, bool)

    def put(self, at: np.ndarray, features: dict[str, np.ndarray], seqs: list) -> None:
        for c, v in features.items():
            self.values[c][at] = v
        for i, v in zip(at.tolist(), seqs):
            self.seq[i] = v
        self.given[at] = True

    def columns(self) -> dict[str, Any]:
        missing = ~self.given
        out = {c: pd.arrays.IntegerArray(v, missing.copy()) if c in _INTS else np.where(missing, np.nan, v) for c, v in self.values.items()}
        lengths = np.array([0 if v is None else len(v) for v in self.seq], np.int64)
        return out | {"seq": pd.Series(self.seq, dtype=object), "seq_len": pd.arrays.IntegerArray(lengths, missing.copy())}


def rings(run: list, had: int) -> list[list]:
    """The last entries up to each one of ``run`` after the first ``had``."""
    return [run[max(0, e - RING):e] for e in range(had + 1, len(run) + 1)]


def features_of(t: np.ndarray, x: np.ndarray, state: tuple) -> tuple[dict[str, np.ndarray], tuple]:
    """Features of an entity's rows sorted by time given the state ``(n, s, q, mx, last, hist_t, hist_x)`` before them, and that after them."""
    n, s, q, mx, last, hist_t, hist_x = state
    m = len(t)
    before = lambda v, start: start + np.concatenate(([0.0], np.cumsum(v)[:-1]))
    count = n + np.arange(m)
    total, squares = before(x, s), before(x * x, q)
    top = np.maximum.accumulate(np.concatenate(([mx], x)))[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(count > 0, total / np.maximum(count, 1), 0.0)
        var = np.where(count > 1, (squares - total * total / np.maximum(count, 1)) / np.maximum(count - 1, 1), 0.0)
    std = np.sqrt(np.maximum(var, 0.0))
    newest = np.maximum.accumulate(np.concatenate(([last], t)))
    gap = np.where(newest[:-1] >= 0, (t - newest[:-1]) / float(MICROS), -1.0)
    # Trailing windows look at entries in time order; a late row stands at its own time for rows after it.
    old_t, old_x = np.asarray(hist_t, np.int64), np.asarray(hist_x, float)
    seen_t, seen_x = np.concatenate((old_t, t)), np.concatenate((old_x, x))
    place = np.argsort(seen_t, kind="stable")
    seen_t, seen_x = seen_t[place], seen_x[place]
    own = np.empty(len(place), np.int64)
    own[place] = np.arange(len(place))
    at = own[len(old_t):]
    prefix = np.concatenate(([0.0], np.cumsum(seen_x)))
    spans = {k: np.searchsorted(seen_t, t - v * MICROS, side="left") for k, v in fixed.TRAILING_SPANS_S.items()}
    in_day = at - spans["24h"]
    day_mean = np.where(in_day > 0, (prefix[at] - prefix[spans["24h"]]) / np.maximum(in_day, 1), 0.0)
    out = {
        "tx_count": count, "tx_sum": total, "mean_amount": mean,
        "max_amount": np.where(count > 0, top, 0.0), "std_amount": std,
        "amount_zscore": np.where(std > 0, (x - mean) / (std + 1e-6), 0.0),
        "since_last": np.where(gap >= 0, gap, -1.0),
        **{f"tx_count_{k}": at - v for k, v in spans.items()}, "amt_24h_mean": day_mean}
    newest_t = int(newest[-1])
    # A late row that is still taken in looks back a day from its own time.
    keep = seen_t >= newest_t - _DAY - fixed.MAX_BACKDATE_S * MICROS
    return out, (int(n + m), float(s + x.sum()), float(q + (x * x).sum()), float(max(mx, x.max())), newest_t,
                 seen_t[keep].tolist(), seen_x[keep].tolist())


def answer_all(pdf: pd.DataFrame, held: dict[Any, tuple]) -> tuple[pd.DataFrame, dict[Any, tuple]]:
    """Features of rows ``(entity, id, no_id, t, no_t, amount)`` given the states before them, and the states of their entities after them."""
    pdf, groups = by_entity(pdf, ["no_t", "t", "no_id", "id"])
    t_all, x_all = pdf["t"].to_numpy(np.int64), pdf["amount"].to_numpy(float)
    stale, late = np.zeros((2, len(pdf)), np.int32)
    answers, after = Answers(len(pdf)), {}
    for entity, start, end in groups:
        state = held.get(entity, _EMPTY)
        last, ring = state[4], state[7]
        t = t_all[start:end]
        stale[start:end] = (last >= 0) & (last - t > fixed.MAX_BACKDATE_S * MICROS)
        late[start:end] = (last >= 0) & (t < last)
        at = start + np.flatnonzero(stale[start:end] == 0)
        if len(at):
            x = x_all[at]
            found, totals = features_of(t_all[at], x, state[:7])
            run = [*ring, *x.tolist()]
            answers.put(at, found, rings(run, len(ring)))
            state = (*totals, run[-RING:])
        after[entity] = state
    return pd.DataFrame({
        "entity": pdf["entity"], "id": pd.Series(ids_of(pdf), dtype=object), "t": t_all, "amount": pdf["amount"], "stale": stale,
        "out_of_order": late, **answers.columns()}), after


def _answer(pdf: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    """The same for the rows of one entity."""
    rows = pdf.assign(no_id=pdf["id"].isna(), no_t=pdf["t"].isna())
    out, after = answer_all(rows, {None if pd.isna(e) else e: state for e in rows["entity"].unique().tolist()})
    return out, next(iter(after.values()))


def held_as(entity: str, fields: str) -> str:
    """The states of a bucket's entities, each as a struct."""
    return f"held array<struct<entity: {entity}, {fields.replace(' ', ': ').replace(',:', ',')}>>"


def _keyed_as(schema: str, stream: DataFrame, roles: Roles) -> str:
    """The schema with the entity and id types of the stream."""
    entity, id_type = (stream.schema[c].dataType.simpleString() for c in (roles.entity, roles.id))
    return schema.replace("entity long, id long", f"entity {entity}, id {id_type}", 1)


_FEATURES = [part.strip().split(" ")[0] for part in OUTPUT.split(",")][6:-2]
_INTS = ["tx_count", "tx_count_10min", "tx_count_1h", "tx_count_24h"]


def stream_features(stream: DataFrame, roles: Roles = Roles(), time: str | None = None, ttl_days: int = TTL_DAYS,
                    buckets: int = BUCKETS) -> DataFrame:
    """Expanding, gap, trailing, sequence and lateness columns for every row of a stream.

    With ``time`` (a watermarked column) an entity's state is dropped ``ttl_days`` after its newest row.
    """
    ttl_ms = ttl_days * 86_400_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(r[1:]) for r in state.get[0]} if state.exists else {}
        now = state.getCurrentWatermarkMs() if time is not None else -1
        if not state.hasTimedOut:
            out, after = answer_all(pd.concat(list(frames), ignore_index=True), held)
            for entity, own in after.items():
                held[entity] = (*own[:8], max(own[4] // 1000 + ttl_ms, now + 1))
            yield out
        if time is not None:
            held = {e: h for e, h in held.items() if h[8] >= now}
        if not held:
            state.remove()
            return
        state.update(([(e, *h) for e, h in held.items()],))
        if time is not None:
            state.setTimeoutTimestamp(min(h[8] for h in held.values()))

    at = F.col(roles.ts)
    narrow = bucketed(
        stream, roles, F.coalesce(at, F.lit(-(1 << 63))).alias("t"), at.isNull().alias("no_t"), F.col(roles.amount).cast("double").alias("amount"),
        *([F.col(time)] if time else []), buckets=buckets)
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    entity = stream.schema[roles.entity].dataType.simpleString()
    return narrow.groupBy("bucket").applyInPandasWithState(
        step, _keyed_as(OUTPUT, stream, roles), held_as(entity, STATE), "append", timeout)


LABEL_STATE = "n long, y long, wait_t array<long>, wait_y array<long>, gone long"
_LONG_AGO = -(1 << 60)


def stream_label_encoding(stream: DataFrame, prior: float, lag_s: int, roles: Roles = Roles(),
                          weight: float = fixed.TARGET_PRIOR_WEIGHT) -> DataFrame:
    """Smoothed label rate of the entity from labels at least ``lag_s`` old; younger ones wait in state.

    For labels that come in the transaction's own row; ``streaming.labels`` takes them from a feed. Labels stay in the list for as long
    as a late row may still ask for an earlier time; a row later than that gets no encoding.
    """
    lag, back = lag_s * MICROS, fixed.MAX_BACKDATE_S * MICROS

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, y, wait_t, wait_y, gone = tuple(state.get) if state.exists else (0, 0, [], [], _LONG_AGO)
        pdf = pd.concat(list(frames)).sort_values(["t", "id"], kind="stable")
        t = pdf["t"].to_numpy(np.int64)
        all_t = np.concatenate((np.asarray(wait_t, np.int64), t))
        all_y = np.concatenate((np.asarray(wait_y, np.int64), pdf["y"].to_numpy(np.int64)))
        place = np.argsort(all_t, kind="stable")
        all_t, all_y = all_t[place], all_y[place]
        hits = np.concatenate(([0], np.cumsum(all_y)))
        ready = np.searchsorted(all_t, t - lag, side="right")
        rate = (y + hits[ready] + weight * prior) / (n + ready + weight)
        known = t >= gone
        yield pd.DataFrame({
            "entity": pdf["entity"].to_numpy(), "id": pdf["id"].to_numpy(), "ready": pd.Series(n + ready).astype("Int64").mask(~known),
            "target_enc": pd.Series(rate).mask(~known)})
        newest = max(int(t[-1]), gone + back)
        cut = int(np.searchsorted(all_t, newest - back - lag, side="right"))
        state.update((int(n + cut), int(y + hits[cut]), all_t[cut:].tolist(), all_y[cut:].tolist(), newest - back))

    narrow = stream.select(
        F.col(roles.entity).alias("entity"), F.col(roles.id).alias("id"),
        F.col(roles.ts).alias("t"), F.col(roles.label).cast("long").alias("y"))
    return narrow.groupBy("entity").applyInPandasWithState(
        step, _keyed_as("entity long, id long, ready long, target_enc double", stream, roles), LABEL_STATE, "append", GroupStateTimeout.NoTimeout)


def seeded_counts(stream: DataFrame, seed: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Running count and sum per entity that continue from a batch state table ``(entity, n, sum)``.

    Needs the RocksDB state store provider.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import StructType

    schema = StructType().add("n", "long").add("s", "double")

    class Continue(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.totals = handle.getValueState("totals", schema)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            n, s = self.totals.get() if self.totals.exists() else (0, 0.0)
            pdf = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
            x = pdf["amount"].to_numpy(float)
            yield pd.DataFrame({
                "entity": pdf["entity"].to_numpy(), "id": pdf["id"].to_numpy(), "tx_count": n + np.arange(len(x)),
                "tx_sum": s + np.concatenate(([0.0], np.cumsum(x)[:-1]))})
            self.totals.update((int(n + len(x)), float(s + x.sum())))

        def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
            row = initialState.iloc[0]
            self.totals.update((int(row["n"]), float(row["sum"])))

        def close(self) -> None:
            pass

    narrow = stream.select(
        F.col(roles.entity).alias("entity"), F.col(roles.id).alias("id"),
        F.col(roles.ts).alias("t"), F.col(roles.amount).cast("double").alias("amount"))
    start = seed.select(F.col(roles.entity).alias("entity"), "n", "sum")
    return narrow.groupBy("entity").transformWithStateInPandas(
        statefulProcessor=Continue(), outputStructType=_keyed_as("entity long, id long, tx_count long, tx_sum double", stream, roles),
        outputMode="Append", timeMode="None", initialState=start.groupBy("entity"))
