"""A stream from raw transactions to decisions: validation, repeated ids, keyed features, blend with fallback."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.operators import ensemble, validate
from txnlens.roles import Roles
from txnlens.streaming import keyed, sources


def decisions(
    stream: DataFrame, time: str, scores: Sequence[str], full: ensemble.Weights, fallback: ensemble.Weights, t_full: float, t_fallback: float,
    from_features: dict[str, Column] | None = None, roles: Roles = Roles(), delay: str = "2 days", seed: DataFrame | None = None,
) -> DataFrame:
    """``(id, mode, p, decision)`` of every valid transaction that comes for the first time.

    ``scores`` are model scores in the row, ``from_features`` scores as expressions over the keyed features. Two stateful operators share
    the watermark of ``time``: the first drops ids that come again within ``delay``, the second keeps the features; a row too late for the
    features is scored without them. A missing score leads to the fallback weights, and to no decision where these lack one too.
    """
    valid = stream.where(validate.reject_reason(roles.id, roles.ts, roles.amount, roles.entity).isNull())
    once = sources.dedupe_stream(valid, time, roles, delay)
    live = keyed.keyed_features(once, roles, list(scores), seed)
    own = F.element_at("seq", -1)
    named = live.withColumns({s: F.get(own, F.lit(i)) for i, s in enumerate(scores)}).withColumns(from_features or {})
    return ensemble.score_with_fallback(named, full, fallback, t_full, t_fallback).select("id", "mode", "p", "decision")


def run_sinks(scored: DataFrame, base: str, name: str = "scored", **options) -> None:
    """Every decision goes to ``log``, frauds also to ``alert``; a folder a batch, so a repeated batch leaves the same rows."""
    def both(batch: DataFrame, batch_id: int) -> None:
        # Both sinks read the batch, whose features would be computed twice without this.
        rows = batch.persist()
        rows.write.mode("overwrite").parquet(os.path.join(base, "log", f"batch={batch_id}"))
        rows.where("decision = 'FRAUD'").write.mode("overwrite").parquet(os.path.join(base, "alert", f"batch={batch_id}"))
        rows.unpersist()

    sources.run_batches(scored, both, name, **options)
