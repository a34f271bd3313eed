"""Event-time rates and progress of a running stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def sliding_rate(stream: DataFrame, time: str, width: str = "5 minutes", slide: str = "30 seconds", delay: str = "1 day") -> DataFrame:
    """Rows, frauds and fraud rate in sliding windows; counts are combined before the shuffle."""
    w = F.window(F.col(time), width, slide)
    fraud = F.sum(F.when(F.col("decision") == "FRAUD", 1).otherwise(0))
    out = stream.withWatermark(time, delay).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), fraud.alias("frauds"))
    return out.select(F.unix_micros("w.start").alias("window_start"), "n", "frauds", (F.col("frauds") / F.col("n")).alias("fraud_rate"))


def volume(stream: DataFrame, time: str, width: str = "1 minute", delay: str = "1 day") -> DataFrame:
    out = stream.withWatermark(time, delay).groupBy(F.window(F.col(time), width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_micros("w.start").alias("window_start"), "n")


def latency_p95(stream: DataFrame, time: str, latency: str, width: str = "5 minutes", slide: str = "1 minute",
                delay: str = "1 day") -> DataFrame:
    w = F.window(F.col(time), width, slide)
    out = stream.withWatermark(time, delay).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(latency, 0.95, 10_000).alias("p95"))
    return out.select(F.unix_micros("w.start").alias("window_start"), "n", "p95")


def offset_backlog(end: str | None, latest: str | None) -> int:
    """Rows between the processed and the newest offsets of a partitioned source, -1 when unknown."""
    try:
        done, newest = json.loads(end), json.loads(latest)
        return sum(int(newest[t][p]) - int(done.get(t, {}).get(p, 0)) for t in newest for p in newest[t])
    except (TypeError, ValueError, AttributeError, KeyError):
        return -1


def backlog_trace(progress: list, total: int) -> list[tuple[int, int, int]]:
    """``(batch, rows so far, rows still waiting)`` after each batch with data, for a source that reports no offsets per partition.

    ``total`` are the rows of the source; counting a Parquet folder reads file footers only.
    """
    out, done = [], 0
    for p in progress:
        if p.numInputRows:
            done += p.numInputRows
            out.append((p.batchId, done, total - done))
    return out


class BacklogListener(StreamingQueryListener):
    """Keeps the newest backlog of every query and whether it stays in budget."""

    def __init__(self, budget: int = 500):
        self.budget = budget
        self.backlog: dict[str, int] = {}
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.backlog[str(event.id)] = -1

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        parts = [offset_backlog(s.endOffset, s.latestOffset) for s in progress.sources]
        self.backlog[str(progress.id)] = -1 if any(p < 0 for p in parts) else sum(parts)
        self.rows[str(progress.id)] = self.rows.get(str(progress.id), 0) + progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def within_budget(self, query_id: str) -> bool:
        return 0 <= self.backlog.get(query_id, -1) <= self.budget
