"""Seeded state, vectors, repeated rows and arrival order of the keyed stream against batch answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.operators import windows
from txnlens.roles import MICROS
from txnlens.streaming import keyed, sources, state

DAY = 86_400 * MICROS
SCHEMA = T.StructType().add("event_id", "string").add("user_id", "string").add("t", "long").add("value", "double").add("k", "double").add("arrived", "long")
FEATURES = ["tx_count", "tx_sum", "mean_amount", "max_amount", "std_amount", "since_last", "tx_count_10min", "tx_count_1h", "tx_count_24h", "amt_24h_mean"]


def _drain(spark, tmp_path, parts, name="run", **options):
    base = tmp_path / name
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(base / "src"))
        stream = sources.stream_transactions(spark, "parquet", str(base / "src"), SCHEMA)
        sources.run_append_to(keyed.keyed_features(stream, **options), str(base / "out"), str(base / "offsets"), store=sources.ROCKSDB, state_partitions=2)
    return spark.read.parquet(str(base / "out"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(f"e{i}", "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.randrange(1, 6 * DAY), float(rng.randrange(1, 90)), float(rng.randrange(9)), i)
           for i in range(240)]
    return sorted(out, key=lambda r: r[2])


def test_stream_goes_on_from_a_batch_table(spark, tmp_path, rows):
    """Every feature and the vectors of the later rows are those of one pass over all rows."""
    seed = keyed.batch_state(spark.createDataFrame(rows[:130], SCHEMA), vector=["value", "k"])
    live = {r["id"]: r for r in _drain(spark, tmp_path, [rows[130:190], rows[190:]], vector=["value", "k"], seed=seed).collect()}
    batch = windows.velocity_features(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(live) == 110
    history = {}
    for i, u, t, x, k, _ in rows:
        history.setdefault(u, []).append([x, k])
        if i in live:
            assert [list(v) for v in live[i]["seq"]] == history[u][-10:] and live[i]["seq_len"] == len(history[u][-10:])
    for r in batch:
        if r["event_id"] in live:
            for c in FEATURES:
                assert live[r["event_id"]][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), c


def test_repeated_and_lacking_rows_leave_no_trace(spark, tmp_path):
    first = [("a", "u", DAY, 5.0, 0.0, 0), ("b", "u", 2 * DAY, 7.0, 0.0, 1), ("b", "u", 2 * DAY, 7.0, 0.0, 2), ("x", "u", None, 1.0, 0.0, 3), ("y", "u", 2 * DAY, None, 0.0, 4)]
    second = [("b", "u", 2 * DAY, 7.0, 0.0, 5), ("c", "u", 2 * DAY + 1, 9.0, 0.0, 6)]
    got = _drain(spark, tmp_path, [first, second]).collect()
    assert sorted((r["id"], r["duplicate"]) for r in got) == [("a", 0), ("b", 0), ("b", 1), ("b", 1), ("c", 0), ("x", 0), ("y", 0)]
    by_id = {r["id"]: r for r in got if not r["duplicate"]}
    assert by_id["c"]["tx_count"] == 2 and by_id["c"]["tx_sum"] == 12.0 and [v[0] for v in by_id["c"]["seq"]] == [5.0, 7.0, 9.0]
    assert by_id["x"]["lacking"] == by_id["y"]["lacking"] == 1 and by_id["x"]["tx_count"] is None
    assert all(r["tx_count"] is None and r["seq"] is None for r in got if r["duplicate"])


def test_verdicts_do_not_depend_on_triggers(spark, tmp_path, rows):
    rng = random.Random(4)
    arrived = sorted(rows, key=lambda r: r[2] + rng.randrange(3) * DAY)
    arrived = [(*r[:5], i) for i, r in enumerate(arrived)]
    verdict = lambda df: sorted((r["id"], r["stale"], r["out_of_order"]) for r in df.collect())
    one = verdict(_drain(spark, tmp_path, [arrived], "one", arrival="arrived"))
    many = verdict(_drain(spark, tmp_path, [arrived[i:i + 48] for i in range(0, 240, 48)], "many", arrival="arrived"))
    newest, truth = {}, []
    for i, u, t, *_ in arrived:
        m = newest.get(u, -1)
        truth.append((i, int(m >= 0 and m - t > DAY), int(m >= 0 and t < m)))
        newest[u] = max(m, t)
    assert one == many == sorted(truth) and sum(v[1] for v in one) > 5


BIG = 1 << 60


def _many(spark, tmp_path):
    """A stream of 40 entities, one of them missing, whose ids are beyond 2^53 or missing."""
    schema = T.StructType().add("event_id", "long").add("user_id", "long").add("t", "long").add("value", "double")
    rows = [(BIG + i if i % 11 else None, i % 40 or None, (i + 1) * DAY // 50, float(i)) for i in range(200)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "src"))
    return rows, sources.stream_transactions(spark, "parquet", str(tmp_path / "src"), schema)


@pytest.mark.parametrize("build", [keyed.keyed_features, state.stream_features])
def test_entities_share_calls_by_bucket(spark, tmp_path, build):
    """State rows are those of buckets, answers those of each entity; missing ids and entities leave the others as they are."""
    rows, stream = _many(spark, tmp_path)
    progress = sources.run_append_to(build(stream, buckets=4), str(tmp_path / "out"), str(tmp_path / "offsets"), store=sources.ROCKSDB, state_partitions=2)
    assert max(s["numRowsTotal"] for p in progress for s in p["stateOperators"]) <= 5
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    seen, want = {}, []
    for i, u, t, x in rows:
        own = seen.setdefault(u, [])
        want.append((i or 0, u or 0, t, len(own), sum(own), x))
        own.append(x)
    last = lambda v: v[0] if isinstance(v, list) else v
    assert sorted((r["id"] or 0, r["entity"] or 0, r["t"], r["tx_count"], r["tx_sum"], last(r["seq"][-1])) for r in got) == sorted(want)
