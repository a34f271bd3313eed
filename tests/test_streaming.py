"""Streams over file sources against the batch answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.operators import windows
from txnlens.roles import MICROS
from txnlens.streaming import rates, sources, state


def test_several_triggers_equal_one_batch_pass(spark, skewed, tmp_path):
    """The table arrives in time order over five triggers; state carries the history across them."""
    src = tmp_path / "src"
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    rows = skewed.where("user_id is not null")
    cuts = [0, 400_000_000, 500_000_000, 500_000_001, 1_500_000_000, 3_000_000_000]
    for lo, hi in zip(cuts, cuts[1:]):
        rows.where((F.col("t") >= lo) & (F.col("t") < hi)).write.mode("append").parquet(str(src))
        stream = sources.stream_transactions(spark, "parquet", str(src), rows.schema)
        sources.run_append_to(state.stream_features(stream), out, offsets)
    live = {r["id"]: r for r in spark.read.parquet(out).collect()}
    batch = windows.velocity_features(rows).collect()
    assert len(live) == len(batch)
    for r in batch:
        s = live[r["event_id"]]
        for c in ("tx_count", "tx_count_10min", "tx_count_1h", "tx_count_24h"):
            assert s[c] == r[c]
        for c in ("tx_sum", "mean_amount", "max_amount", "std_amount", "since_last", "amt_24h_mean"):
            assert s[c] == pytest.approx(r[c], rel=1e-9, abs=1e-9)


def test_batches_with_state_tables_equal_one_pass(spark, skewed, tmp_path):
    """The DataFrame form of the stream: state tables carry history over triggers, hot entity included."""
    from txnlens.streaming.batches import FeatureBatches

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    handle = FeatureBatches(out, str(tmp_path / "state"))
    cuts = [0, 400_000_000, 500_000_000, 500_000_001, 3_000_000_000]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        rows = skewed.where((F.col("t") >= lo) & (F.col("t") < hi))
        rows.write.mode("append").parquet(src)
        stream = sources.stream_transactions(spark, "parquet", src, skewed.schema)
        sources._start(stream.writeStream.foreachBatch(handle), spark, str(tmp_path / "offsets"))
        if i == 2:
            # A repeated batch leaves the same rows and state.
            handle(rows, i)
    cols = ["tx_count", "tx_count_10min", "tx_count_24h", "tx_sum", "mean_amount", "max_amount", "std_amount", "since_last", "amt_24h_mean"]
    live = {r["event_id"]: r for r in spark.read.parquet(out).collect()}
    batch = windows.velocity_features(skewed).collect()
    assert len(live) == len(batch) == 1200
    for r in batch:
        for c in cols:
            assert live[r["event_id"]][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), c


def test_batches_leave_untouched_buckets_alone(spark, tmp_path):
    """Each batch writes the buckets of its own entities; replaced versions go a batch later, others stay as they are."""
    from txnlens.streaming.batches import FeatureBatches

    handle = FeatureBatches(str(tmp_path / "out"), str(tmp_path / "state"), buckets=8)
    entities = [list(range(40)), [1], [1, 2], [], [1, None]]
    want, n = {}, 0
    for i, group in enumerate(entities):
        rows = []
        for e in group:
            rows.append((n, e, (n + 1) * MICROS, 2.0))
            want[n] = sum(1 for g in entities[:i] for x in g if x == e)
            n += 1
        batch = spark.createDataFrame(rows, "event_id long, user_id long, t long, value double")
        before = handle.index(spark, i - 1)
        handle(batch, i)
        handle(batch, i)
        own = {r["b"] for r in batch.select(handle._bucket().alias("b")).collect()}
        after = handle.index(spark, i)
        assert {b for b, v in after.items() if v == i} == own
        assert {b: v for b, v in after.items() if b not in own} == {b: v for b, v in before.items() if b not in own}
    live = {(int(p.parent.name.split("=")[1]), int(p.name.split("=")[1]))
            for p in (tmp_path / "state" / "entity").glob("version=*/bucket=*")}
    assert {(v, b) for b, v in after.items()} | {(v, b) for b, v in before.items()} == live
    assert {r["event_id"]: r["tx_count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_keys_of_any_type(spark, tmp_path):
    schema = T.StructType().add("event_id", "string").add("user_id", "string").add("t", "long").add("value", "double").add("y", "integer")
    src = str(tmp_path / "s")
    spark.createDataFrame([("a", "u-1", MICROS, 5.0, 1), ("b", "u-1", 2 * MICROS, 6.0, 0), ("c", None, 3 * MICROS, 7.0, 0)], schema).write.parquet(src)
    stream = sources.stream_transactions(spark, "parquet", src, schema)
    assert {(r["id"], r["tx_count"]) for r in sources.run_append(state.stream_features(stream), "any").collect()} == {("a", 0), ("b", 1), ("c", 0)}
    stream = sources.stream_transactions(spark, "parquet", src, schema)
    assert {(r["id"], r["ready"]) for r in sources.run_append(state.stream_label_encoding(stream, 0.1, 1), "any").collect()} == {("a", 0), ("b", 1), ("c", 0)}


def test_late_label_rows_read_no_young_label(spark, tmp_path):
    """Labels in the row: one that comes a trigger later is answered as of its own time, and not at all when it is too late."""
    schema = T.StructType().add("event_id", "long").add("user_id", "long").add("t", "long").add("y", "integer")
    src, out, offsets = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    hour = 3_600 * MICROS
    for rows in ([(1, 7, 1 * hour, 1), (2, 7, 50 * hour, 1)], [(3, 7, 40 * hour, 0), (4, 7, 5 * hour, 0), (5, 7, 70 * hour, 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sources.run_append_to(state.stream_label_encoding(sources.stream_transactions(spark, "parquet", src, schema), 0.1, 10 * 3600), out, offsets)
    assert {r["id"]: r["ready"] for r in spark.read.parquet(out).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: 4}


def test_late_rows(spark, tmp_path):
    schema = T.StructType().add("event_id", "long").add("user_id", "long").add("t", "long").add("value", "double")
    src, out, offsets = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    day = 86_400 * MICROS
    for rows in ([(1, 7, 10 * day, 5.0)], [(2, 7, 10 * day - 5, 6.0), (3, 7, 9 * day, 7.0), (4, 7, 9 * day - 1, 8.0)], [(5, 7, 10 * day, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sources.run_append_to(state.stream_features(sources.stream_transactions(spark, "parquet", src, schema)), out, offsets)
    got = {r["id"]: (r["stale"], r["out_of_order"], r["tx_count"], r["since_last"]) for r in spark.read.parquet(out).collect()}
    assert got[1] == (0, 0, 0, -1.0)
    assert got[2][:2] == (0, 1) and got[2][3] == -1.0
    assert got[3][:2] == (0, 1)
    assert got[4][:3] == (1, 1, None)
    assert got[5] == (0, 0, 3, 0.0)


def test_idle_entities_are_forgotten(spark, tmp_path):
    schema = T.StructType().add("event_id", "long").add("user_id", "long").add("t", "long").add("value", "double")
    src, out, offsets = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    day = 86_400 * MICROS
    for rows in ([(1, 7, 1 * day, 5.0), (2, 8, 1 * day, 5.0)], [(3, 8, 100 * day, 6.0)], [(4, 9, 200 * day, 6.0)],
                 [(5, 7, 201 * day, 1.0), (6, 8, 201 * day, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = sources.stream_transactions(spark, "parquet", src, schema)
        stream = stream.withColumn("at", F.timestamp_micros("t")).withWatermark("at", "1 day")
        sources.run_append_to(state.stream_features(stream, time="at"), out, offsets)
    got = {r["id"]: r["tx_count"] for r in spark.read.parquet(out).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 2}


def test_poison_messages_are_set_aside(spark, tmp_path):
    src = tmp_path / "m"
    src.mkdir()
    good = [json.dumps({"TransactionID": i, "TransactionAmt": 1.5, "card1": 4}) for i in range(3)]
    (src / "a.txt").write_text("\n".join([good[0], '{"TransactionID": 1, "Trans', good[1], "boom", good[2]]))
    schema = T.StructType().add("TransactionID", "long").add("TransactionAmt", "double").add("card1", "long")
    stream = sources.stream_transactions(spark, "text", str(src), T.StructType().add("value", "string"))
    ok, dead = sources.dead_letters(sources.parse_messages(stream, schema))
    assert sorted(r["TransactionID"] for r in sources.run_append(ok, "ok").collect()) == [0, 1, 2]
    assert sources.run_append(dead, "dead").count() == 2


def test_backlog():
    assert rates.offset_backlog('{"tx":{"0":5,"1":7}}', '{"tx":{"0":9,"1":7}}') == 4
    assert rates.offset_backlog('{"logOffset":3}', None) == -1
    assert rates.offset_backlog("oops", "{}") == -1
    listener = rates.BacklogListener(3)
    listener.backlog["q"] = 4
    assert not listener.within_budget("q") and not listener.within_budget("other")
