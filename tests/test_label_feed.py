"""Labels from a feed of their own against the batch encoding."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.operators import windows
from txnlens.roles import MICROS, Roles
from txnlens.streaming import labels, sources

DAY = 86_400
TX = T.StructType().add("event_id", "string").add("user_id", "string").add("t", "long")
FEED = T.StructType().add("event_id", "string").add("user_id", "string").add("t", "long").add("y", "integer").add("known", "long")
LAG = 5 * DAY


def _run(spark, tmp_path, tx, feed, triggers, **options):
    """One file an input a trigger; the last one only moves the watermark on."""
    out = str(tmp_path / "out")
    for i, (rows, known) in enumerate(triggers(tx, feed)):
        for name, some, schema in (("tx", rows, TX), ("feed", known, FEED)):
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        a, b = (sources.stream_transactions(spark, "parquet", str(tmp_path / n), s) for n, s in (("tx", TX), ("feed", FEED)))
        sources.run_append_to(labels.promoted_label_encoding(a, b, 0.05, LAG, **options), out, str(tmp_path / "offsets"),
                              store=sources.ROCKSDB, state_partitions=2)
    return spark.read.parquet(out)


def _triggers(n, far):
    def cut(tx, feed):
        size = -(-len(tx) // n)
        for i in range(n):
            yield tx[i * size:(i + 1) * size], [f for f in feed if f[-1] % n == i]
        beat = far * DAY * MICROS
        yield [("end", "beat", beat)], [("none", "beat", 0, 0, beat)]
    return cut


def test_feed_gives_the_batch_encoding(spark, tmp_path):
    """Labels out of order, after later transactions, twice, and in other triggers than their transactions; one entity has a third."""
    rng = random.Random(8)
    tx = sorted((f"e{i}", "hot" if i % 3 == 0 else f"u{rng.randrange(5)}", rng.randrange(0, 40 * DAY * MICROS)) for i in range(300))
    y = {e: int(rng.random() < 0.3) for e, _, _ in tx}
    tx.sort(key=lambda r: r[2])
    feed = []
    for e, u, t in tx:
        feed.append((e, u, t, y[e], t + rng.randrange(LAG) * MICROS // 2))
    feed += feed[::7]
    rng.shuffle(feed)
    rng.shuffle(tx)
    # Everything but the end comes in one watermark delay, so nothing is dropped.
    got = {r["id"]: r for r in _run(spark, tmp_path, tx, feed, _triggers(4, 400), delay="90 days").collect()}
    table = spark.createDataFrame([(*r, y[r[0]]) for r in tx], T.StructType([*TX.fields, T.StructField("y", T.IntegerType())]))
    batch = windows.target_encode_lagged(table, ["user_id"], F.lit(0.05), LAG, Roles()).collect()
    assert set(got) >= {r["event_id"] for r in batch} and len(got) == len(batch)
    for r in batch:
        assert got[r["event_id"]]["target_enc"] == pytest.approx(r["user_id_target_enc"], rel=1e-12)


def test_late_row_sees_no_young_label(spark, tmp_path):
    """A row that arrives after newer ones reads labels as of its own time."""
    s = DAY * MICROS

    def triggers(tx, feed):
        yield [("a", "u", s), ("b", "u", 10 * s)], [("a", "u", s, 1, 2 * s)]
        yield [("c", "u", 4 * s)], [("b", "u", 10 * s, 0, 11 * s)]
        yield [("end", "beat", 90 * s)], [("none", "beat", 0, 0, 90 * s)]

    got = {r["id"]: r["ready"] for r in _run(spark, tmp_path, [], [], triggers, delay="20 days").collect()}
    assert got == {"a": 0, "b": 1, "c": 0}


def test_state_of_silent_entities_goes(spark, tmp_path):
    s = DAY * MICROS

    def triggers(tx, feed):
        yield [("a", "u", s), ("b", "v", s)], [("a", "u", s, 1, 2 * s), ("b", "v", s, 1, 2 * s)]
        yield [("c", "v", 15 * s)], [("none", "beat", 0, 0, 15 * s)]
        yield [("x", "beat", 40 * s)], [("none", "beat", 0, 0, 40 * s)]
        yield [("d", "u", 41 * s), ("e", "v", 41 * s)], [("none", "beat", 0, 0, 41 * s)]
        yield [("end", "beat", 90 * s)], [("none", "beat", 0, 0, 90 * s)]

    got = {r["id"]: r["ready"] for r in _run(spark, tmp_path, [], [], triggers, ttl_days=30).collect()}
    assert {k: got[k] for k in "abcde"} == {"a": 0, "b": 0, "c": 1, "d": 0, "e": 1}


def test_entities_share_timers_by_bucket(spark, tmp_path):
    """Thirty entities in two buckets have two timers a slice, and each is answered from its own labels."""
    s = DAY * MICROS
    tx = [(f"{u}-{d}", f"u{u}", d * s + u) for u in range(30) for d in (1, 8, 15)]
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    deals = [(tx, [(e, u, t, int(u[1:]) % 2, t + s) for e, u, t in tx]), ([("end", "beat", 90 * s)], [("none", "beat", 0, 0, 90 * s)])]
    held = []
    for rows, known in deals:
        for name, some, schema in (("tx", rows, TX), ("feed", known, FEED)):
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        a, b = (sources.stream_transactions(spark, "parquet", str(tmp_path / n), c) for n, c in (("tx", TX), ("feed", FEED)))
        for p in sources.run_append_to(labels.promoted_label_encoding(a, b, 0.05, LAG, delay="30 days", buckets=2), out, offsets,
                                       store=sources.ROCKSDB, state_partitions=2):
            held.append(p["stateOperators"][0]["numRowsTotal"])
    # A counter, three slices of labels, three of questions, and the timers of each bucket.
    assert max(held) < 60
    got = {r["id"]: (r["ready"], round(r["target_enc"], 9)) for r in spark.read.parquet(out).where("id <> 'end'").collect()}
    assert got == {f"{u}-{d}": (n, round((n * (u % 2) + 0.5) / (n + 10), 9)) for u in range(30) for n, d in enumerate((1, 8, 15))}
