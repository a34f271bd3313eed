from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from txnlens.session import build_session

    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """Rows where one entity holds a third of the table, many share a time, some entities are null."""
    import random

    from pyspark.sql import types as T

    rng = random.Random(7)
    rows = []
    for i in range(1200):
        entity = 1 if i % 3 == 0 else rng.choice([2, 3, 4, 5, None])
        t = 500_000_000 if i % 4 == 0 else rng.randrange(0, 2_000) * 1_000_000
        rows.append((i, entity, t, float(rng.randrange(1, 500)), int(rng.random() < 0.2), rng.choice(["a", "b", None])))
    schema = T.StructType().add("event_id", "long").add("user_id", "long").add("t", "long").add("value", "double").add(
        "y", T.IntegerType()).add("event_type", "string")
    return spark.createDataFrame(rows, schema)
