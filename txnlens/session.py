"""Session settings, the shared working folder and size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows one task may hold in one ordered group before the group is cut into chunks.
ROWS_PER_CHUNK = 2_000_000


def build_session(app: str = "txnlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Own folders by application, where ``spark.checkpoint.dir`` is unset.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach; ``spark.checkpoint.dir`` names it on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="txnlens-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


# Innermost last: the paths of the scopes that are open.
_SCOPES: list[list[str]] = []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables and stream folders made inside are deleted at the end; write or collect results before that."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            delete_path(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it belongs to the innermost open scope."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: survives lost executors, keeps columns and sizes."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over the cores, for work that costs much a row; an explicit number is not coalesced again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def rows_at_most(df: DataFrame, limit: int) -> tuple[bool, int]:
    """Whether ``df`` has at most ``limit`` rows, and its row count.

    The rows are counted: estimates of a plan come from compressed sizes, which say nothing about repetitive or exploded rows.
    """
    n = df.count()
    return n <= limit, n
