"""Exact deduplication as a stream over keyed state on disk, with a check of the full bytes on every hit.

Each row becomes a record: the digest of its folded text, its identifier and a locator of its content. A stream of records
runs through state keyed by digest, kept in RocksDB without expiry, which retains the winning identifier, its locator and the
count. A later run on the same checkpoint continues where the last one stopped. Digests that hit are then compared byte by
byte: the least and the greatest text under a digest are equal only if all are. Where they differ, rows are grouped by the
text itself, so that no collision drops a document.

Texts are equal when identical after lower-casing A-Z. A null text counts as empty; a null doc_id loses against any other.
Rows that repeat both doc_id and text are one document: each has an output row, and ``without_copies`` keeps one of them. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.common import clean_docs, drop_table, fold_ascii, kept_table, read_documents, scratch_path, unused

#: Digests in so few groups of copies that they may be sent to every task: eight bytes each.
SMALL_HITS = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Digest = Callable[[Column], Column]


def sha256_digest(folded: Column) -> Column:
    return F.sha2(folded.cast("binary"), 256)


def records(docs: DataFrame, digest: Digest = sha256_digest) -> DataFrame:
    """``(digest, doc_id, locator)``; the locator names the file that holds the content, where the plan reads files."""
    return clean_docs(docs).select(
        digest(fold_ascii(F.col("text"))).alias("digest"), "doc_id", F.input_file_name().alias("locator"))


def run_stream(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files_per_trigger: int = 1000) -> None:
    """Take the record files that are new in ``source`` into the state of ``checkpoint``; changed keys go to ``out``.

    The settings of the state belong to a session of their own, so other streams and queries keep theirs.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Many small stores: none reserves space ahead of its files, and a commit writes its changes alone.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    state = rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))

    def put(batch: DataFrame, number: int) -> None:
        # One folder a batch, overwritten if the batch is repeated.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(
        availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def registry(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each digest; counts and winners only grow, so the greatest are the last."""
    schema = "digest string, keeper struct<doc_id: bigint, locator: string>, group_size bigint, batch bigint"
    return spark.read.schema(schema).parquet(out).groupBy("digest").agg(
        F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"))


def colliding(docs: DataFrame, hits: DataFrame, digest: Digest) -> DataFrame:
    """Digests in ``hits(digest)`` whose texts aren't all the same bytes.

    Texts meet as a least and a greatest one under their digest, combined in each task before the shuffle, so a group of any
    size moves two texts a task. A short list of hits is sent to the tasks to leave single texts out before that.
    """
    texts = clean_docs(docs).select(fold_ascii(F.col("text")).alias("folded")).select(digest(F.col("folded")).alias("digest"), "folded")
    if hits.count() <= SMALL_HITS:
        few = hits.select(F.xxhash64("digest").alias("h")).distinct()
        texts = texts.join(F.broadcast(few), F.xxhash64("digest") == F.col("h"), "left_semi")
    return texts.groupBy("digest").agg(F.min("folded").alias("lo"), F.max("folded").alias("hi")).where("lo <> hi").select("digest")


def copies(docs: DataFrame, digest: Digest = sha256_digest, files_per_trigger: int = 1000) -> DataFrame:
    """``(doc_id, keep_id, keep_locator, group_size, kept, digest)`` of every row: the largest doc_id of equal texts stays."""
    spark = docs.sparkSession
    recs, source = kept_table(records(docs, digest), "dedup-records")
    out, checkpoint = scratch_path(spark, "dedup-updates"), scratch_path(spark, "dedup-state")
    run_stream(spark, source, recs.schema, out, checkpoint, files_per_trigger)
    known, _ = kept_table(registry(spark, out), "dedup-registry") if recs.head(1) else (registry_of(recs), "")
    drop_table(spark, checkpoint, out)
    bad, _ = kept_table(colliding(docs, known.where("group_size > 1").select("digest"), digest), "dedup-collisions")
    plain = recs.join(known, "digest")
    if bad.head(1):
        plain = plain.join(bad, "digest", "left_anti")
    found = plain.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.locator").alias("keep_locator"),
                         "group_size", "digest")
    if bad.head(1):
        found = found.unionByName(by_text(docs, bad, digest))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def registry_of(recs: DataFrame) -> DataFrame:
    return recs.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))


def by_text(docs: DataFrame, bad: DataFrame, digest: Digest) -> DataFrame:
    """The same columns for rows under ``bad(digest)``, grouped by the text itself."""
    rows, _ = kept_table(clean_docs(docs).select(
        "doc_id", fold_ascii(F.col("text")).alias("folded"), F.input_file_name().alias("locator")).withColumn(
        "digest", digest(F.col("folded"))).join(bad, "digest", "left_semi"), "dedup-clashing")
    groups = rows.groupBy("digest", "folded").agg(
        F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))
    return rows.join(groups, ["digest", "folded"]).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.locator").alias("keep_locator"), "group_size", "digest")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat doc_id and text, one stays."""
    decided, _ = kept_table(copies(docs).select("doc_id", "digest", "kept"), "dedup-decided")
    # Digests are enough here: ``copies`` compared the bytes, and colliding texts differ in doc_id.
    key, other_id, other_key = unused(docs, "_key", "_id", "_digest")
    gone = decided.where("NOT kept").select(F.col("doc_id").alias(other_id), F.col("digest").alias(other_key)).distinct()
    left = docs.withColumn(key, sha256_digest(fold_ascii(F.coalesce(F.col("text"), F.lit("")))))
    left = left.join(gone, left["doc_id"].cast("long").eqNullSafe(gone[other_id]) & (left[key] == gone[other_key]), "left_anti")
    twice = decided.where("kept").groupBy("doc_id", "digest").count().where("count > 1")
    if twice.head(1):
        left = left.dropDuplicates(["doc_id", key])
    return left.select(docs.columns)


def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    return copies(read_documents(spark, folder)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
