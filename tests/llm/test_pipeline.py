"""The pipeline's stages one by one, and that its last table holds what the stages before it kept."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from check_queries import compare

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from txnlens.llm import exact_stream, simhash_blocks  # noqa: E402
from txnlens.llm.queries import ORACLE, QUERIES  # noqa: E402

FOLDER = os.environ.get("TXNLENS_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns and sizes[-1] <= sizes[-2]
        if name == "exact_dedup":
            assert exact_stream.copies(docs).where("NOT kept").count() == 0
        if name == "near_dedup":
            assert simhash_blocks.near_groups(docs, words=5).where("doc_id <> component_id").count() == 0
            kept = {r.doc_id for r in docs.collect()}
        if name == "secrets":
            assert {r.doc_id for r in docs.collect()} == kept
    assert {r.doc_id for r in docs.collect()} == kept


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    for k, rows in enumerate((odd, empty)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            out.write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.schema(out.schema).parquet(str(tmp_path / f"{k}-{name}"))
        assert (docs.count() > 0) == (k == 0)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_texts_reach_python_in_short_batches(spark, empty, name):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    dict(corpus_pipeline.STAGES)[name](spark, empty, FOLDER)
    sizes = spark.range(3000).coalesce(1).mapInPandas(lambda batches: (b.head(1).assign(id=len(b)) for b in batches), "id long")
    assert max(r.id for r in sizes.collect()) <= 256
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE:
        con = duckdb.connect()
        for table in ("documents", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        assert compare(ours, con.execute(ORACLE[name]).df()) == ""
    elif name != "op1_license_scan":
        assert len(ours) > 0
