"""The SQL twins on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from issuequarry.llm import queries

SF = "/root/testdata/sf0.001"


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "conversations", "labels", "embeddings"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.sql(queries.oracle_sql()[name]).df()
    assert _plain(queries.registry()[name](spark, SF).toPandas()) == _plain(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
        if name != names[-1]:
            assert docs.columns == columns
            assert 0 < docs.count() <= before.count()
            before_ids = {r.doc_id for r in before.select("doc_id").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= before_ids
        else:
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
