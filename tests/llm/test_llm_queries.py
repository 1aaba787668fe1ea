"""The SQL twins and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from rulegrain.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    theirs = connection.execute(ORACLE[name]).df()
    mine = QUERIES[name](spark, SF_DIR).toPandas()[list(theirs.columns)]
    columns = list(theirs.columns)
    assert (mine.sort_values(columns).reset_index(drop=True) == theirs.sort_values(columns).reset_index(drop=True)).all(axis=None)


def test_pipeline_stages_only_drop_or_repeat(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.stored(out)
        left = {row["doc_id"] for row in docs.select("doc_id").collect()}
        assert left and (ids is None or left <= ids)
        ids = left
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()
