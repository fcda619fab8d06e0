import pytest

import __spark_entry__ as entry
import corpus_pipeline
from glosswork.llm.oracle import ORACLE
from glosswork.llm.queries import QUERIES
from tests.compare import difference, oracle_connection

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), oracle_connection(SF).execute(ORACLE[name]).df()) is None


def test_stages_keep_the_columns(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    docs = first
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == first.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = after
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.collect()} == ids


def test_stages_bear_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
