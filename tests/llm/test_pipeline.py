"""The pipeline's stages, and the registered queries, on the driver's tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in registry.oracle_sql():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = con.sql(registry.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        plain = lambda d: sorted(map(str, d[columns].astype(object).values.tolist()))
        assert plain(got) == plain(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = [before]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "ngram_join":
            assert docs.select("doc_id").distinct().count() == kept[-1]
    toxic, lines, near, mix, last = kept[1:]
    assert before > toxic >= lines >= near > 0.7 * before * 0.7
    assert last == mix and docs.where("not decodes").count() == 0
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
