"""SQL of the queries, the registration and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from answerlens.llm import catalog, common
from tests.llm.conftest import SF
from workload.compare import oracle_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == oracle_rows(SF, catalog.ORACLES[name])


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {f"{x.split('_')[0]}_" for x in catalog.QUERIES}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(names)


def test_pipeline_stages(spark, texts):
    docs = common.documents(spark, SF)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.settled(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
            assert out.where(F.length("text") != F.col("n_chars")).count() == docs.where(F.length("text") != F.col("n_chars")).count() == 0
            sizes.append(out.count())
            docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * len(texts)
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_of_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = common.settled(stage(spark, rows, SF), f"odd-{name}")
        assert (rows.count() > 0) == (docs is odd)
