import pytest

from quillspark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, compare):
    compare(registry.queries()[name], registry.oracle_sql()[name])


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], folder)
        assert out.columns == docs.columns
        kept.append(corpus_pipeline.cut(out, "test"))
    n = [k.count() for k in kept]
    assert n[0] >= n[1] >= n[2] >= n[3] > 0
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[4] <= ids[3] <= ids[2] <= ids[1] <= ids[0]
    assert corpus_pipeline.run(spark, folder).count() == n[4]
