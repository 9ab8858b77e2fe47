import corpus_pipeline
from pyspark.sql import functions as F


def test_pipeline_keeps_what_it_should(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], "/root/testdata/sf0.001")
        if name != "encode":
            assert out.columns == corpus_pipeline.COLUMNS
        seen.append(out.checkpoint())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert len(ids[1]) > 0.98 * len(ids[0])  # only texts without a language go
    assert seen[2].filter(F.length("text") == 0).count() == 0
    assert 0 < seen[5].count() == seen[4].count()
