"""The corpus pipeline's stages and what they keep."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline_runs_over_all_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs.count()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        if name != "mix":
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        now = spark.createDataFrame(out.collect(), out.schema)
        kept.append(now.count())
    assert kept[1] >= kept[0] - 2 and kept[2] < kept[1] and kept[3] < kept[2] and kept[4] == kept[3] and 0 < kept[5] <= kept[4]
    run = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in run.select("doc_id").collect()) == sorted(r["doc_id"] for r in now.select("doc_id").collect())
    assert run.filter(F.col("text").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")).count() == 0
