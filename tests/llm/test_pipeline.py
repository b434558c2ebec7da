"""Every stage on its own input, and the pipeline's result against its parts."""

import corpus_pipeline
from gleamline.llm import toxicity
from gleamline.session import stage

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "secret scans", "best-fit packing"]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF_DIR))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "best-fit packing":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rejected = {r.doc_id for r in toxicity.score_documents(given, labels).filter("predicted = 1").collect()}
    assert kept["toxicity"] == {r.doc_id for r in given.collect()} - rejected
    assert kept["simhash near-dedup"] <= kept["exact dedup"] <= kept["toxicity"]
    assert kept["secret scans"] == kept["simhash near-dedup"] == kept["best-fit packing"]
    assert kept["best-fit packing"] == {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()}


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = stage(step(spark, docs, SF_DIR))
            assert docs.columns == odd.columns
        corpus_pipeline.pack(spark, docs, SF_DIR).collect()
