"""The pipeline's stages in order over a small table."""

import corpus_pipeline
from sparquill.llm import byte_cnn, near_duplicates, pii


def test_run_equals_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in byte_cnn.classify(docs, labels).collect() if r.score >= 0.7}
    kept = docs.where(docs["doc_id"].isin(*good))
    one = {r.doc_id for r in near_duplicates.near_duplicates(kept).collect() if r.kept}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality"]) == good and set(seen["near_duplicates"]) == one == set(seen["personal_data"])
    assert all(t == pii.redacted(seen["near_duplicates"][i], pii.find_spans(seen["near_duplicates"][i])[1]) for i, t in seen["personal_data"].items())
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == set(seen["mixing"]) <= one
