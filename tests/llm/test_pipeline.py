"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from matchspark.llm import decontaminate, packing, pii, simhash


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, last = docs.columns, docs
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, last, sf).write.parquet(str(tmp_path / name))
        last = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert last.columns == columns
            kept[name] = {r.doc_id for r in last.select("doc_id").collect()}
    stages = list(kept.values())
    assert all(b <= a for a, b in zip(stages, stages[1:], strict=False))
    assert kept["pii"] == kept["decontamination"]
    assert {r.doc_id for r in last.select("doc_id").collect()} <= kept["pii"]
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    left = spark.read.parquet(str(tmp_path / "pii"))
    assert decontaminate.find_matches(left, items).count() == 0
    assert simhash.keep_one(left).count() == left.count()
    assert all(not pii.base_spans(r.text) for r in left.collect())
    assert left.where("n_chars <> length(text)").count() == 0


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    assert "batch_id" in out.columns


def test_odd_rows(spark, odd, odd_labels, sf):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_run_ends_in_masked_tokens(spark, sf):
    enc = packing.encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "mail a.b@c.example.org now")], "doc_id long, text string")
    masked = corpus_pipeline.personal_data_masked(spark, docs, sf)
    assert enc.decode(corpus_pipeline.packed(spark, masked, sf).first().tokens) == "mail <EMAIL> now"


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect() == []


def test_no_labels_and_no_benchmark(spark, sf, tmp_path):
    """Empty tables beside the documents: nothing is rejected for them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.toxic_out(spark, docs, str(tmp_path)).count() in (0, docs.count())
    assert corpus_pipeline.benchmark_out(spark, docs, str(tmp_path)).count() == docs.count()
