import corpus_pipeline as pipeline
from tests.llm.test_corpus import corpus


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", "a" if (i or 0) % 2 else None, 1, "extra") for i, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this kind stands there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names[0].startswith("quality") and names[-1] == "sharding"
    now = docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/s{k}")
        now = spark.read.parquet(f"{tmp_path}/s{k}")
        if k < 4:
            assert now.columns == docs.columns
        if k == 1:
            texts = [r.text for r in now.collect()]
            assert len(texts) == len(set(texts))
    assert "shard" in now.columns
    assert pipeline.shard(spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_decontamination_stage(spark, tmp_path):
    """One whole item is enough to go; null texts, null ids and repeated ids stay."""
    leak = "one two three four five six seven eight nine ten"
    texts = [(1, f"before {leak} after"), (2, None), (3, leak.rsplit(" ", 3)[0]), (None, "clean words"), (None, leak.upper()), (4, ""), (4, "clean words")]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in texts], "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.decontaminate(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    left = sorted((repr(r.doc_id), repr(r.text)) for r in out.collect())
    assert left == sorted((repr(i), repr(t)) for i, t in texts if t is None or "eight" not in t.lower())
