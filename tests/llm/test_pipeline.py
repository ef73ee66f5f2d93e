import corpus_pipeline
from loadscope.llm import exact_dedup, near_dup


def test_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, "/root/testdata/sf0.001")
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert kept.columns == docs.columns
        if name == "exact_dedup":
            assert exact_dedup.decisions(kept).where("group_size > 1").count() == 0
            assert kept.count() == exact_dedup.decisions(before).where("kept").count()
        if name == "near_dedup":
            assert near_dup.near_duplicates(kept, 5, 80).where("not kept").count() == 0


def test_empty_and_edge_tables(spark, edge, none):
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (none.select(base), edge.select(base)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "/root/testdata/sf0.001")
            rows = df.collect()
            df = spark.createDataFrame(rows, df.schema)
    assert len(rows) > 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
