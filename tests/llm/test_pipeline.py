import corpus_pipeline
from lakesteward.llm.compression import quality_scores
from lakesteward.llm.contamination import leaks
from lakesteward.llm.hyperminhash import near_duplicates


def test_stages_take_effect_and_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "repeats", "leaks", "pieces"]
    good = steps["quality"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality_scores(docs, labels).collect() if r["predicted"]}
    single = steps["near_duplicates"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in near_duplicates(docs, 5, 80).collect() if r["kept"]}
    cut = steps["repeats"](spark, docs, sf_dir)
    assert cut.count() == docs.count()
    clean = steps["leaks"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in leaks(docs, items).collect()}
    assert all(f.columns == docs.columns for f in (good, single, cut, clean))


def test_whole_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert 0 < len(found) < len(ids) and {r["doc_id"] for r in found} <= ids and all(r["lossless"] for r in found)


def test_empty_and_odd_documents_go_through(spark, sf_dir, documents, tmp_path):
    rows = [(None, None), (1, ""), (2, None), (3, "a b c"), (3, "a b c"), (4, "word " * 30_000)]
    for n, table in enumerate((documents(rows), documents([]))):
        folder = str(tmp_path / str(n))
        table.write.parquet(f"{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(10 * (1 - n)).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns, name
        corpus_pipeline.run(spark, folder).collect()
