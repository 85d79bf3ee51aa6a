import corpus_pipeline
from terrastrata.llm import decontaminate, rules, simhash

from .helpers import DOCS, table


def test_stages_keep_columns_and_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark", "source_mix", "hilbert_shards"]
    kept = {r["doc_id"] for r in rules.judge(docs).where("kept").collect()}
    a = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == kept
    b = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert b.columns == docs.columns and {r["doc_id"] for r in b.collect()} == groups
    c = corpus_pipeline.benchmark(spark, docs, sf_dir)
    bad = decontaminate.query(spark, sf_dir).where("contaminated").count()
    assert c.columns == docs.columns and c.count() == docs.count() - bad


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) > 0 and {r["shard"] for r in out} <= set(range(8))


def test_awkward_rows_pass_all_stages(spark, sf_dir):
    for data in (table(spark), spark.createDataFrame([], DOCS)):
        docs = data
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()


def test_stages_keep_columns_with_names_of_added_ones(spark, sf_dir):
    from terrastrata.llm import mixing, shards

    names = [n for n in dict.fromkeys((*rules.ADDED, *mixing.ADDED, *decontaminate.ADDED, *simhash.ADDED, "__key", "__words", "__max_mean_word", "__h", "__draw")) if n not in table(spark).columns]
    docs = table(spark).selectExpr("*", *(f"'{i}' AS {n}" for i, n in enumerate(names)))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    for r in kept.collect():
        assert all(r[n] == str(i) for i, n in enumerate(names))
    assert set(docs.columns) - set(shards.ADDED) <= set(corpus_pipeline.hilbert_shards(spark, kept, sf_dir).columns)
