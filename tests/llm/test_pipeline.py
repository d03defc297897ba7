import corpus_pipeline
from arborlake.llm import repeats, simhash
from arborlake.llm.queries import oracle_sql, queries


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, d).write.parquet(out)
        after = spark.read.parquet(out)
        assert after.count() > 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "near_copies":
            found = simhash.near_duplicates(after)
            assert found.select("component_id").distinct().count() == after.count() < before
        if name == "repeats":
            assert repeats.op10(after).where("n_removed > 0").count() == 0
        docs = after
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_operator_has_a_query():
    names = queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert set(oracle_sql()) <= set(names)
