import corpus_pipeline
from penstroke.llm import jaccard


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, counts = docs.columns, {"": docs.count()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / f"{k}"))
        out = spark.read.parquet(str(tmp_path / f"{k}"))
        counts[name] = out.count()
        if name != "packing":
            assert out.columns == columns
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            if name == "near_duplicates":
                groups = jaccard.similar(docs.select("doc_id", "text"))
                assert out.count() == groups.select("component_id").distinct().count()
                assert jaccard.similar(out.select("doc_id", "text")).where("doc_id != component_id").count() == 0
            docs = out
    assert counts[""] > counts["quality_rules"] > counts["near_duplicates"] >= counts["decontamination"] == counts["secret_scan"]
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}|[0-9a-f]{24}'").count() == 0


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 14)] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
