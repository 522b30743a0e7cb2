import corpus_pipeline
from blotter.llm import jaccard
from blotter.llm.common import written


def test_stages_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_join", "secret_scan", "packing"]


def test_stages_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before, kept = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "test-stage")
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept["language_id"]) >= 195
    assert kept["secret_scan"].keys() == kept["ngram_join"].keys()
    sets = [set(jaccard.shingle_set(t, 5).tolist()) for t in kept["ngram_join"].values()]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not a or not b or 100 * len(a & b) < 80 * len(a | b)
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert packed == set(kept["secret_scan"])


def test_edge_rows(spark, edge):
    for name in ("_content", "removed", "kept"):
        docs = edge(name)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, ""), "test-edge")
            assert docs.columns == edge(name).columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 1
        empty = edge(name, [])
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, "").count() == 0


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)
    assert rows.count() > 100
