"""The corpus pipeline, stage by stage, against brute force."""
import re

import corpus_pipeline
from matchsmith.llm import queries, quality, stages
from tests.llm.test_documents import brute_join

SECRET = re.compile(r'((?i:token) = ")[0-9a-fA-F]{40}(?=")')


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = stages.quality_rules(spark, docs, small).cache()
    assert kept.columns == docs.columns
    verdict = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: texts[i] for i in verdict}
    single = stages.near_duplicates(spark, kept, small).cache()
    assert single.columns == docs.columns
    classes = brute_join({i: texts[i] for i in verdict})
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for c, _ in classes.values()})
    masked = stages.secret_scans_stage(spark, single, small).cache()
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert r["text"] == SECRET.sub(r"\1[SECRET]", texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    packed = stages.best_fit_packing(spark, masked, small)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in masked.collect()}


def test_run_is_the_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).toPandas()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert rows.groupby("sequence_id")["length"].sum().max() <= 4096 and corpus_pipeline.ORACLE_SQL is None


def test_stages_of_awkward_rows(spark, awkward, no_documents):
    for docs in (awkward, no_documents.selectExpr("*", "'x' as ids", "1 as component")):
        for stage in (stages.quality_rules, stages.near_duplicates, stages.secret_scans_stage):
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.collect()
        stages.best_fit_packing(spark, docs, "").collect()
    single = stages.near_duplicates(spark, awkward, "").collect()
    assert sorted(r["doc_id"] or 0 for r in single) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]


def test_texts_that_share_an_id_both_stay(spark):
    """Two texts under one id are two documents: both leave the stage unless they are copies."""
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(1, words("a")), (1, words("b")), (2, words("a") + " end"), (3, None), (3, ""), (3, words("c")), (4, words("d")), (4, words("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"] or "") for r in stages.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(1, words("a")), (1, words("b")), (3, ""), (3, words("c")), (4, words("d"))])


def test_registered():
    assert len([q for q in queries.QUERIES if re.match(r"op\d+_", q)]) == 13
