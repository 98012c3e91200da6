from __future__ import annotations

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_text_operators import near_expected


def test_stages_against_brute_force(spark):
    folder = str(DATA)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, folder).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        kept[name] = (before, docs)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    before, after = map(rows, kept["exact dedup"])
    assert set(after) == {max(i for i, t in before.items() if t == text) for text in set(before.values())}
    before, after = map(rows, kept["n-gram Jaccard join"])
    assert set(after) == {c for _, c, _ in near_expected(list(before.items()))}
    before, after = map(rows, kept["quality classifier"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    known = [i for i in before if i in labels]
    assert sum((i in after) == (labels[i] == 1) for i in known) > 0.9 * len(known)
    before, after = map(rows, kept["source mix"])
    assert set(after) <= set(before)
    before, after = kept["SentencePiece"]
    assert after.count() == before.count()
    assert after.where("not round_trip").count() == 0


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, str(DATA))
    assert {"doc_id", "ids", "n_tokens"} <= set(got.columns)
    assert got.count() > 0
