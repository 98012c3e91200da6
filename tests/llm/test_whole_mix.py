from __future__ import annotations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from siembra.llm.source_mix import mix_sources, mixed

SIZES = {"a": 20_000, "b": 9_000, "c": 900, None: 80, "rare": 1}


def table(spark):
    sources = [s for s, n in SIZES.items() for _ in range(n)]
    return spark.createDataFrame([(k, s, "x") for k, s in enumerate(sources)], "doc_id long, source string, text string")


def test_the_stage_keeps_every_document(spark):
    docs = table(spark)
    got = corpus_pipeline.source_mix(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == list(range(sum(SIZES.values())))


def test_a_rare_source_does_not_end_the_mix(spark):
    for size in (1, 16):
        got = mix_sources(table(spark), block_size=size, period=100).toPandas()
        assert got.mix_slot.notna().all()
        assert got.in_mix.mean() > 0.5
        blocks = got.drop_duplicates(["source", "mix_block"])
        assert blocks.mix_slot.is_unique


def test_the_others_go_on_in_their_proportions(spark):
    got = mix_sources(table(spark), {"a": 6, "b": 3, "c": 1}, block_size=1).toPandas().dropna(subset=["mix_slot"]).sort_values("mix_slot")
    assert len(got) == 29_900
    after = got[got.mix_slot > 9_000]  # c has run out
    a, b = (after.source == "a").cumsum().to_numpy(), (after.source == "b").cumsum().to_numpy()
    assert np.abs(a - 2 * b)[: 2 * 6_000].max() <= 4


def test_sources_without_a_weight_stay_out(spark):
    assert {r["source"] for r in mixed(table(spark), weights={"a": 1, "rare": 1}).select("source").distinct().collect()} == {"a", "rare"}


def test_token_ids_carry_the_place_in_the_mix(spark, tmp_path):
    """The last stage's rows stand as the mix laid them, through written files read in any order; without the mix they stand otherwise."""
    docs = table(spark).withColumn("lang", F.lit("en"))
    slots = {r["doc_id"]: (r["mix_slot"], r["mix_rank"]) for r in mix_sources(docs, block_size=1).collect()}
    want = {k: place for place, k in enumerate(sorted(slots, key=slots.get))}
    corpus_pipeline.source_mix(spark, docs, "").write.option("maxRecordsPerFile", 700).parquet(str(tmp_path / "mix"))
    docs.write.parquet(str(tmp_path / "plain"))
    place = lambda name: {r["doc_id"]: r["mix_place"] for r in corpus_pipeline.token_ids(spark, spark.read.parquet(str(tmp_path / name)), "").collect()}
    assert place("mix") == want
    assert sorted(place("plain").values()) == sorted(want.values()) and place("plain") != want
    held = {r["doc_id"]: r["mix_place"] for r in corpus_pipeline.token_ids(spark, corpus_pipeline.source_mix(spark, docs, "").cache(), "").collect()}
    assert held == want
