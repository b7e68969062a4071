"""The stages of the pipeline, one after the other, each against its operator's rule."""

import corpus_pipeline
from mendral.llm import common, exact_dedup, jaccard_join, sentencepiece_lattice


def test_stages(spark, sf, tmp_path):
    docs = common.documents(spark, sf)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "jaccard_join", "source_mixing", "sentencepiece"]
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            assert after.columns == docs.columns
            assert after.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        before = after
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    first = exact_dedup.deduplicate(kept["language_id"]).where("kept")
    assert ids(first) == ids(kept["exact_dedup"])
    assert ids(jaccard_join.jaccard_components(kept["exact_dedup"], jaccard_join.NEAR_COPIES).where("doc_id = component_id")) == ids(kept["jaccard_join"])
    assert ids(kept["source_mixing"]) == ids(kept["jaccard_join"])
    p = sentencepiece_lattice.load()
    for r in kept["sentencepiece"].join(docs.select("doc_id", "text"), "doc_id").limit(50).collect():
        assert r["n_tokens"] == len(r["ids"]) and sentencepiece_lattice.decode(p, r["ids"]) == r["text"].replace("▁", " ")


def test_run_gives_what_the_stages_give(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copies_by_five_words_go(spark, sf):
    w = [f"w{i}" for i in range(100)]
    # 96 shingles of 5 words, 9 of them changed: 87 / 105 = 0.829; of 3 words 98, 6 of them changed: 92 / 104 = 0.885
    copy = [*w[:20], "x", *w[21:60], *w[60:96], "y", *w[97:]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate([w, copy, w[:40]])], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == {0, 2}
