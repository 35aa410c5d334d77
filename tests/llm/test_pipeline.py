import corpus_pipeline
from panelforge.llm import fm_index, quality, simhash


def held(spark, df):
    return spark.createDataFrame(df.collect(), schema=df.schema)


def test_stages_against_their_parts(spark, sf):
    """Every stage's decisions take effect on all rows of the one before it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, out, kept = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out[name] = kept = held(spark, stage(spark, kept, sf))
        assert name == "sharding" or kept.columns == names
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    scored = {r.doc_id: r.predicted for r in quality.rank_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(ids(out["quality"])) == sorted(i for i, p in scored.items() if p)
    assert sorted(ids(out["simhash_dedup"])) == sorted(ids(simhash.keep_unlike(out["quality"])))
    assert len(set(ids(out["simhash_dedup"]))) == out["simhash_dedup"].count()
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    before = {r.doc_id: r.text for r in out["simhash_dedup"].collect()}
    hit = {r.doc_id for r in fm_index.contamination(out["simhash_dedup"], items).filter("size(hit_spans) > 0").collect()}
    after = {r.doc_id: r for r in out["decontamination"].collect()}
    assert all(after[i].text == t for i, t in before.items() if i not in hit)
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert fm_index.contamination(out["decontamination"], items).filter("size(hit_spans) > 0").count() == 0
    mixed = ids(out["mixing"])
    assert max(mixed.count(i) for i in set(mixed)) <= 3 and sorted(ids(out["sharding"])) == sorted(mixed)


def test_empty_and_awkward(spark, sf, awkward, empty):
    for docs in (awkward, empty):
        kept = docs
        for _, stage in corpus_pipeline.STAGES:
            kept = held(spark, stage(spark, kept, sf))
        assert kept.count() >= 0
