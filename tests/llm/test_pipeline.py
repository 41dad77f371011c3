from cases import words

import corpus_pipeline


def test_stages_on_the_test_tables(spark, data):
    from quern.llm.blocks import stash

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stash(stage(spark, docs, data), name)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            after = docs.count()
            assert after < before or name == "repeated_passages" or name == "benchmark_passages"
            assert docs.select("doc_id").distinct().count() == after
            before = after
        if name == "repeated_passages":
            seen = set()
            for r in docs.orderBy("doc_id").collect():
                assert r["n_chars"] == len(r["text"])
                w = words(r["text"])
                own = {tuple(w[i : i + 60]) for i in range(len(w) - 59)}
                assert not own & seen
                seen |= own
        if name == "benchmark_passages":
            texts = [r["text"] for r in docs.collect()]
            assert not any(b in t for b in bench for t in texts)
    assert docs.count() >= before


def test_stages_by_brute_force(spark, data):
    """Near duplicates and repeated passages of the test tables, against plain Python on what the stage before kept."""
    import test_debruijn
    import test_sigtree

    from quern.llm.blocks import stash

    docs = stash(corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{data}/documents.parquet"), data), "t")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    one = stash(corpus_pipeline.near_duplicates(spark, docs, data), "t")
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in test_sigtree.brute(rows, 5, 80, 100)})
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    cut = corpus_pipeline.repeated_passages(spark, one, data).collect()
    assert sorted((str(r["doc_id"]), " ".join(words(r["text"]))) for r in cut) == [(i, t) for i, t, _, _ in test_debruijn.brute(rows, 20)]
