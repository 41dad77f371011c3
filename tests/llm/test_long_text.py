"""One text of many megabytes through every operator on documents, whole: what stands at its end is found, and counts are exact."""

import random

import pytest
from pyspark.sql import functions as F

from cases import words
from quern.llm import brown, debruijn, decontam, langid, packing, quality, sigtree

MEGABYTES = 12


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(50_000)]
    passage = " ".join(rnd.choices(vocabulary, k=60))
    lines = [" ".join(rnd.choices(vocabulary, k=60)) for _ in range(MEGABYTES * 3200)]
    return "\n".join([*lines, passage]), passage, " ".join(rnd.choices(vocabulary, k=200))


@pytest.fixture(scope="module")
def docs(spark, texts):
    long, passage, other = texts
    path = f"{spark.conf.get('spark.checkpoint.dir')}/long.parquet"
    spark.createDataFrame([(1, f"{other} {passage}"), (2, long), (3, None), (4, f"{passage} {other}")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_counts_and_scores(docs, texts):
    n = len(words(texts[0]))
    assert len(texts[0]) > MEGABYTES << 20
    got = {r["doc_id"]: r for r in brown.score_documents(docs, F.lit(False)).collect()}
    assert got[2]["n_tokens"] == got[2]["n_known"] == n + 1 and got[2]["score"] < 0 and got[2]["train_tokens"] == n + 1 + 2 * 261 + 1
    got = {r["doc_id"]: r for r in quality.judge(docs, quality.fit(*[__import__("numpy").zeros(s) for s in ((0, len(quality.FEATURES)), 0)], __import__("numpy").zeros(0, "uint64"))).collect()}
    assert got[2]["n_words"] == n and got[2]["n_dup_lines"] == 0 and got[3]["base_failed"]


def test_passages_at_its_end(spark, docs, texts):
    got = {r["doc_id"]: r for r in debruijn.dedup_substrings(docs).collect()}
    n = len(words(texts[0]))
    assert (got[2]["n_words"], got[2]["n_removed"]) == (n, 60) and got[2]["text"] == " ".join(words(texts[0])[:-60])
    assert got[4]["n_removed"] == 260
    bench = spark.createDataFrame([(7, " ".join(texts[1].split()[10:40]))], "item_id long, text string")
    found = {(r["doc_id"], r["start_word"]) for r in decontam.find_passages(docs, bench).collect()}
    assert found == {(1, 210), (2, n - 50), (4, 10)}


def test_sets_ids_and_language(docs, texts):
    got = {r["doc_id"]: r for r in sigtree.jaccard_components(docs, 3).collect()}
    w = words(texts[0], True)
    assert got[2]["n_shingles"] == len(set(zip(w, w[1:], w[2:], strict=False))) and got[1]["component_id"] == 1 and got[4]["component_id"] == 1
    pieces = packing.pack_documents(docs, packing.default_tokenizer(), 2).filter("doc_id = 2").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).first()
    assert pieces["n"] == pieces["t"] > len(w)
    samples = {"aa": (" " + texts[2]).encode(), "bb": b" xylo zzz qwrty"}
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, samples).collect()} == {1: "aa", 2: "aa", 3: "und", 4: "aa"}
