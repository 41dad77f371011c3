from cases import frame
from quern.llm import langid


def test_language_with_long_texts_only(spark):
    """Each text of `bb` has over 10 kB, in letters of two bytes too."""
    long = "thus then thém thöse thud " * 600
    rows = [(i, "mano pelo vida casa roja " * 20, "aa") for i in range(20)] + [(100 + i, f"{long} {i}", "bb") for i in range(5)]
    samples = langid.sample_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(samples) == ["aa", "bb"]
    assert 30_000 < len(samples["bb"]) <= langid.SAMPLE_BYTES + 1
    samples["bb"].decode("utf-8")
    got = langid.identify(frame(spark, [(1, "thus those then"), (2, "casa vida")]), samples).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got) == [(1, "bb"), (2, "aa")]
