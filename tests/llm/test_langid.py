import random

import pyarrow as pa

from cases import frame
from quern.llm import langid

SAMPLES = {"aa": b" mano pelo vida casa roja mano vida pelo", "bb": b" thus then that them this those thud", "cc": b" xx yy zz xyz yzx"}


def phrases(text, sample):
    """Greedy longest matches of the whole text."""
    data, _ = langid.normalise(pa.array([text]))
    raw, n, current = data.tobytes(), 0, b""
    for c in raw:
        if current + bytes([c]) in sample:
            current += bytes([c])
        else:
            n += 1
            current = bytes([c]) if bytes([c]) in sample else b""
    return n + (len(raw) > 0)


def test_phrases_by_brute_force():
    parser = langid.Parser(SAMPLES)
    texts = ["mano that xyz", "Casa-ROJA 12 thus", "", None, "x" * 500, "été mano", "then this mano vida " * 40]
    got, _ = parser.phrases(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [phrases(t or "", SAMPLES[k]) for k in parser.langs]


def test_phrases_go_on_over_run_borders():
    """Texts that are one long phrase, that never meet the parse of their runs, or are random, in runs of a few bytes."""
    rnd = random.Random(5)
    samples = {"aa": b" ab" + b"ab" * 300, "bb": b" aa b", "cc": bytes(rnd.choice(b"abc ") for _ in range(200))}
    parser = langid.Parser(samples)
    texts = ["ab" * 250, "a" * 501, "a" * 700 + "b" + "ab" * 90, "ba" * 400] + ["".join(rnd.choice("abc d") for _ in range(rnd.randrange(1, 900))) for _ in range(60)]
    for run in (3, 7, 192):
        before, langid.RUN = langid.RUN, run
        try:
            got, _ = parser.phrases(pa.array(texts))
        finally:
            langid.RUN = before
        assert got.tolist() == [[phrases(t, samples[k]) for k in parser.langs] for t in texts]


def test_edge_cases(spark):
    rows = [(1, "vida roja casa"), (2, None), (3, ""), (4, "12 -- !"), (5, "×÷"), (6, "中"), (None, "those them"), (1, "vida roja casa")]
    got = langid.identify(frame(spark, rows), SAMPLES).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got if r["doc_id"] != 6) == sorted([("1", "aa"), ("1", "aa"), ("2", "und"), ("3", "und"), ("4", "und"), ("5", "und"), ("None", "bb")])
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(frame(spark, rows), {}).collect()} == {"und"}
    assert langid.identify(frame(spark, []), SAMPLES).count() == 0
    assert langid.sample_texts(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_held_out_accuracy(spark, data):
    got = langid.op10_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
