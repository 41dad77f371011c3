import collections
import re

import numpy as np
import pyarrow as pa

from cases import WORD, documents, frame, words
from quern.llm import quality


def brute(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_statistics_by_brute_force():
    texts = [t for _, t in documents()] + ["a\nb\na\n", "\n\n", "x # é$ |\nx # é$ |\n x # é$ |", "a b c a b c a b c\r\na", "😀😀 #"]
    base, x = quality.statistics(pa.array(texts), np.zeros(0, np.uint64))
    assert list(zip(*(base[b].tolist() for b in quality.BASE), strict=True)) == [brute(t) for t in texts]
    assert np.isfinite(x).all()


def test_edge_cases(spark):
    rows = documents()
    labels = spark.createDataFrame([(i, 0 if k % 3 else 1, None if k % 2 else 0) for k, (i, _) in enumerate(rows)] + [(None, 1, 1), (rows[0][0], None, None)], "doc_id long, quality int, toxic int")
    forest = quality.train(frame(spark, rows), labels)
    got = quality.judge(frame(spark, [*rows, rows[0]]), forest).collect()
    assert len(got) == len(rows) + 1 and all(not r["kept"] or not r["base_failed"] for r in got)
    assert quality.judge(frame(spark, []), forest).count() == 0
    empty = quality.train(frame(spark, rows), labels.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(frame(spark, rows), empty).collect())


def test_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.standard_normal(600) - x[:, 5] > 0.1).astype(float)
    forest = quality.fit(x, y, np.zeros(0, np.uint64))
    for j, sign in enumerate(quality.FEATURES.values()):
        low, high = x.copy(), x.copy()
        high[:, j] += 0.3
        if sign:
            assert (sign * (forest.score(high) - forest.score(low)) >= -1e-9).all()
    assert ((forest.score(x) > 0) == (y > 0)).mean() > 0.8


def test_accuracy_on_labels(spark, data):
    got = quality.op6_quality_rules(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("NOT base_failed AND toxic = 0").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.9
