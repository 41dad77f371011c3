"""Every stage with nulls, empty and repeated rows, ties, empty tables, and further columns with clashing names, in documents, labels and benchmark."""

import pytest
from pyspark.sql import functions as F

from cases import CLASHING, documents

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/edges"
    clash = lambda df: df.withColumns({c: F.lit(c) for c in CLASHING if c not in df.columns})
    clash(spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 1), (999, 0, None)], "doc_id long, quality int, toxic int")).withColumn("text", F.lit("t")).write.mode("overwrite").parquet(f"{path}/labels.parquet")
    clash(spark.createDataFrame([(1, "item one of the benchmark with some ten words in it"), (2, None), (3, ""), (None, "another item that has no number of its own at all"), (1, "item one of the benchmark with some ten words in it")], "item_id long, text string")).withColumn("doc_id", F.lit(5)).write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return path


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHING}).repartition(3)


ROWS = [*documents(3), (None, "al1 " * 80), (None, None), (-70, None), (-70, None), (-80, "x"), (-80, "x"), (-90, "item one of the benchmark with some ten words in it")]


@pytest.mark.parametrize("name,stage", pipeline.STAGES[:-1], ids=[n for n, _ in pipeline.STAGES[:-1]])
def test_filtering_stages(spark, folder, name, stage):
    got = stage(spark, frame(spark, ROWS), folder)
    assert got.columns == list(pipeline.COLUMNS)
    kept = [(r["doc_id"], r["text"], r["lang"]) for r in got.collect()]
    given = [(i, t, "en") for i, t in ROWS]
    if name == "repeated_passages":
        assert sorted((str(i), x) for i, _, x in kept) == sorted((str(i), x) for i, _, x in given)
    else:
        assert all(k in given for k in kept) and 0 < len(kept) < len(given)
    if name == "near_duplicates":
        assert sum(i == -80 for i, *_ in kept) == 1 and sum(t is None for _, t, _ in kept) == sum(t is None for _, t in ROWS)
    if name == "benchmark_passages":
        assert len(given) - len(kept) == 1 and all(i != -90 for i, *_ in kept)
    assert stage(spark, frame(spark, ROWS).limit(0), folder).count() == 0


def test_quality_without_labels(spark, folder):
    """Without labels all that the base rules keep stays."""
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.mode("overwrite").parquet(f"{folder}-none/labels.parquet")
    got = pipeline.quality_rules(spark, frame(spark, [(1, " ".join(f"w{i}" for i in range(60))), (2, "few words")]), f"{folder}-none")
    assert [r["doc_id"] for r in got.collect()] == [1]


def test_packing(spark, folder):
    name, stage = pipeline.STAGES[-1]
    got = stage(spark, frame(spark, ROWS), folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.filter("doc_id = -70 AND doc_tokens = 1").count() == 2 and got.filter("doc_id IS NULL").count() >= 2
    assert stage(spark, frame(spark, ROWS).limit(0), folder).count() == 0


def test_whole_run_over_odd_rows(spark, folder):
    frame(spark, ROWS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    rows = pipeline.run(spark, folder).collect()
    assert len({r["doc_id"] for r in rows}) > 3
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.mode("overwrite").parquet(f"{folder}-empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.mode("overwrite").parquet(f"{folder}-empty/{name}.parquet")
    assert pipeline.run(spark, f"{folder}-empty").count() == 0
