import json
import shutil

from quern.operators.score import length_scorer
from quern.streaming import scoring


def lines(*texts):
    return "".join(json.dumps({"instruction": t, "output": "a b"}) + "\n" for t in texts)


def run(spark, tmp_path, name, change=lambda df: df):
    got = change(scoring.read_stream(spark, f"file://{tmp_path}/in"))
    scored = scoring.score_stream(got, length_scorer()).select("id", "content_id", "length")
    scoring.write_stream(scored, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-state", once=True).awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/{name}")


def test_repeats_stay_and_files_are_read_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(lines("q", "q", "r") + "\nnot json\n")
    got = run(spark, tmp_path, "out")
    assert got.count() == 3 and got.select("id").distinct().count() == 3 and got.select("content_id").distinct().count() == 2
    assert {r["length"] for r in got.collect()} == {2.0} and sorted(r["id"].rpartition("a.jsonl:")[2] for r in got.collect()) == ["1", "2", "3"]
    (folder / "b.jsonl").write_text(lines("q", "s"))
    assert run(spark, tmp_path, "out").count() == 5
    assert run(spark, tmp_path, "out").count() == 5
    shutil.rmtree(tmp_path / "out-state")
    shutil.rmtree(tmp_path / "out")
    assert run(spark, tmp_path, "out").count() == 5
    assert run(spark, tmp_path, "few", scoring.drop_repeats).count() == 3
