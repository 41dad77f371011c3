import bz2
import gzip
import hashlib
import json
import lzma

import pytest

from quern import cli
from quern.plans import provenance
from quern.sources import jsonl, writers

GOOD = [
    {"messages": [{"role": "user", "content": "hello\nworld"}, {"role": "assistant", "content": "ok"}]},
    {"instruction": "hello", "input": "world", "output": "ok"},
    {"conversations": [{"from": "human", "value": "hello\nworld"}, {"from": "gpt", "value": "ok"}], "source": "s"},
]
BAD = [
    [], {}, {"messages": []}, {"messages": "x"}, {"messages": [1]}, {"messages": [{"role": "other", "content": "x"}]}, {"messages": [{"role": "user", "content": []}]},
    {"instruction": 1, "output": "x"}, {"instruction": "x", "input": None, "output": "y"}, {"instruction": "x", "output": None},
]


def test_formats(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(["", *map(json.dumps, GOOD)]) + "\n \n")
    got = jsonl.read_jsonl(spark, str(path)).orderBy("ord").collect()
    assert [r["text"] for r in got] == ["hello\nworld\nok"] * 3 and [r["id"] for r in got] == [f"{path}:{i}" for i in (2, 3, 4)]
    assert got[2]["metadata"] == {"source": "s"} and got[1]["metadata"]["instruction"] == "hello"


@pytest.mark.parametrize("record", BAD, ids=range(len(BAD)))
def test_rejects(record):
    with pytest.raises(ValueError):
        jsonl.normalise(record)


def test_bad_line_is_named(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text(json.dumps(GOOD[0]) + "\n{\n")
    with pytest.raises(Exception, match="bad.jsonl:2:"):
        jsonl.read_jsonl(spark, str(path)).collect()


@pytest.mark.parametrize("suffix,opener", [(".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)])
def test_codecs_and_line_numbers(spark, tmp_path, suffix, opener):
    path = tmp_path / f"a.jsonl{suffix}"
    with opener(path, "wt", encoding="utf-8") as f:
        f.write("\n" + json.dumps(GOOD[0]) + "\n")
    assert [r["id"] for r in jsonl.read_jsonl(spark, str(path)).collect()] == [f"{path}:2"]


def test_lines_are_counted_across_splits(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    path.write_text("".join(json.dumps({"instruction": f"q{i}", "output": "x" * 50}) + "\n" for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = jsonl.read_jsonl(spark, str(path))
        assert got.rdd.getNumPartitions() > 1
        assert all(r["id"].endswith(":" + r["text"].split("\n")[0][1:]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("block", [[], {"scores": []}, {"scores": {"ifd": None}}, {"scores": {"ifd": True}}, {"flags": "bad"}])
def test_bad_annotations(block):
    with pytest.raises(ValueError):
        jsonl.annotations(block)


def test_failed_write_leaves_nothing(tmp_path):
    target = tmp_path / "out.jsonl"
    target.write_text("old")

    def lines():
        yield "a"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writers.replace_file(target, lines())
    assert target.read_text() == "old" and len(list(tmp_path.iterdir())) == 1


def test_markdown_is_escaped():
    hit = {"train_id": "a|b", "eval_id": "<", "level": "EXACT", "value": 1.0, "evidence": "x\n`y` & z"}
    totals = {"train_records": 1, "eval_records": 1, "fail_on": ["EXACT"], "ok": False, "levels": {"EXACT": 1, "NEAR": 0, "SEMANTIC": 0}}
    text = "".join(writers.markdown_lines(totals, [hit]))
    assert "| a\\|b | &lt; | EXACT | 1.0 | x &#96;y&#96; &amp; z |" in text and "FAIL: train=1, eval=1; EXACT=1, NEAR=0, SEMANTIC=0" in text


@pytest.mark.parametrize("rows", [[], [{"b": 1, "a": "é\n"}], [{"a": [1, {"c": None}]}, {"a": []}]])
def test_arrays_are_laid_out_as_whole_documents(rows):
    assert "".join(writers.json_array(iter(rows))) + "\n" == writers.dump(rows)
    told = "".join(writers.json_array(iter(rows), 2))
    assert '{\n  "hits": ' + told + "\n}\n" == writers.dump({"hits": rows})


def test_report_files(spark, tmp_path):
    from quern.operators import match

    schema = "ord long, id string, text string"
    train, evals = spark.createDataFrame([(0, "t0", "a b c d"), (1, "t1", "x")], schema), spark.createDataFrame([(0, "e0", "a b c d"), (1, "e1", "b c")], schema)
    report = match.check(train, evals, (match.ngram_matcher(2),), ())
    totals = writers.write_report(tmp_path / "r.json", report)
    data = json.loads((tmp_path / "r.json").read_text())
    assert (tmp_path / "r.json").read_text() == writers.dump(data)
    assert data == {"hits": [{"train_id": "t0", "eval_id": e, "level": "EXACT", "value": 1.0, "evidence": g} for e, g in (("e0", "a b"), ("e1", "b c"))], "train_records": 2, "eval_records": 2, "fail_on": [], "ok": True}
    assert writers.summary(totals) == "PASS: train=2, eval=2; EXACT=2, NEAR=0, SEMANTIC=0"
    writers.write_markdown(tmp_path / "r.md", report, totals)
    assert (tmp_path / "r.md").read_text() == writers.markdown(report) and (tmp_path / "r.md").read_text().count("\n") == 8


def test_check_command(spark, tmp_path, capsys):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    train, evals = tmp_path / "train.jsonl", tmp_path / "valid.jsonl"
    train.write_text(json.dumps({"messages": [{"role": "user", "content": words}]}) + "\n" + json.dumps(GOOD[1]) + "\n")
    evals.write_text(json.dumps({"conversations": [{"from": "human", "value": words}]}) + "\n")
    out = tmp_path / "out"
    assert cli.main(["check", str(train), "--eval", str(evals), "-o", str(out)], spark) == 1
    data = json.loads((out / "contamination.json").read_text())
    assert [(h["level"], h["value"], h["evidence"]) for h in data["hits"]] == [("EXACT", 1.0, words), ("NEAR", 1.0, "eight nine ten eleven twelve")]
    assert (data["train_records"], data["eval_records"], data["ok"]) == (2, 1, False)
    assert provenance.verify_manifest(out / "manifest.json").ok and "FAIL" in capsys.readouterr().out
    assert cli.main(["check", str(train), "--eval", str(evals), "-o", str(out), "--fail-on", "SEMANTIC"], spark) == 2
    train.write_text("changed")
    assert cli.main(["explain", str(out / "manifest.json")], spark) == 1


def test_score_select_and_reuse(spark, tmp_path, capsys):
    source = tmp_path / "train.jsonl"
    source.write_text("".join(json.dumps({"instruction": f"q {i}", "output": "word " * (i + 1), "source": "s"}) + "\n" for i in range(4)))
    scored, chosen = tmp_path / "scored.jsonl", tmp_path / "sel" / "selected.jsonl"
    assert cli.main(["score", str(tmp_path), "-o", str(scored), "--scorer", "ifd", "--provider", "fixed"], spark) == 0
    line = json.loads(scored.read_text().splitlines()[0])
    assert line[jsonl.ANNOTATION]["scores"]["ifd"] == 0.5 and line["source"] == "s"
    args = ["--by", "length", "--keep", "0.5"]
    assert cli.main(["select", str(scored), "-o", str(chosen.parent), *args], spark) == 0
    notes = [json.loads(x)[jsonl.ANNOTATION] for x in chosen.read_text().splitlines()]
    assert [n["decision"] for n in notes] == ["KEEP", "KEEP"] and len(json.loads(chosen.with_name("selected.decisions.json").read_text())) == 4
    again = tmp_path / "again"
    assert cli.main(["select", str(chosen), "-o", str(again), *args], spark) == 0
    assert "reused 2" in capsys.readouterr().out and (again / "selected.jsonl").read_bytes() == chosen.read_bytes()
    assert cli.main(["select", str(chosen), "-o", str(tmp_path / "third"), "--reselect", *args], spark) == 0
    assert len((tmp_path / "third" / "selected.jsonl").read_text().splitlines()) == 1
    assert cli.main(["select", str(scored), "-o", str(scored), *args], spark) == 2


def test_run_command(spark, tmp_path):
    source, evals = tmp_path / "train.jsonl", tmp_path / "e.jsonl"
    source.write_text("".join(json.dumps({"instruction": f"q{i}", "output": "word " * (i + 1)}) + "\n" for i in range(5)))
    evals.write_text(json.dumps({"instruction": "other", "output": "thing"}) + "\n")
    out = tmp_path / "run"
    assert cli.main(["run", str(source), "-o", str(out), "--scorer", "length", "--by", "length", "--keep", "2", "--eval", str(evals)], spark) == 0
    assert sorted(p.name for p in out.iterdir()) == ["contamination.json", "manifest.json", "report.md", "scored.jsonl", "selected.jsonl"]
    assert provenance.verify_manifest(out / "manifest.json").ok
    scored = [json.loads(x)[jsonl.ANNOTATION] for x in (out / "scored.jsonl").read_text().splitlines()]
    assert [(n["decision"], n["reason"]) for n in scored] == [("DROP", "budget")] * 3 + [("KEEP", "selected")] * 2
    steps = json.loads((out / "manifest.json").read_text())["steps"]
    assert {k: steps[1][k] for k in ("in", "out", "seed", "tie_break")} == {"in": 5, "out": 2, "seed": 42, "tie_break": "input_order"}
    assert steps[2]["matchers"] == ["ngram", "minhash"] and steps[2]["scope"] == "selected"
    want = json.dumps([[{"role": "user", "content": f"q{i}"}] for i in range(5)], sort_keys=True)
    assert steps[0]["prompt_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_run_without_files(spark, tmp_path):
    """In-memory records give no manifest, no folder no files; without scorers the bundled model is asked for."""
    from quern.operators import score, select
    from quern.plans import pipeline

    source = tmp_path / "train.jsonl"
    source.write_text("".join(json.dumps({"instruction": f"q{i}", "output": "word " * (i + 1)}) + "\n" for i in range(4)))
    evals = tmp_path / "e.jsonl"
    evals.write_text(json.dumps({"instruction": "q3", "output": "word word"}) + "\n")
    before = sorted(p.name for p in tmp_path.iterdir())
    lengths, longest = (score.length_scorer(),), select.top_k_selector("length")
    got = pipeline.run(spark, tmp_path, evaluation=[evals], scorers=lengths, selector=longest, keep=0.5)
    assert got.manifest is None and got.selected.count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == before
    rows = jsonl.read_jsonl(spark, str(source))
    assert pipeline.run(spark, rows, tmp_path / "mem", scorers=lengths, selector=longest).manifest is None
    assert sorted(p.name for p in (tmp_path / "mem").iterdir()) == ["contamination.json", "report.md", "scored.jsonl", "selected.jsonl"]
    two = pipeline.run(spark, source, tmp_path / "two", evaluation=[evals, rows], scorers=lengths, selector=longest)
    assert two.report.eval_records == 5 and two.manifest is None
    with pytest.raises(ValueError, match="bundled model"):
        pipeline.run(spark, source, tmp_path / "none")
    with pytest.raises(ValueError, match="would be overwritten"):
        pipeline.run(spark, tmp_path / "two" / "scored.jsonl", tmp_path / "two", scorers=lengths, selector=longest)


def test_several_inputs(spark, tmp_path):
    """Training files follow one another, and so do evaluation files; ids tell them apart."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    for name, text in (("a", "other"), ("b", words), ("v", "none"), ("w", words)):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": text}]}) + "\n")
    a, b, v, w = (str(tmp_path / f"{n}.jsonl") for n in "abvw")
    assert cli.main(["check", a, b, "--eval", v, "--eval", w, "-o", str(tmp_path / "out"), "--fail-on"], spark) == 0
    data = json.loads((tmp_path / "out" / "contamination.json").read_text())
    assert (data["train_records"], data["eval_records"]) == (2, 2) and {(h["train_id"], h["eval_id"]) for h in data["hits"]} == {(f"{b}:1", f"{w}:1")}
    assert cli.main(["check", a, a, "--eval", v, "-o", str(tmp_path / "out")], spark) == 2


def test_parent_manifests(spark, tmp_path):
    source, evals = tmp_path / "train.jsonl", tmp_path / "e.jsonl"
    source.write_text(json.dumps(GOOD[0]) + "\n")
    evals.write_text(json.dumps(GOOD[1]) + "\n")
    (tmp_path / "manifest.json").write_text('{"other_version": "0.1"}')
    assert cli.main(["check", str(source), "--eval", str(evals), "-o", str(tmp_path / "out"), "--fail-on"], spark) == 0
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["parent"]["path"] == str(tmp_path / "manifest.json")
    (tmp_path / "manifest.json").write_text("{}  ")
    told = provenance.verify_manifest(tmp_path / "out" / "manifest.json")
    assert not told.ok and told.errors == (f"hash mismatch: {tmp_path / 'manifest.json'}",)
    (tmp_path / "manifest.json").unlink()
    assert provenance.verify_manifest(tmp_path / "out" / "manifest.json").errors == (f"unreadable: {tmp_path / 'manifest.json'}",)
    assert "FAIL" in provenance.explain_manifest(tmp_path / "out" / "manifest.json")
    (tmp_path / "manifest.json").write_text("[]")
    assert cli.main(["check", str(source), "--eval", str(evals), "-o", str(tmp_path / "out2")], spark) == 2


def test_relative_paths_of_a_manifest(tmp_path):
    (tmp_path / "x").write_text("x")
    entry = {"path": "x", "sha256": provenance.file_sha256(tmp_path / "x")}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"inputs": [entry], "eval_sets": [], "outputs": [], "path_base": "manifest"}))
    assert provenance.verify_manifest(path).ok
    for broken in ({"inputs": [], "outputs": []}, {"inputs": [{"path": "x"}], "eval_sets": [], "outputs": []}):
        path.write_text(json.dumps(broken))
        with pytest.raises(ValueError):
            provenance.verify_manifest(path)


def test_digests_by_executors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc" * 1000)
    got = provenance.digests(spark, [f"file://{tmp_path}/a.bin"]).first()
    assert got["sha256"] == provenance.file_sha256(tmp_path / "a.bin")


def test_malformed_manifest(tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text("[]")
    with pytest.raises(ValueError):
        provenance.verify_manifest(path)


def test_json_array_is_cut_anywhere(spark, tmp_path):
    """Strings with brackets, quotes, commas and backslashes, nested values, space, and records longer than a split."""
    texts = ['a, "b" [c] {d}', "\\", 'x\\"],[', "é" * 700, "", ",,,", '"', '\\\\"']
    records = [{"messages": [{"role": "user", "content": texts[i % 8]}, {"role": "assistant", "content": f"{i}"}], "n": [i, {"k": [",", i]}]} for i in range(300)]
    path = tmp_path / "array.json"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, rows, dump in (("3000", records, {"indent": 1}), ("200", records[:7], {"ensure_ascii": False}), (before, records[:1], {}), (before, [], {})):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            path.write_text(" \n" + json.dumps(rows, **dump) + "\n", encoding="utf-8")
            got = jsonl.read_json_array(spark, str(path)).orderBy("ord").collect()
            assert [json.loads(r["original"]) for r in got] == rows and [r["id"] for r in got] == [str(i) for i in range(len(rows))]
        for wrong in ('[{"a": 1}', "[1] 2", '{"a": 1, "b": 2}'):
            path.write_text(wrong)
            with pytest.raises(Exception):
                jsonl.read_json_array(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_array_keeps_the_order_of_many_parts(spark, tmp_path):
    """The table's rows come in several partitions, and the last is ready first."""
    from quern.plans import catalog

    (tmp_path / "conversations.parquet").mkdir()
    rows = spark.range(0, 6000, numPartitions=12).selectExpr("5999 - id AS conv_id", "0L AS turn", "'user' AS role", "repeat('x', 50) AS text")
    rows.write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = catalog.json_array(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 6000 and all(r["id"] == r["conv_id"] and r["n_messages"] == 1 for r in got)


def test_no_record_comes_to_the_driver(spark, tmp_path, data, monkeypatch):
    """Files of records are written by the executors and joined as bytes."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from quern.plans import catalog

    rows = spark.range(1000).repartition(7).select((999 - F.col("id")).alias("ord"), F.concat(F.lit("é"), 999 - F.col("id")).alias("value"))
    assert writers.replace_file_by_parts(tmp_path / "a" / "f.txt", rows, F.asc("ord")) == 1000
    assert (tmp_path / "a" / "f.txt").read_text(encoding="utf-8") == "".join(f"é{k}\n" for k in range(1000)) and len(list((tmp_path / "a").iterdir())) == 1
    assert writers.replace_file_by_parts(tmp_path / "none.txt", rows.limit(0), F.asc("ord")) == 0 and (tmp_path / "none.txt").read_bytes() == b""
    messages = [[("user", "é\n"), ("assistant", "a")], [("user", "b")], [("user", "c, "), ("assistant", "d"), ("user", "e")]]
    asked = spark.createDataFrame([(2 - i, m) for i, m in enumerate(messages)], f"ord long, messages {jsonl.MESSAGES}")
    for some in (asked, asked.limit(0)):
        told = [[{"content": c, "role": r} for r, c in row["messages"][:-1]] for row in some.orderBy("ord").collect()]
        assert provenance.context_hash(some) == hashlib.sha256(json.dumps(told).encode()).hexdigest()

    def refuse(self, *args, **kwargs):
        raise AssertionError("rows come to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    assert catalog.folder_source(spark, data).count() > 0
