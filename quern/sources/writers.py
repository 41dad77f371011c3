"""Scored records, decisions and reports as files."""

from __future__ import annotations

import itertools
import json
import os
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.match import LEVELS, Report
from quern.plans.storage import join_parts, remove_dir, written_in_order
from quern.sources.jsonl import ANNOTATION


def dump(value) -> str:
    """JSON with sorted keys, two spaces and a final line end."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n"


def replace_file(path: str | Path, lines) -> int:
    """Write lines beside the target and move them there when all are written; nothing stays behind on failure."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    count = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as out:
            for line in lines:
                out.write(line)
                count += 1
        os.replace(temporary, path)
    finally:
        Path(temporary).unlink(missing_ok=True)
    return count


def replace_file_by_parts(path: str | Path, rows: DataFrame, *order: Column) -> int:
    """replace_file() with the column `value` in order, a line each, written by the executors and joined as bytes by the driver's JVM; the number of lines."""
    path, spark = Path(path), rows.sparkSession
    path.parent.mkdir(parents=True, exist_ok=True)
    folder = written_in_order(rows, *order)
    count = spark.read.text(folder).count()
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    os.close(handle)
    try:
        join_parts(spark, folder, spark.sparkContext._jvm.java.io.FileOutputStream(temporary))
        os.replace(temporary, path)
    finally:
        Path(temporary).unlink(missing_ok=True)
    remove_dir(spark, folder)
    return count


def annotated(rows: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(ord, value): each original record, keys sorted, with its annotation; records that have no original are written as messages."""
    if decisions is not None:
        rows = rows.join(decisions.select(F.col("example_id").alias("id"), "decision", "reason"), "id", "left")
    else:
        rows = rows.withColumn("decision", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    if "original" not in rows.columns:
        rows = rows.withColumn("original", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def encode(original: pd.Series, messages: pd.Series, note: pd.DataFrame) -> pd.Series:
        out = []
        for raw, turns, i, scores, flags, decision, reason in zip(original, messages, note["id"], note["scores"], note["flags"], note["decision"], note["reason"], strict=True):
            record = json.loads(raw) if raw else {}
            if not record:
                record = {"messages": [{"role": m["role"], "content": m["content"]} for m in turns]}
            block = {"id": i, "scores": dict(scores), "flags": sorted(set(flags))}
            if decision is not None:
                block |= {"example_id": i, "decision": decision, "reason": reason}
            record[ANNOTATION] = block
            out.append(json.dumps(record, ensure_ascii=False, sort_keys=True, allow_nan=False))
        return pd.Series(out)

    note = F.struct("id", "scores", "flags", "decision", "reason")
    return rows.select("ord", encode("original", "messages", note).alias("value"))


def write_scored(path: str | Path, rows: DataFrame, decisions: DataFrame | None = None) -> int:
    """One JSON Lines file in input order, written by the executors in parts; its number of records."""
    return replace_file_by_parts(path, annotated(rows, decisions), F.asc("ord"))


def write_scored_table(path: str, rows: DataFrame, decisions: DataFrame | None = None) -> None:
    """The same records as a folder of part files in input order, written by the executors."""
    annotated(rows, decisions).orderBy("ord").select("value").write.text(path)


def json_array(rows, indent: int = 0):
    """A JSON array of objects in pieces, laid out as dump() does, without holding more than one object; indent: spaces before the array's lines."""
    gap, pad = "[", " " * (indent + 2)
    for row in rows:
        told = json.dumps(row, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False).replace("\n", "\n" + pad)
        yield f"{gap}\n{pad}{told}"
        gap = ","
    yield "[]" if gap == "[" else "\n" + " " * indent + "]"


def write_decisions(path: str | Path, decisions: DataFrame) -> int:
    """A JSON array of every input row's decision in input order, row by row through the driver; their number."""
    rows = decisions.orderBy("ord").select("example_id", "decision", "reason").toLocalIterator(prefetchPartitions=True)
    written = 0

    def counted():
        nonlocal written
        for r in rows:
            written += 1
            yield r.asDict()

    replace_file(path, itertools.chain(json_array(counted()), ["\n"]))
    return written


#: Replacements inside cells of a Markdown table, in turn.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\n", " "), ("`", "&#96;"))


def markdown_cell(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


def markdown_cells(text: Column) -> Column:
    """markdown_cell() of a column."""
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Columns of a hit in reports.
SHOWN = ("train_id", "eval_id", "level", "value", "evidence")


def _hits(report: Report):
    for r in report.ordered().select(*SHOWN).toLocalIterator(prefetchPartitions=True):
        yield r.asDict()


def report_totals(report: Report) -> dict:
    """What a report says beside its hits: record counts, policy, verdict, and the number of hits of each level."""
    return {"train_records": report.train_records, "eval_records": report.eval_records, "fail_on": list(report.fail_on), "ok": report.ok, "levels": report.counts()}


def write_report(path: str | Path, report: Report) -> dict:
    """The report as JSON, hit by hit through the driver; report_totals()."""
    totals = report_totals(report)
    told = {k: json.dumps(totals[k], indent=2).replace("\n", "\n  ") for k in ("eval_records", "fail_on", "ok", "train_records")}
    head = f'{{\n  "eval_records": {told["eval_records"]},\n  "fail_on": {told["fail_on"]},\n  "hits": '
    tail = f',\n  "ok": {told["ok"]},\n  "train_records": {told["train_records"]}\n}}\n'
    replace_file(path, itertools.chain([head], json_array(_hits(report), 2), [tail]))
    return totals


def summary(totals: dict) -> str:
    """One line: verdict, record counts, hits of each level."""
    counts = ", ".join(f"{level}={totals['levels'][level]}" for level in LEVELS)
    return f"{'PASS' if totals['ok'] else 'FAIL'}: train={totals['train_records']}, eval={totals['eval_records']}; {counts}"


def markdown_lines(totals: dict, hits):
    """The report as Markdown, in pieces."""
    yield f"# Contamination audit\n\n{summary(totals)}\n\n| Train | Evaluation | Level | Similarity | Evidence |\n| --- | --- | --- | --- | --- |\n"
    for h in hits:
        yield "| " + " | ".join(markdown_cell(str(h[c])) for c in SHOWN) + " |\n"


def write_markdown(path: str | Path, report: Report, totals: dict | None = None) -> None:
    replace_file(path, markdown_lines(totals or report_totals(report), _hits(report)))


def markdown(report: Report, totals: dict | None = None) -> str:
    return "".join(markdown_lines(totals or report_totals(report), _hits(report)))
