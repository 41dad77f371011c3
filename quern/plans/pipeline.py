"""Score, select and check in one run, with files and a manifest."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quern.operators import match, models, score, select
from quern.operators.match import Matcher, Report, check
from quern.operators.score import Scorer, score_rows
from quern.operators.select import Selector, select_rows
from quern.plans.provenance import Manifest, context_hash, find_parent, protect, record_manifest
from quern.plans.storage import stash
from quern.sources.jsonl import read_jsonl, read_scored
from quern.sources.writers import write_markdown, write_report, write_scored

#: Files of a run.
FILES = {"scored": "scored.jsonl", "selected": "selected.jsonl", "report": "contamination.json", "markdown": "report.md", "manifest": "manifest.json"}


@dataclass
class Result:
    scored: DataFrame
    decisions: DataFrame
    selected: DataFrame
    report: Report
    manifest: Manifest | None = None


def records(spark: SparkSession, source) -> DataFrame:
    """A DataFrame as it is, or the records of files; a folder stands for its train.jsonl."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, (str, Path)):
        source = [str(source)]
    return read_jsonl(spark, [str(Path(p) / "train.jsonl") if Path(p).is_dir() else str(p) for p in source])


def check_contamination(spark, train, evaluation, matchers: tuple[Matcher, ...] | None = None, fail_on=("EXACT", "NEAR")) -> Report:
    return check(records(spark, train), records(spark, evaluation), matchers, tuple(fail_on))


def score_dataset(spark, source, scorers: tuple[Scorer, ...]) -> DataFrame:
    return score_rows(records(spark, source), scorers)


def select_subset(spark, source, selector: Selector, keep: int | float) -> tuple[DataFrame, DataFrame]:
    """(kept rows, decisions of all rows) of a scored DataFrame or file."""
    rows = source if isinstance(source, DataFrame) else read_scored(spark, str(source))
    decisions = stash(select_rows(rows, selector, keep), "decisions")
    return rows.join(decisions.filter("decision = 'KEEP'").select("ord"), "ord", "left_semi"), decisions


def process(spark, rows: DataFrame, evaluation: DataFrame | None, scorers, selector: Selector, keep, matchers=None) -> Result:
    """Score all rows, select, then check the selected ones against the evaluation set."""
    scored = stash(score_rows(rows, tuple(scorers)), "scored")
    selected, decisions = select_subset(spark, scored, selector, keep)
    if evaluation is None:
        evaluation = rows.limit(0)
    return Result(scored, decisions, selected, check(selected, evaluation, matchers))


def evaluation_records(spark, sources) -> tuple[DataFrame | None, list[Path] | None]:
    """The evaluation records of a DataFrame, or of files and DataFrames one after another; and the files, None unless there are only files."""
    if isinstance(sources, (DataFrame, str, Path)):
        sources = [sources]
    sources, out = list(sources), None
    for k, one in enumerate(sources):
        rows = records(spark, one)
        shift = rows.withColumn("ord", rows["ord"] + k * (1 << 50)).select("ord", "id", "text")
        out = shift if out is None else out.unionByName(shift)
    return out, None if any(isinstance(s, DataFrame) for s in sources) else [Path(s) for s in sources]


def run(
    spark, source, out_dir: str | Path | None = None, evaluation=(), scorers: tuple[Scorer, ...] | None = None, selector: Selector | None = None, keep: int | float = 0.2,
    matchers: tuple[Matcher, ...] | None = None, seed: int = 42, parameters: dict | None = None,
) -> Result:
    """process() over files, writing scored.jsonl, selected.jsonl, contamination.json and report.md into out_dir, and manifest.json if all sources are files.

    Without scorers records get lengths and IFD by the bundled model, without a selector the best by IFD stay; without out_dir nothing is written.
    seed is recorded; ties are broken by input order. parameters: more to record of the steps `score`, `select` and `check`.
    """
    scorers = (score.length_scorer(), score.ifd_scorer(models.bundled())) if scorers is None else tuple(scorers)
    selector = selector or select.top_k_selector()
    matchers = (match.ngram_matcher(), match.minhash_matcher()) if matchers is None else tuple(matchers)
    path = None if isinstance(source, DataFrame) else Path(source) / "train.jsonl" if Path(source).is_dir() else Path(source)
    asked, evals = evaluation_records(spark, evaluation)
    parent = find_parent(path) if path else None
    files = {} if out_dir is None else {role: Path(out_dir) / name for role, name in FILES.items()}
    protect(files.values(), [path, parent, *(evals or [])])
    rows = stash(records(spark, source if path is None else str(path)), "records")
    result = process(spark, rows, asked, scorers, selector, keep, matchers)
    if not files:
        return result
    n = write_scored(files["scored"], result.scored, result.decisions)
    kept = write_scored(files["selected"], result.selected, result.decisions)
    totals = write_report(files["report"], result.report)
    write_markdown(files["markdown"], result.report, totals)
    if path is None or evals is None:
        return result
    told, hits = parameters or {}, sum(totals["levels"].values())
    steps = [
        {"name": "score", "scorers": [s.name for s in scorers], "prompt_sha256": context_hash(rows), "out": n, **told.get("score", {})},
        {"name": "select", "selector": selector.name, "keep": keep, "seed": seed, "tie_break": "input_order", "in": n, "out": kept, **told.get("select", {})},
        {"name": "check", "matchers": [m.name for m in matchers], "hits": hits, "scope": "selected", "fail_on": totals["fail_on"], **told.get("check", {})},
    ]
    inputs, sets = [(path, n)], [(p, records(spark, str(p)).count()) for p in evals]
    outputs = [(files["scored"], n), (files["selected"], kept), (files["report"], hits), (files["markdown"], None)]
    return replace(result, manifest=record_manifest(files["manifest"], inputs, sets, steps, outputs, parent))
