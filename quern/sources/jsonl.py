"""JSON Lines of chat, instruction and conversation records.

A record becomes (ord long, id string, messages array<struct<role,content>>, text string, metadata map<string,string>,
original string). id is `path:line`, the line counted from 1 with blank lines; ord is the place in the input.
metadata holds strings as they are and other values as JSON.
"""

from __future__ import annotations

import itertools
import json
import lzma
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quern.functions import numtext
from quern.functions.text import message_text
from quern.plans.storage import stash

ROLES = ("system", "user", "assistant", "tool")
SPEAKERS = {"human": "user", "gpt": "assistant"}
#: Key of a record under which scores and decisions stand.
ANNOTATION = "quern"
#: Lines of one file, at most, that ord has room for.
FILE_STEP = 1 << 40
#: Characters of lines whose records are held at once.
_CHARS = 2 << 20

MESSAGES = "array<struct<role:string,content:string>>"
_PARSED = S.StructType(
    [
        S.StructField("messages", S.ArrayType(S.StructType([S.StructField("role", S.StringType()), S.StructField("content", S.StringType())]))),
        S.StructField("metadata", S.MapType(S.StringType(), S.StringType())),
        S.StructField("error", S.StringType()),
    ]
)


def _messages(turns, who: str, what: str) -> list[dict]:
    """Turns as (role, content) objects."""
    whole = isinstance(turns, list) and all(isinstance(t, dict) and isinstance(t.get(who), str) and isinstance(t.get(what), str) for t in turns)
    if not whole or not turns:
        raise ValueError(f"a conversation is a list of one object or more with the strings {who} and {what}")
    out = [{"role": SPEAKERS.get(t[who], t[who]), "content": t[what]} for t in turns]
    if strange := {m["role"] for m in out}.difference(ROLES):
        raise ValueError(f"unknown role {sorted(strange)[0]!r}")
    return out


def _instruction(record: dict) -> list[dict]:
    told = {k: record.get(k, "") for k in ("instruction", "input", "output")}
    if strange := [k for k, v in told.items() if not isinstance(v, str)]:
        raise ValueError(f"{strange[0]} is not a string")
    return [{"role": "user", "content": f"{told['instruction']}\n{told['input']}" if told["input"] else told["instruction"]}, {"role": "assistant", "content": told["output"]}]


#: (keys that tell the format, its messages), the first that fits counts.
FORMATS = (
    ({"messages"}, lambda r: _messages(r["messages"], "role", "content")),
    ({"conversations"}, lambda r: _messages(r["conversations"], "from", "value")),
    ({"instruction", "output"}, _instruction),
)
#: Keys that are not metadata.
_TAKEN = frozenset({"messages", "conversations", ANNOTATION})


def normalise(record) -> tuple[list[dict], dict]:
    """(messages, metadata) of a decoded record; ValueError for what is not understood."""
    found = next((read for keys, read in FORMATS if isinstance(record, dict) and keys <= record.keys()), None)
    if found is None:
        raise ValueError("a record is an object with messages, conversations, or instruction and output")
    metadata = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in record.items() if k not in _TAKEN and v is not None}
    return found(record), metadata


def parse(line: F.Column) -> F.Column:
    """struct(messages, metadata, error) of each line; error is null for a good one."""

    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # The records of some lines at a time, however many come at once.
        for batch in batches:
            for lo, hi in numtext.runs(batch.str.len().fillna(0).to_numpy(np.int64), _CHARS):
                rows = []
                for text in batch.iloc[lo:hi]:
                    try:
                        messages, metadata = normalise(json.loads(text))
                        rows.append((messages, metadata, None))
                    except (ValueError, TypeError, RecursionError) as wrong:
                        rows.append((None, None, str(wrong)))
                yield pd.DataFrame(rows, columns=["messages", "metadata", "error"])

    parsed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(parsed, _PARSED)(line)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line long, value string) of a text file, also .gz, .bz2 and .xz; lines are counted across the splits of a large file.

    Spark numbers the rows of a partition in order; the numbers before each split are added from the counts of the splits.
    """
    if path.endswith(".xz"):
        content = spark.read.format("binaryFile").load(path).select("content")

        def unpack(batches):
            for batch in batches:
                for raw in batch["content"]:
                    lines = re.split(r"\r\n|\n|\r", lzma.decompress(raw).decode("utf-8"))
                    if lines and not lines[-1]:
                        lines.pop()
                    yield pd.DataFrame({"line": range(1, len(lines) + 1), "value": lines})

        return content.mapInPandas(unpack, "line long, value string")
    rows = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    )
    # Rows before each split, by split: a small table for each file, joined by broadcast while Spark finds it small enough.
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("file", "split", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first") + 1).alias("shift"))
    valid = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.lit("invalid UTF-8")).cast("string"))
    return rows.join(shifts, ["file", "split"]).select((F.col("at") + F.col("shift")).cast("long").alias("line"), valid.alias("value"))


def read_jsonl(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """Records of one or more files in the order given; a folder stands for its train.jsonl.

    strict: a bad line raises `path:line: reason` when the records are computed; otherwise it stays as a row with `error`.
    """
    out = None
    for k, path in enumerate([paths] if isinstance(paths, str) else paths):
        lines = read_lines(spark, path).filter(F.col("value").rlike(r"(?U)[^\s\x1c-\x1f]"))
        rows = lines.select("line", F.col("value").alias("original"), parse(F.col("value")).alias("p"))
        place = F.concat(F.lit(path + ":"), F.col("line").cast("string"))
        rows = rows.select(
            (F.lit(k * FILE_STEP) + F.col("line")).cast("long").alias("ord"), place.alias("id"), F.col("p.messages").alias("messages"), F.col("p.metadata").alias("metadata"), "original",
            F.col("p.error").alias("error"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no input files")
    out = out.withColumn("text", message_text(F.col("messages")))
    if not strict:
        return out
    checked = F.when(F.col("error").isNull(), F.col("id")).otherwise(F.raise_error(F.concat_ws(": ", "id", "error")).cast("string"))
    return out.withColumn("id", checked).drop("error")


_OPEN, _CLOSE = np.zeros((2, 256), np.int8)
_OPEN[[ord("["), ord("{")]], _CLOSE[[ord("]"), ord("}")]] = 1, 1


def _levels(data: np.ndarray, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(steps, inside, quoted) of JSON text: brackets outside strings as +1 and -1, which bytes stand in strings, and whether the text ends in one."""
    quotes = np.flatnonzero(data == ord('"'))
    for i in np.flatnonzero(data[quotes - 1] == ord("\\")) if len(quotes) else ():
        at = end = int(quotes[i])
        while at and data[at - 1] == ord("\\"):
            at -= 1
        if (end - at) % 2:
            quotes[i] = -1
    turns = np.zeros(len(data), np.int8)
    turns[quotes[quotes >= 0]] = 1
    inside = (np.cumsum(turns, dtype=np.int64) + quoted) % 2 == 1
    steps = np.where(inside, 0, _OPEN[data] - _CLOSE[data])
    return steps, inside, bool(inside[-1]) if len(data) else quoted


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((file, split), text) of rows (value, file, split, at), which are a file's text cut at commas; a comma stands before each but the file's first."""
    seen = set()
    for batch in batches:
        file, split = batch.column("file"), batch.column("split").to_numpy()
        files = pa.compute.rank(file, tiebreaker="dense").to_numpy()
        cuts = np.flatnonzero((np.diff(files.astype(np.int64)) != 0) | (np.diff(split) != 0)) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            if lo == hi:
                continue
            key = (file[lo].as_py(), int(split[lo]))
            values = batch.column("value").slice(lo, hi - lo).cast(pa.binary()).to_pylist()
            head = b"," if key in seen or key[1] else b""
            seen.add(key)
            yield key, np.frombuffer(head + b",".join(values), np.uint8)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that holds one JSON array; id and ord are the place in it, from 0.

    Spark cuts the text at commas, in as many tasks as the file has splits. A first pass tells for each split whether it ends inside a string and at which
    depth, if it began outside or inside one; with that each split finds the commas between records by itself. Only one row for each split reaches the driver.
    """
    rows = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[str, int], list[int]] = {}
        for key, data in _pieces(batches):
            own = told.setdefault(key, [0, 0, 0])
            flips = own[0]
            for k in (0, 1):
                steps, _, last = _levels(data, bool(flips ^ k))
                own[1 + k] += int(steps.sum())
                if k == 0:
                    own[0] = int(last)
        cells = [(f, s, *own) for (f, s), own in told.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "split", "flips", "outside", "inside"), c, strict=True)) for c in cells], _ENDS)

    start, now, before = {}, (0, 0), None
    for r in [*rows.mapInArrow(ends, "file string, split long, flips long, outside long, inside long").orderBy("file", "split").collect(), None]:
        if before is not None and (r is None or r["file"] != before) and now != (0, 0):
            raise ValueError(f"{before} holds no whole JSON array")
        if r is None:
            break
        quoted, depth = now if r["file"] == before else (0, 0)
        start[r["file"], r["split"]] = (quoted, depth)
        now, before = (quoted ^ r["flips"], depth + r["inside" if quoted else "outside"]), r["file"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts between the brackets of the array and the commas of its level; seq counts them in a split, and open is the last one."""
        open_, state = {}, {}
        for key, data in _pieces(batches):
            quoted, depth, seq = state.get(key) or (*start[key], 0)
            steps, inside, quoted_ = _levels(data, bool(quoted))
            level = depth + np.cumsum(steps, dtype=np.int64)
            at = np.flatnonzero(((data == ord(",")) & ~inside & (level == 1)) | ((steps == 1) & (level == 1)) | ((steps == -1) & (level == 0)))
            if len(at) and np.isin(data[at], (ord("{"), ord("}"))).any():
                raise ValueError(f"{key[0]} holds no JSON array")
            raw, bounds = data.tobytes(), [-1, *at.tolist(), len(data)]
            texts = [raw[i + 1 : j] for i, j in itertools.pairwise(bounds)]
            texts[0] = open_.pop(key, b"") + texts[0]
            open_[key] = texts.pop()
            state[key] = (int(quoted_), int(level[-1]) if len(level) else depth, seq + len(texts))
            if texts:
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array(texts, pa.binary()), pa.array([False] * n)], schema=_CUT)
        for key, text in open_.items():
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([state[key][2]], pa.int64()), pa.array([text], pa.binary()), pa.array([True])], schema=_CUT)

    texts = stash(rows.mapInArrow(cut, "file string, split long, seq long, value binary, open boolean"), "array")
    base, marks, before = [], 0, None
    for r in texts.filter("open").select("file", "split", "seq").orderBy("file", "split").collect():
        marks = marks if r["file"] == before else 0
        base.append((r["file"], r["split"], marks))
        marks, before = marks + r["seq"], r["file"]
    placed = texts.join(F.broadcast(spark.createDataFrame(base, "file string, split long, before long")), ["file", "split"]).select("file", "split", (F.col("before") + F.col("seq")).alias("place"), "value", (F.col("open") | (F.col("seq") == 0)).alias("part"))
    # What goes on in the next split is put together; that is two rows a split.
    joined = placed.filter("part").groupBy("file", "place").agg(F.sort_array(F.collect_list(F.struct("split", "value"))).alias("v"))
    joined = joined.select("file", "place", F.reduce("v", F.lit(b""), lambda a, v: F.concat(a, v["value"])).alias("value"))
    whole = placed.filter("NOT part").select("file", "place", "value").unionByName(joined)
    ends_ = whole.groupBy("file").agg(F.max("place").alias("last"))

    @F.pandas_udf("string")
    def written(value: pd.Series, outer: pd.Series, only: pd.Series) -> pd.Series:
        out = []
        for raw, o, one in zip(value, outer, only, strict=True):
            text = bytes(raw).decode("utf-8")
            if o or (one and not text.strip(" \t\r\n")):
                if text.strip(" \t\r\n"):
                    raise ValueError("there is text beside the JSON array")
                out.append(None)
            else:
                out.append(json.dumps(json.loads(text), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    outer = (F.col("place") == 0) | (F.col("place") == F.col("last"))
    told = whole.join(F.broadcast(ends_), "file").select((F.col("place") - 1).alias("ord"), written("value", outer, F.col("last") == 2).alias("original"))
    rows = told.filter("original IS NOT NULL").withColumn("p", parse(F.col("original")))
    good = F.when(F.col("p.error").isNull(), F.col("ord").cast("string")).otherwise(F.raise_error(F.concat_ws(": ", F.col("ord").cast("string"), "p.error")).cast("string"))
    out = rows.select("ord", good.alias("id"), F.col("p.messages").alias("messages"), F.col("p.metadata").alias("metadata"), "original")
    return out.withColumn("text", message_text(F.col("messages")))


_ENDS = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("split", "flips", "outside", "inside"))])
_CUT = pa.schema([("file", pa.string()), ("split", pa.int64()), ("seq", pa.int64()), ("value", pa.binary()), ("open", pa.bool_())])
_SCORED = S.StructType([S.StructField("scores", S.MapType(S.StringType(), S.DoubleType())), S.StructField("flags", S.ArrayType(S.StringType())), S.StructField("error", S.StringType())])


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < float("inf")


def annotations(block) -> tuple[dict[str, float], list[str]]:
    """(scores, flags) of an annotation; flags belong to the score `ifd` and are dropped without it."""
    match block:
        case {**told}:
            scores, flags = told.get("scores", {}), told.get("flags", [])
        case _:
            raise ValueError("an annotation is an object")
    if not isinstance(scores, dict) or not all(map(_number, scores.values())):
        raise ValueError("scores are an object of finite numbers")
    if not isinstance(flags, list) or not all(isinstance(f, str) for f in flags):
        raise ValueError("flags are a list of strings")
    return {k: float(v) for k, v in scores.items()}, flags if "ifd" in scores else []


def decode_scores(rows: DataFrame) -> DataFrame:
    """Add scores and flags from the annotation in `original`; a malformed one is an error."""

    @F.pandas_udf(_SCORED)
    def decoded(batch: pd.Series) -> pd.DataFrame:
        out = []
        for text in batch:
            try:
                scores, flags = annotations(json.loads(text).get(ANNOTATION, {}))
                out.append((scores, flags, None))
            except ValueError as wrong:
                out.append((None, None, str(wrong)))
        return pd.DataFrame(out, columns=["scores", "flags", "error"])

    read = rows.drop("scores", "flags").withColumn("s", decoded(F.col("original")))
    good = F.when(F.col("s.error").isNull(), F.col("id")).otherwise(F.raise_error(F.concat_ws(": ", "id", "s.error")).cast("string"))
    return read.withColumn("id", good).withColumn("scores", F.col("s.scores")).withColumn("flags", F.col("s.flags")).drop("s")


def read_scored(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return decode_scores(read_jsonl(spark, paths))
