"""Records that keep coming: parse and score JSON Lines as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import message_text
from quern.operators.score import Scorer
from quern.sources.jsonl import parse


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records of new files in a folder: (id, content_id, seen_at, original, messages, metadata, error, text).

    id is `path:line`, and `path:start of the split:line in it` in later splits of a large file. Records that stand twice are two records, as in
    a file that is read at once. content_id is the SHA-256 of the record, seen_at the time its file was written. Bad lines have `error`.
    """
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_modification_time").alias("seen_at"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: dict[tuple, int] = {}
        for batch in batches:
            line = batch.groupby(["file", "start"]).cumcount() + 1
            for key, part in line.groupby([batch["file"], batch["start"]]):
                line.loc[part.index] += before.get(key, 0)
                before[key] = before.get(key, 0) + len(part)
            split = batch["start"].map(lambda x: f"{x}:" if x else "")
            yield batch.assign(id=batch["file"] + ":" + split + line.astype(str))[["id", "seen_at", "value"]]

    told = lines.mapInPandas(number, "id string, seen_at timestamp, value string").filter(F.col("value").rlike(r"(?U)[^\s\x1c-\x1f]"))
    rows = told.select("id", F.sha2("value", 256).alias("content_id"), "seen_at", F.col("value").alias("original"), parse(F.col("value")).alias("p"))
    out = rows.select("id", "content_id", "seen_at", "original", "p.messages", "p.metadata", "p.error")
    return out.withColumn("text", message_text(F.col("messages")))


def drop_repeats(records: DataFrame, within: str = "1 day") -> DataFrame:
    """The first of records with the same content whose files were written within a time of one another; what is older than that is forgotten, so the state is bounded."""
    return records.withWatermark("seen_at", within).dropDuplicatesWithinWatermark(["content_id"])


def score_stream(records: DataFrame, scorer: Scorer) -> DataFrame:
    """Good records with the scorer's columns; the scorer must work row by row, as length_scorer() does."""
    return scorer.score(records.filter("error IS NULL"))


def write_stream(scored: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint; once: take what is there and stop."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
