"""Scores of records: lengths, and the ratio of response losses with and without the prompt (IFD).

Rows have (ord, id, messages array<struct<role,content>>); scorers add entries to `scores map<string,double>`, and `flags`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.match import require_unique_ids

TokenCounter = Callable[[Column], Column]
#: (rows with prefix array<struct<role,content>> and target string) -> the same with `nll`.
Provider = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Scorer:
    """Adds named scores: score(rows) returns rows with a column for each of names, and flags in `__flags`."""

    name: str
    names: tuple[str, ...]
    score: Callable[[DataFrame], DataFrame]


def length_scorer(tokens: TokenCounter = X.approx_tokens) -> Scorer:
    """length: tokens of assistant messages; response_ratio: those for each token of the others (1 at least); turns: assistant messages.

    tokens: a native Column function or a text.PythonCounter.
    """

    def total(assistant: bool) -> Column:
        own = F.zip_with("__counts", "messages", lambda n, m: F.when((m["role"] == "assistant") if assistant else (m["role"] != "assistant"), n).otherwise(0))
        return F.aggregate(own, F.lit(0).cast("long"), lambda s, n: s + n)

    def score(rows: DataFrame) -> DataFrame:
        counts = X.array_counts(tokens, F.transform("messages", lambda m: m["content"]))
        counted = rows.withColumn("__counts", counts).withColumn("length", total(True).cast("double"))
        ratio = F.col("length") / F.greatest(F.lit(1), total(False))
        return counted.withColumn("response_ratio", ratio).withColumn("turns", F.size(F.filter("messages", lambda m: m["role"] == "assistant")).cast("double")).drop("__counts")

    return Scorer("length", ("length", "response_ratio", "turns"), score)


def split_response(rows: DataFrame) -> DataFrame:
    """Add prefix (all messages but the last) and target (content of the last); an error unless that is a non-blank assistant message."""
    last = F.try_element_at("messages", F.lit(-1))
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.col("id"))).cast("string")
    target = (
        F.when(F.coalesce(last["role"] != "assistant", F.lit(True)), fail("IFD requires a final assistant response: "))
        .when(~F.coalesce(last["content"].rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False)), fail("IFD requires a nonempty response: "))
        .otherwise(last["content"])
    )
    return rows.withColumn("target", target).withColumn("prefix", F.slice("messages", F.lit(1), F.greatest(F.lit(0), F.size("messages") - 1)))


def fixed_provider(conditional: float = 1.0, unconditional: float = 2.0) -> Provider:
    """Constant losses, for tests."""
    return lambda asked: asked.withColumn("nll", F.when(F.size("prefix") > 0, F.lit(float(conditional))).otherwise(F.lit(float(unconditional))))


def table_provider(losses: DataFrame) -> Provider:
    """Losses from a table (prefix, target, nll); a missing one is null and fails later."""
    return lambda asked: asked.join(losses, ["prefix", "target"], "left")


def function_provider(mean_nll: Callable[[], Callable[[list[dict], str], float]]) -> Provider:
    """A model on the executors: mean_nll() loads it once for each task and returns (prefix, target) -> loss."""

    def provide(asked: DataFrame) -> DataFrame:
        def run(batches):
            model = mean_nll()
            for batch in batches:
                prefixes = [[{"role": m["role"], "content": m["content"]} for m in p] for p in batch["prefix"]]
                yield batch.assign(nll=[float(model(p, t)) for p, t in zip(prefixes, batch["target"], strict=True)])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
        return asked.mapInPandas(run, f"{fields}, nll double")

    return provide


def nll_keys(asked: DataFrame, identity: str) -> DataFrame:
    """Add `key`: SHA-256 of the JSON of [identity, messages, target] with sorted keys."""

    @F.pandas_udf("string")
    def key(prefix: pd.Series, target: pd.Series) -> pd.Series:
        def one(p, t):
            told = json.dumps([identity, [{"role": m["role"], "content": m["content"]} for m in p], t], sort_keys=True)
            return hashlib.sha256(told.encode()).hexdigest()

        return pd.Series([one(p, t) for p, t in zip(prefix, target, strict=True)])

    # Arrow hands arrays of structs over as lists of dicts.
    return asked.withColumn("key", key("prefix", "target"))


def cached_provider(provider: Provider, path: str, identity: str) -> Provider:
    """Keep losses in a Parquet table at path, by nll_keys(); only keys that are not in it are computed, once each, and added."""

    def provide(asked: DataFrame) -> DataFrame:
        spark = asked.sparkSession
        keyed = nll_keys(asked, identity)
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        known = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        missing = keyed.select("key", "prefix", "target").dropDuplicates(["key"])
        if known:
            missing = cache_misses(missing, spark.read.parquet(path))
        fresh = provider(missing.select("key", "prefix", "target")).select("key", F.col("nll").alias("value"))
        valid = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf"))
        fresh.withColumn("value", F.when(valid, F.col("value")).otherwise(F.raise_error(F.lit("invalid NLL for cache")).cast("double"))).write.mode("append").parquet(path)
        cache = spark.read.parquet(path).groupBy("key").agg(F.max("value").alias("nll"))
        return keyed.join(cache, "key").drop("key")

    return provide


def cache_misses(asked: DataFrame, cache: DataFrame) -> DataFrame:
    return asked.join(cache.select("key"), "key", "left_anti")


def ifd_scorer(provider: Provider) -> Scorer:
    """ifd: loss of the response after its prompt, over its loss alone; flag ifd_above_1 beyond 1. Equal questions are asked once."""

    def score(rows: DataFrame) -> DataFrame:
        parts = split_response(rows)
        none = F.array().cast(dict(parts.dtypes)["prefix"])
        asked = parts.select("prefix", "target").union(parts.select(none.alias("prefix"), "target")).distinct()
        losses = provider(asked).select("prefix", "target", "nll")
        conditional = losses.withColumnRenamed("nll", "conditional_nll")
        alone = losses.filter(F.size("prefix") == 0).select("target", F.col("nll").alias("unconditional_nll"))
        both = parts.join(conditional, ["prefix", "target"], "left").join(alone, "target", "left")
        finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        ok = finite("conditional_nll") & (F.col("conditional_nll") >= 0) & finite("unconditional_nll") & (F.col("unconditional_nll") > 0)
        fail = F.raise_error(F.lit("IFD requires finite nonnegative conditional and positive unconditional NLL")).cast("double")
        out = both.withColumn("ifd", F.when(ok, F.try_divide("conditional_nll", "unconditional_nll")).otherwise(fail))
        flag = F.when(F.col("ifd") > 1, F.array(F.lit("ifd_above_1"))).otherwise(F.array().cast("array<string>"))
        before = F.col("__flags") if "__flags" in rows.columns else F.array().cast("array<string>")
        return out.withColumn("__flags", F.concat(before, flag)).drop("prefix", "target")

    return Scorer("ifd", ("ifd", "conditional_nll", "unconditional_nll"), score)


def score_rows(rows: DataFrame, scorers: tuple[Scorer, ...]) -> DataFrame:
    """rows with `scores` and `flags`. Ids must be unique, and so must score names; values must be finite."""
    names = [n for s in scorers for n in s.names]
    if len(set(names)) != len(names):
        raise ValueError("duplicate score name")
    require_unique_ids(rows, "example")
    out = rows.drop("scores", "flags").withColumn("__flags", F.array().cast("array<string>"))
    for s in scorers:
        out = s.score(out)
    entries = []
    for n in names:
        bad = F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
        entries += [F.lit(n), F.when(bad, F.raise_error(F.lit("score must be finite")).cast("double")).otherwise(F.col(n))]
    scores = F.create_map(*entries) if entries else F.create_map().cast("map<string,double>")
    return out.withColumn("scores", scores).withColumn("flags", F.array_sort(F.array_distinct("__flags"))).drop("__flags", *names)
