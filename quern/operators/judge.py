"""Analysis of pairwise judgments and score distributions.

Judgments: (id, seed, baseline, winner, order_disagreement, judge_sha256, order_policy), winner one of `selected`, the baseline, `tie`.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.storage import global_rank, stash

#: Arms that the selected one is held against.
BASELINES = ("random", "full")
#: 0.975 quantile of the normal distribution.
Z95 = 1.959963984540054


def combine_orders(first: Column, second: Column, baseline: Column, policy: str) -> Column:
    """One verdict from the two orders of a pair. `strict`: disagreement is a tie. `paper`: a tie gives way to the other verdict."""
    if policy not in ("strict", "paper"):
        raise ValueError("unknown order policy")
    known = lambda c: c.isin("selected", "tie") | (c == baseline)
    out = F.when(~F.coalesce(known(first) & known(second), F.lit(False)), F.raise_error(F.lit("invalid order decision")).cast("string")).when(first == second, first)
    if policy == "paper":
        out = out.when(first == "tie", second).when(second == "tie", first)
    return out.otherwise(F.lit("tie"))


def _points(winner: Column) -> Column:
    return F.when(winner == "selected", 1.0).when(winner == "tie", 0.5).otherwise(0.0)


def prompt_means(judgments: DataFrame) -> DataFrame:
    """(id, mean): points of each prompt, averaged over its seeds."""
    return judgments.groupBy("id").agg(F.avg(_points(F.col("winner"))).alias("mean"))


def validate_judgments(judgments: DataFrame) -> None:
    """An error unless there is one baseline, judge and policy, (id, seed) is unique, winners are known and every prompt has every seed."""
    known = F.coalesce(F.col("winner").isin("selected", "tie") | (F.col("winner") == F.col("baseline")), F.lit(False))
    told = judgments.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id", F.col("seed")).alias("pairs"),
        F.count_distinct("id").alias("ids"),
        F.count_distinct("seed").alias("seeds"),
        F.min("baseline").alias("baseline"),
        F.count_distinct(F.coalesce("baseline", F.lit(""))).alias("baselines"),
        F.count_distinct(F.coalesce("judge_sha256", F.lit(""))).alias("judges"),
        F.count_distinct(F.coalesce("order_policy", F.lit("strict"))).alias("policies"),
        F.count_if(~known).alias("bad"),
    ).first()
    rules = (
        (told["n"] > 0, "there are no judgments"),
        (told["baselines"] == 1 and told["baseline"] in BASELINES, f"judgments need one baseline of {' or '.join(BASELINES)}"),
        (told["judges"] == 1, "judgments are of several judges"),
        (told["policies"] == 1, "judgments follow several order policies"),
        (told["pairs"] == told["n"], "a prompt is judged twice with one seed"),
        (told["bad"] == 0, "a winner is none of the two sides and no tie"),
        (told["n"] == told["ids"] * told["seeds"], "a prompt lacks a seed that others have"),
    )
    if broken := [why for holds, why in rules if not holds]:
        raise ValueError(broken[0])


def preference(judgments: DataFrame) -> DataFrame:
    """One row: prompts, judgments, selected, baseline, tie, position_disagreements, preference (mean of prompt means)."""
    counts = judgments.agg(
        F.count(F.lit(1)).alias("judgments"),
        F.count_if(F.col("winner") == "selected").alias("selected"),
        F.count_if(~F.col("winner").isin("selected", "tie")).alias("baseline"),
        F.count_if(F.col("winner") == "tie").alias("tie"),
        F.count_if(F.coalesce("order_disagreement", F.lit(False))).alias("position_disagreements"),
    )
    means = prompt_means(judgments).agg(F.count(F.lit(1)).alias("prompts"), F.avg("mean").alias("preference"))
    return counts.join(means)


def bootstrap_interval(judgments: DataFrame, samples: int = 10_000, seed: int = 42) -> tuple[float, float, bool]:
    """(lower, upper, lower > 0.5) of the 95% bootstrap over prompts, sorted by id.

    The draws are those of random.Random(seed).choices(), one sample after another, and a sample's value is the rounded exact sum of what it drew, as sum()
    gives it; so results can be repeated. A stream of one generator can't be dealt out, so the driver draws, on arrays: it holds one number for each prompt.
    """
    if samples < 100:
        raise ValueError("at least 100 bootstrap samples required")
    means = prompt_means(judgments).orderBy(F.col("id").cast("string")).select("mean").toArrow().column("mean").to_numpy()
    if not len(means):
        raise ValueError("no judgments")
    drawn = np.sort(_resampled(means, samples, seed))
    lower, upper = float(drawn[int(0.025 * samples)]), float(drawn[min(samples - 1, int(0.975 * samples))])
    return lower, upper, lower > 0.5


def _generator(seed: int) -> np.random.RandomState:
    """numpy's generator in the state of random.Random(seed); both make the same numbers in [0, 1) of it."""
    _, state, _ = random.Random(seed).getstate()
    out = np.random.RandomState()
    out.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    return out


def _resampled(means: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Means of so many samples with replacement, drawn as random.Random(seed).choices() draws."""
    rng, n = _generator(seed), len(means)
    values, code = np.unique(means, return_inverse=True)
    few = len(values) <= 1 << 12
    if few:
        # Floats are integers over a power of two, so counts of the few values give the exact sum.
        code = code.astype(np.min_scalar_type(len(values)))
        ratios = [float(v).as_integer_ratio() for v in values]
        under = max(d for _, d in ratios)
        exact = [a * (under // d) for a, d in ratios]
    out = np.empty(samples)
    for k in range(samples):
        at = (rng.random_sample(n) * n).astype(np.int64)
        if few:
            out[k] = sum(a * c for a, c in zip(exact, np.bincount(code[at], minlength=len(values)).tolist(), strict=True)) / under
        else:
            out[k] = math.fsum(means[at])
    return out / n


def hashed_draw(*parts: Column) -> Column:
    """A number below 2**28 from an MD5 of parts joined by colons, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 7), 16, 10).cast("long")


class NumberedDraws:
    """hashed_draw(prefix..., j) of all j in 0..n-1 at once: MD5 over arrays, as long as the text fits one block of 64 bytes."""

    _SHIFT = [*(7, 12, 17, 22) * 4, *(5, 9, 14, 20) * 4, *(4, 11, 16, 23) * 4, *(6, 10, 15, 21) * 4]
    _ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
    _WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
    #: Numbers hashed at once: all steps stay in the processor's cache.
    STEP = 1 << 14

    def __init__(self, n: int):
        self.n = n
        self._words: dict[int, list[tuple[int, int, list]]] = {}

    def _blocks(self, prefix: int) -> list[tuple[int, int, list]]:
        """(first, end, words) of runs of numbers with as many digits each: the 16 words of a block without its prefix of so many bytes."""
        if prefix not in self._words:
            out = []
            for lo, hi in self._runs():
                width = len(str(lo))
                if prefix + width > 55:
                    raise ValueError("the text of a draw is too long")
                block = np.zeros((hi - lo, 64), np.uint8)
                left = np.arange(lo, hi)
                for k in range(width - 1, -1, -1):
                    block[:, prefix + k] = 48 + left % 10
                    left //= 10
                block[:, prefix + width] = 0x80
                block[:, 56:58] = [8 * (prefix + width) & 255, 8 * (prefix + width) >> 8]
                words = block.view("<u4")
                # Most words are alike in all rows, and those are numbers.
                out.append((lo, hi, [int(words[0, i]) if (words[:, i] == words[0, i]).all() else np.ascontiguousarray(words[:, i]) for i in range(16)]))
            self._words[prefix] = out
        return self._words[prefix]

    def _runs(self):
        lo = 0
        while lo < self.n:
            hi = min(self.n, lo + self.STEP, 10 ** len(str(lo)))
            yield lo, hi
            lo = hi

    def draws(self, *parts) -> np.ndarray:
        head = "".join(f"{p}:" for p in parts).encode()
        start = np.frombuffer(head.ljust(64, b"\0"), "<u4")
        out = np.empty(self.n, np.int64)
        for lo, hi, words in self._blocks(len(head)):
            own = [w | int(h) if isinstance(w, int) else w | h for w, h in zip(words, start, strict=True)]
            out[lo:hi] = self._first_bits(own, hi - lo)
        return out

    def _first_bits(self, words: list, n: int) -> np.ndarray:
        """The first seven hexadecimal digits of MD5 as numbers."""
        a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        f, s = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
            word = words[self._WORD[i]]
            f += a
            if isinstance(word, int):
                f += np.uint32(word + self._ADD[i] & 0xFFFFFFFF)
            else:
                f += word
                f += np.uint32(self._ADD[i])
            np.right_shift(f, np.uint32(32 - self._SHIFT[i]), out=s)
            f <<= np.uint32(self._SHIFT[i])
            f |= s
            f += b
            # The old a is free for the next step.
            a, b, c, d, f = d, f, b, c, a
        # The digest begins with a, its lowest byte first.
        a += np.uint32(0x67452301)
        return (a.byteswap() >> np.uint32(4)).astype(np.int64)


def bootstrap_by_hash(judgments: DataFrame, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """bootstrap_interval() with draws by hashed_draw(seed, sample, draw), as one row (lower, upper, criterion_met); the samples are drawn by the executors.

    Prompts are numbered by their ids as text; draw j of a sample takes the prompt with the number of its draw modulo the prompts. A task gets
    the means of all prompts (8 bytes each) and some of the samples, so no draw is ever a row.
    """
    if samples < 100:
        raise ValueError("at least 100 bootstrap samples required")
    spark = judgments.sparkSession
    means = prompt_means(judgments).select(F.col("id").cast("string").alias("id"), "mean").orderBy("id").select("mean").toArrow().column("mean").to_numpy()
    n = len(means)
    if not n:
        raise ValueError("no judgments")
    shared = spark.sparkContext.broadcast(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_draws, own = NumberedDraws(n), shared.value
        for batch in batches:
            asked = batch.column("sample").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("sample"), pa.array([float(own[all_draws.draws(seed, s) % n].sum()) / n for s in asked])], names=["sample", "value"])

    # Many small tasks, so that none is left alone at the end.
    parts = min(samples, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = stash(spark.range(samples, numPartitions=parts).select(F.col("id").alias("sample")).mapInArrow(run, "sample long, value double"), "drawn")
    ends = {"lower": int(0.025 * samples), "upper": min(samples - 1, int(0.975 * samples))}
    ranked = global_rank(drawn, F.asc("value"), F.asc("sample")).filter(F.col("rank").isin(*(k + 1 for k in ends.values())))
    cells = ranked.agg(*(F.max(F.when(F.col("rank") == k + 1, F.col("value"))).alias(name) for name, k in ends.items()))
    return cells.withColumn("criterion_met", F.col("lower") > 0.5)


def aggregate_judgments(judgments: DataFrame, samples: int = 10_000) -> dict:
    """preference() and bootstrap_interval() of validated judgments."""
    validate_judgments(judgments)
    lower, upper, met = bootstrap_interval(judgments, samples)
    return preference(judgments).first().asDict() | {"prompt_cluster_bootstrap_95": [lower, upper], "bootstrap_samples": samples, "criterion_met": met}


def wilson(judgments: DataFrame) -> DataFrame:
    """One row: wins, losses, ties, win_rate without ties, its 95% Wilson interval (lower, upper), criterion_met. Without non-ties: null, 0, 1, false."""
    counts = judgments.agg(
        F.count_if(F.col("winner") == "selected").alias("wins"),
        F.count_if(~F.col("winner").isin("selected", "tie")).alias("losses"),
        F.count_if(F.col("winner") == "tie").alias("ties"),
    )
    n = (F.col("wins") + F.col("losses")).cast("double")
    p = F.try_divide(F.col("wins").cast("double"), n)
    z2 = F.lit(Z95 * Z95)
    scale = 1 + F.try_divide(z2, n)
    center = F.try_divide(p + F.try_divide(z2, 2 * n), scale)
    radius = F.try_divide(Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z2, 4 * n * n)), scale)
    return counts.select(
        "wins", "losses", "ties", p.alias("win_rate"), F.coalesce(center - radius, F.lit(0.0)).alias("lower"), F.coalesce(center + radius, F.lit(1.0)).alias("upper"),
        F.coalesce(center - radius > 0.5, F.lit(False)).alias("criterion_met"),
    )


def _placed(values: DataFrame, column: str, *more: str) -> DataFrame:
    """(value, place, more...): place parts equal values, so that a value that many rows have is sorted in many tasks."""
    return values.select(F.col(column).cast("double").alias("value"), F.monotonically_increasing_id().alias("place"), *more)


def lower_quantiles(values: DataFrame, column: str, fractions: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(fraction, value): the element at floor(p * (n-1)) of the sorted values."""
    ranked = global_rank(_placed(values, column).filter("value IS NOT NULL"), F.asc("value"), F.asc("place"))
    n = ranked.count()
    want = F.explode(F.array(*[F.struct(F.lit(p).alias("fraction"), F.lit(int(p * (n - 1)) + 1).alias("rank")) for p in fractions])).alias("w")
    spark = values.sparkSession
    asked = spark.range(1).select(want).select("w.fraction", "w.rank")
    return ranked.join(F.broadcast(asked), "rank").select("fraction", "value")


def selection_curve(values: DataFrame, column: str, fractions: tuple[float, ...] = (0.1, 0.2, 0.4, 0.6, 0.8, 1.0), most: float = 1.0) -> DataFrame:
    """(fraction, count, mean) of the best int(n * p) values that don't exceed most; n counts all values."""
    rows = _placed(values, column).filter("value IS NOT NULL")
    n = rows.count()
    ranked = global_rank(rows.filter(F.col("value") <= most), F.desc("value"), F.asc("place"))
    cells = [F.struct(F.lit(p).alias("fraction"), F.lit(int(n * p)).alias("most")) for p in fractions]
    each = ranked.select("value", "rank", F.explode(F.array(*cells)).alias("c")).filter(F.col("rank") <= F.col("c.most"))
    got = each.groupBy(F.col("c.fraction").alias("fraction")).agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"))
    asked = values.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in fractions])).alias("fraction"))
    return asked.join(got, "fraction", "left").select("fraction", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def average_ranks(values: DataFrame, column: str, key: str) -> DataFrame:
    """(key, value, avg_rank): ties share the mean of their ranks."""
    ranked = global_rank(_placed(values, column, key), F.asc("value"), F.asc("place"))
    # Dealt out by two columns the join shuffles both sides anew, and Spark can split a value that many rows have.
    again = F.xxhash64("value").alias("again")
    ties = ranked.groupBy("value").agg(F.avg("rank").alias("avg_rank")).withColumn("again", again)
    return ranked.select(key, "value", again).join(ties, ["value", "again"]).select(key, "value", "avg_rank")


def spearman(values: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """One row (spearman): correlation of average ranks."""
    a = average_ranks(values, left, key).select(key, F.col("avg_rank").alias("a"))
    b = average_ranks(values, right, key).select(key, F.col("avg_rank").alias("b"))
    return a.join(b, key).agg(F.corr("a", "b").alias("spearman"))


def pair_answers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Answers (id, instruction, reference, answer) of two arms side by side; an error if they don't align."""
    a = first.select("id", *(F.col(c).alias(f"{c}_1") for c in ("instruction", "reference", "answer")), F.lit(True).alias("in_1"))
    b = second.select("id", *(F.col(c).alias(f"{c}_2") for c in ("instruction", "reference", "answer")), F.lit(True).alias("in_2"))
    both = a.join(b, "id", "full")
    same = F.col("in_1").isNotNull() & F.col("in_2").isNotNull() & F.col("instruction_1").eqNullSafe(F.col("instruction_2")) & F.col("reference_1").eqNullSafe(F.col("reference_2"))
    return both.select(
        F.when(same, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("answers do not align: "), F.col("id").cast("string"))).cast("string")).alias("id"),
        F.col("instruction_1").alias("instruction"), F.col("reference_1").alias("reference"), F.col("answer_1").alias("first"), F.col("answer_2").alias("second"),
    )


def identical_answers(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("first").eqNullSafe(F.col("second"))).alias("identical"))


def not_judged(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """Pairs whose ids are not among the judgments, to go on after an interruption."""
    return pairs.join(judged.select("id").distinct(), "id", "left_anti")


def rows_at(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows whose ord is picked: (index) against (ord), an index join."""
    return rows.join(picks.select(F.col("index").alias("ord")), "ord", "left_semi")


def sample_positions(size: int, count: int, seed: int = 42) -> list[int]:
    """Positions drawn without replacement by Python's generator, sorted."""
    return sorted(random.Random(seed).sample(range(size), min(count, size)))


def sample_by_hash(rows: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """A sample without replacement, drawn by the executors: the rows with the smallest hashed_draw(seed, ord), ties by ord."""
    drawn = rows.withColumn("__draw", hashed_draw(F.lit(seed), F.col("ord")))
    return drawn.orderBy("__draw", "ord").limit(count).drop("__draw")


def nested_budgets(rows: DataFrame, budgets: tuple[int, ...], seed: int = 42) -> DataFrame:
    """(ord, budget): arms of one random order, each the head of the next; the order is by hashed_draw(seed, ord), ties by ord."""
    ranked = global_rank(rows.select("ord").withColumn("draw", hashed_draw(F.lit(seed), F.col("ord"))), F.asc("draw"), F.asc("ord"))
    return ranked.select("ord", "rank", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")).filter(F.col("rank") <= F.col("budget")).select("ord", "budget")
