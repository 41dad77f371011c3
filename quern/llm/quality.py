"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy arrays.

The trees are fitted on the driver on a bounded sample of labelled documents, and predict
rejection. Their output may not fall when a constrained statistic rises (more symbols, more
repetition, more flagged words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import numtext as T
from quern.llm.blocks import stash

#: Labelled documents that the trees and the flagged words are learned from, at most.
SAMPLE_ROWS = 6000
#: Flagged words kept; documents of the sample that a flagged word must be in.
FLAGGED_WORDS, FLAGGED_DOCS = 64, 6
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 80, 3, 0.2, 48, 12, 1.0

#: Bytes of text that statistics are computed for at once; a longer text is one slice by itself.
SLICE = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and the sign of the constraint on rejection (0: none).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": 1, "dup_line_share": 1, "repeat_share": 1, "distinct_share": -1, "upper_share": 1,
    "digit_share": 0, "exclaim_share": 1, "words_per_line": 0, "bare_symbol_share": 1, "end_share": 0, "flagged": 1,
}


def _runs(data: np.ndarray, mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of a mask inside one text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(len(data), bool)
    edge[1:] = ~mask[:-1]
    edge[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(mask & edge)
    edge[-1] = True
    edge[:-1] = ~mask[1:]
    edge[off[1:][off[1:] > 0] - 1] = True
    return starts, np.flatnonzero(mask & edge) + 1


def _dup_lines(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those of them equal to an earlier one."""
    data, off, docs = w.data, w.offsets, len(w.first) - 1
    begin = np.sort(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
    line_doc = np.searchsorted(off[1:], begin, side="right") if len(begin) else begin
    # A text that ends with a line end has an empty last line, which would sit at the next text's start; it has no word either way.
    end = np.empty_like(begin)
    end[:-1] = begin[1:]
    if len(end):
        end[-1] = len(data)
    trimmed = np.where((end > begin) & (end <= len(data)) & (data[np.maximum(end - 1, 0)] == 10), end - 1, end) if len(data) else end
    inked = np.searchsorted(w.starts, trimmed) > np.searchsorted(w.starts, begin)
    begin, trimmed, line_doc = begin[inked], trimmed[inked], line_doc[inked]
    lines = np.bincount(line_doc, minlength=docs)
    _, kept_doc = T.distinct_per_doc(T.hash_spans(data, begin, trimmed), line_doc, docs)
    return lines, lines - np.bincount(kept_doc, minlength=docs)


def _repeats(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text, and words in 3-word windows found twice or more in it."""
    docs = len(w.first) - 1
    hashes, doc = w.hashes(), w.doc()
    _, d = T.distinct_per_doc(hashes, doc, docs)
    distinct = np.bincount(d, minlength=docs)
    n, n_repeat = len(hashes), np.zeros(docs, np.int64)
    value, at = T.grams(hashes, w.first, 3)
    del hashes
    if not len(value):
        return distinct, n_repeat
    gd = doc[at]
    del doc
    order = np.argsort(value) if docs == 1 else np.lexsort((value, gd))
    value, gd = value[order], gd[order]
    same = (value[1:] == value[:-1]) & (gd[1:] == gd[:-1])
    del value, gd
    repeated = np.zeros(len(order), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    cover = np.zeros(n + 3, np.int32)
    p = at[order[repeated]]
    np.add.at(cover, p, 1)
    np.add.at(cover, p + 3, -1)
    return distinct, T.per_text(np.cumsum(cover, dtype=np.int32)[:n] > 0, w.first)


def _flagged(w: T.Words, flagged: np.ndarray) -> np.ndarray:
    """Letter runs of each text that are among the flagged words."""
    docs = len(w.first) - 1
    if not len(flagged):
        return np.zeros(docs, np.int64)
    low = T._LOWER[w.data]
    rs, re_ = _runs(low, _ALPHA[low], w.offsets)
    if not len(rs):
        return np.zeros(docs, np.int64)
    h = T.hash_spans(low, rs, re_)
    hit = flagged[np.minimum(np.searchsorted(flagged, h), len(flagged) - 1)] == h
    return np.bincount(np.searchsorted(w.offsets[1:], rs[hit], side="right"), minlength=docs)


def statistics(column: pa.Array, flagged: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(the base counts, the feature matrix) of whole texts; null is empty. flagged: sorted hashes of lower-case letter runs."""
    w = T.words(column)
    data, off, n_words = w.data, w.offsets, w.counts
    n_repeat, distinct = (x for x in reversed(_repeats(w)))
    lines, n_dup = _dup_lines(w)
    n_flagged = _flagged(w, flagged)
    lead = (data & 0xC0) != 0x80
    upto = T.running(lead)
    word_chars = T.per_text(upto[w.ends] - upto[w.starts], w.first)
    all_chars = (upto[off[1:]] - upto[off[:-1]]).astype(np.int64)
    del upto, lead
    upto = T.running(_ALPHA[data])
    bare = T.per_text(upto[w.ends] == upto[w.starts], w.first)
    del upto
    n_symbols = T.per_text(_SYMBOL[data], off)
    chars, words = np.maximum(1, all_chars), np.maximum(1, n_words)
    last = T.per_text(_END[data[w.ends - 1]], w.first) if len(w.ends) else np.zeros(len(n_words))
    x = np.stack(
        [
            np.log1p(n_words), word_chars / words, n_symbols / chars, n_dup / np.maximum(1, lines), n_repeat / words, distinct / words,
            T.per_text(_UPPER[data], off) / chars, T.per_text(_DIGIT[data], off) / chars, T.per_text(data == 33, off) / chars, n_words / np.maximum(1, lines),
            bare / words, last / words, np.log1p(n_flagged).astype(float),
        ],
        axis=1,
    )
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat}, x


@dataclass
class Forest:
    """Trees as flat arrays: of each node its feature, threshold, children (of a leaf: itself) and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    flagged: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rejection."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, flagged: np.ndarray) -> Forest:
    """Boost DEPTH-level trees on the logistic loss. A split on a constrained statistic must be in its direction, and bounds the values below both sides."""
    signs = np.array(list(FEATURES.values()))
    both = bool(len(y) and 0 < y.sum() < len(y))
    rate = min(0.99, max(0.01, float(y.mean()))) if both else 0.01
    bias = float(np.log(rate / (1 - rate)))
    f, t, lo, ro, v, roots = [], [], [], [], [], []

    def node() -> int:
        for col, z in ((f, 0), (t, 0.0), (lo, len(lo)), (ro, len(ro)), (v, 0.0)):
            col.append(z)
        return len(f) - 1

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(signs))]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(signs)), int)
    score = np.full(len(y), bias)

    def grow(at: np.ndarray, depth: int, low: float, high: float) -> int:
        k = node()
        gs, hs = g[at].sum(), h[at].sum()
        v[k] = float(np.clip(-gs / (hs + L2), low, high)) * RATE
        if depth == DEPTH or len(at) < 2 * MIN_LEAF:
            return k
        best = (1e-6, -1, 0, 0.0)
        for j, sign in enumerate(signs):
            if not len(edges[j]):
                continue
            n = len(edges[j]) + 1
            c = np.cumsum(np.bincount(binned[at, j], minlength=n))[:-1]
            a = np.cumsum(np.bincount(binned[at, j], weights=g[at], minlength=n))[:-1]
            b = np.cumsum(np.bincount(binned[at, j], weights=h[at], minlength=n))[:-1]
            left, right = np.clip(-a / (b + L2), low, high), np.clip(-(gs - a) / (hs - b + L2), low, high)
            gain = a * a / (b + L2) + (gs - a) ** 2 / (hs - b + L2) - gs * gs / (hs + L2)
            ok = (c >= MIN_LEAF) & (len(at) - c >= MIN_LEAF) & (sign * (right - left) >= 0)
            gain = np.where(ok, gain, 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), j, i, float(left[i] + right[i]) / 2)
        _, j, i, mid = best
        if j < 0:
            return k
        side = binned[at, j] <= i
        sign = signs[j]
        f[k], t[k] = j, float(edges[j][i])
        lo[k] = grow(at[side], depth + 1, mid if sign < 0 else low, mid if sign > 0 else high)
        ro[k] = grow(at[~side], depth + 1, mid if sign > 0 else low, mid if sign < 0 else high)
        return k

    for _ in range(TREES if both else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        root = grow(np.arange(len(y)), 0, -4.0, 4.0)
        roots.append(root)
        tree = Forest(*(np.array(c) for c in (f, t, lo, ro, v)), np.array([root]), DEPTH, 0.0, flagged)
        score += tree.score(x)
    as_array = [np.array(c, d) for c, d in ((f, np.int64), (t, float), (lo, np.int64), (ro, np.int64), (v, float))]
    return Forest(*as_array, np.array(roots, np.int64), DEPTH, bias, flagged)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most about sample_rows labelled documents, chosen by hash of doc_id.

    A document is to be rejected if a label calls it toxic or of quality 0; null labels say nothing. Of rows that share a
    doc_id the text with the smallest hash is learned from, so the sample is bounded by ids. Words that toxic documents of the sample hold far
    more often than others are flagged, A-Z in either case. Without labels, or with labels of one kind only, nothing can be told
    apart: the forest is empty and keeps all.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
        .filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    total = marks.count()
    share = min(1.0, sample_rows / max(1, total))
    marks = marks.filter((F.xxhash64("doc_id").cast("double") / F.lit(2.0**63) + 1) / 2 <= share)
    none = np.zeros(0, np.uint64)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = stash(texts.join(F.broadcast(marks), "doc_id"), "labelled")
    low = F.translate("text", ascii_uppercase, ascii_lowercase)
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[a-z\x{80}-\x{10FFFF}]+"), F.lit(0)))).alias("word"))
    few = (
        words.groupBy("word")
        .agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
        .filter(F.col("t") >= FLAGGED_DOCS)
        .filter(F.col("t") > 10 * F.col("c") + FLAGGED_DOCS)
        .orderBy(F.desc("t"), "word")
        .limit(FLAGGED_WORDS)
        .collect()
    )
    # Of words that only toxic texts hold, those in far fewer of them than the foremost are that by chance.
    most = few[0]["t"] if few else 0
    flagged_words = [r["word"].encode() for r in few if r["t"] * 3 >= most]
    flagged = none
    if flagged_words:
        raw, ends = np.frombuffer(b"".join(flagged_words), np.uint8), np.cumsum([len(b) for b in flagged_words])
        flagged = np.sort(T.hash_spans(raw, np.concatenate([[0], ends[:-1]]), ends))
    names = list(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                _, x = statistics(part.column("text").combine_chunks(), flagged)
                yield pa.RecordBatch.from_arrays([part.column("bad").combine_chunks(), *(pa.array(x[:, j]) for j in range(len(names)))], names=["bad", *names])

    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("double")
    got = rows.select("text", bad.alias("bad")).mapInArrow(T.lean(measure), "bad double, " + ", ".join(f"{n} double" for n in names)).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit(got[names].to_numpy(float).reshape(-1, len(names)), got["bad"].to_numpy(float), flagged)


def judge(docs: DataFrame, forest: Forest, keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep_columns of every row, the base counts, base_failed, reject_score (log-odds) and kept.

    Null text counts as empty and fails the base rules, as every text under 50 words does.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    source = docs.select(*keep_columns, F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "__text", SLICE):
                base, x = statistics(part.column("__text").combine_chunks(), forest.flagged)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                score = forest.score(x)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).combine_chunks() for c in keep_columns), *(pa.array(base[b].astype(np.int64)) for b in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score < 0))],
                    names=[*keep_columns, *BASE, "base_failed", "reject_score", "kept"],
                )

    return source.mapInArrow(T.lean(run), fields + ", " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, reject_score double, kept boolean")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents, judged by trees fitted on a sample of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, forest).select("doc_id", *BASE, "base_failed", "kept", "reject_score")
