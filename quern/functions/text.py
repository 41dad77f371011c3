"""Text functions: Unicode word tokens, shingles, token counts, hash bins, cosine.

NFC and case folding have no Spark function, so tokens come from Arrow functions. What a whole table needs from its
tokens (shingles and their hashes, words and their bins) is built in the same pass, on buffers of all texts of a batch.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quern.functions import numtext

_WORD = re.compile(r"\w+")
_UNIT = re.compile(r"\w+|[^\w\s]")
#: Characters of text whose words a column function holds at once.
_CHARS = 4 << 20


def fold(text: str) -> str:
    """The form in which texts are compared: composed (NFC), then case-folded."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).casefold()


def word_list(text: str, ignore: tuple[str, ...] = ()) -> list[str]:
    """Runs of letters, digits and underscores of the folded text; literal templates in ignore give way to a space, in turn."""
    folded = fold(text)
    for literal in ignore:
        folded = folded.replace(fold(literal), " ")
    return _WORD.findall(folded)


def words(text: Column, ignore: tuple[str, ...] = ()) -> Column:
    """array<string> of word_list(); null stays null."""

    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # The words of some texts at a time, however many rows come at once.
        for batch in batches:
            for lo, hi in numtext.runs(batch.str.len().fillna(0).to_numpy(np.int64), _CHARS):
                yield batch.iloc[lo:hi].map(lambda t: None if t is None else word_list(t, ignore))

    tokens.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(tokens, S.ArrayType(S.StringType()))(text)


def word_counts(rows: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(ord, n) of each row of (ord, text): the size of words(), of which none leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in numtext.slices(batch, "text", _BYTES):
                n = [len(word_list(t or "", ignore)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("ord").combine_chunks(), pa.array(n, pa.int64())], names=["ord", "n"])

    return rows.select(F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text")).mapInArrow(numtext.lean(run), "ord long, n long")


def shingles(tokens: Column, size: int) -> Column:
    """Distinct windows of so many words, joined by a space; none if there are fewer words."""
    n = F.size(tokens)
    windows = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(n >= size, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def approx_tokens(text: Column) -> Column:
    """Word runs and single marks, as an estimate of model tokens; case is kept."""
    return F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


class PythonCounter:
    """A token counter by a Python function: counter(text) for a column of strings, counter.arrays(texts) for one of arrays of strings.

    make() loads what is needed, once for each task, and returns the function. Spark has no Python functions inside array expressions, so arrays are
    counted whole.
    """

    def __init__(self, make: Callable[[], Callable[[str], int]]):
        self.make = make

    def __call__(self, text: Column) -> Column:
        make = self.make

        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            one = make()
            for batch in batches:
                yield batch.map(lambda t: None if t is None else one(t)).astype("Int64")

        count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(count, S.LongType())(text)

    def arrays(self, texts: Column) -> Column:
        make = self.make

        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            one = make()
            for batch in batches:
                yield batch.map(lambda a: None if a is None else [None if t is None else one(t) for t in a])

        count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(count, S.ArrayType(S.LongType()))(texts)


#: approx_tokens() by Python's own Unicode tables, for scripts that Java's older tables lack.
exact_approx_tokens = PythonCounter(lambda: lambda text: len(_UNIT.findall(text)))


def bpe_counter(load: Callable[[], object]) -> PythonCounter:
    """Tokens of a tiktoken encoding that load() gives; strings of special tokens count as ordinary text."""

    def make():
        encoder = load()
        return lambda text: len(encoder.encode(text, disallowed_special=()))

    return PythonCounter(make)


def _named_encoding(name: str):
    try:
        import tiktoken
    except ImportError as missing:
        raise ValueError("tiktoken is not installed") from missing
    return tiktoken.get_encoding(name)


def bpe_tokens(text: Column, encoding: str = "cl100k_base") -> Column:
    """Token count of a tiktoken encoding by name; its vocabulary must be at hand on the executors."""
    return bpe_counter(lambda: _named_encoding(encoding))(text)


def array_counts(tokens: Callable[[Column], Column], texts: Column) -> Column:
    """Tokens of each text of an array, by a native counter or a PythonCounter."""
    return tokens.arrays(texts) if isinstance(tokens, PythonCounter) else F.transform(texts, tokens)


#: Texts whose tokens are held at once, and bytes of text.
_ROWS, _BYTES = 2000, 4 << 20


def _word_batches(batches: Iterator[pa.RecordBatch], ignore: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[list[str]], numtext.Words]]:
    """(rows, words of each text, the same words in one buffer) of some rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            for part in numtext.slices(batch.slice(lo, _ROWS), "text", _BYTES):
                lists = [word_list(t, ignore) if t else [] for t in part.column("text").to_pylist()]
                yield part, lists, numtext.words(pa.array([" ".join(w) for w in lists], pa.large_string()))


def gram_hashes(rows: DataFrame, size: int, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(ord, n, hashes array<long>) of each row of (ord, text): its distinct windows of so many words as 64-bit hashes, in order; none if there are fewer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, w in _word_batches(batches, ignore):
            docs = part.num_rows
            value, at = numtext.grams(w.hashes(), w.first, size)
            value, doc = numtext.distinct_per_doc(value, w.doc()[at], docs)
            count = np.bincount(doc, minlength=docs)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("ord").combine_chunks(), pa.array(count), lists], names=["ord", "n", "hashes"])

    return rows.select(F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text")).mapInArrow(run, "ord long, n long, hashes array<long>")


def gram_rows(rows: DataFrame, size: int, ignore: tuple[str, ...] = (), among: np.ndarray | None = None) -> DataFrame:
    """(ord, gram) of each distinct window of so many words of each row of (ord, text); among: only windows whose hashes are in this sorted array."""
    sieve = None
    if among is not None:
        sieve = np.zeros(1 << 20, bool)
        sieve[(among.view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lists, w in _word_batches(batches, ignore):
            value, at = numtext.grams(w.hashes(), w.first, size)
            if among is not None:
                near = np.flatnonzero(sieve[(value >> np.uint64(44)).astype(np.int64)])
                signed = value[near].view(np.int64)
                place = np.minimum(np.searchsorted(among, signed), max(0, len(among) - 1))
                hit = near[among[place] == signed] if len(among) else near[:0]
                value, at = value[hit], at[hit]
            doc = w.doc()[at]
            # The first place of each distinct window of a text.
            order = np.lexsort((at, value, doc))
            new = np.ones(len(order), bool)
            new[1:] = (value[order][1:] != value[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            at, doc = at[order[new]], doc[order[new]]
            start = (at - w.first[doc]).tolist()
            ids = part.column("ord").combine_chunks().take(pa.array(doc))
            texts = [" ".join(lists[d][i : i + size]) for d, i in zip(doc.tolist(), start, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["ord", "gram"])

    return rows.select(F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text")).mapInArrow(run, "ord long, gram string")


def gram_lists(rows: DataFrame, size: int, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(ord, grams array<string>) of each row of (ord, text): its distinct windows of so many words, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lists, _ in _word_batches(batches, ignore):
            grams = [sorted({" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}) for w in lists]
            yield pa.RecordBatch.from_arrays([part.column("ord").combine_chunks(), pa.array(grams, pa.list_(pa.string()))], names=["ord", "grams"])

    return rows.select(F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text")).mapInArrow(run, "ord long, grams array<string>")


def least_grams(rows: DataFrame, size: int, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(ord, gram) of each row of (ord, text): the smallest window of so many words; null if there are fewer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lists, _ in _word_batches(batches, ignore):
            # All windows that begin with a smaller word are smaller, whatever follows: a space sorts before any character of a word.
            least = []
            for w in lists:
                n = len(w) - size + 1
                head = min(w[:n]) if n > 0 else None
                least.append(min(" ".join(w[i : i + size]) for i in range(n) if w[i] == head) if n > 0 else None)
            yield pa.RecordBatch.from_arrays([part.column("ord").combine_chunks(), pa.array(least, pa.string())], names=["ord", "gram"])

    return rows.select(F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text")).mapInArrow(numtext.lean(run), "ord long, gram string")


def term_counts(rows: DataFrame, dimensions: int = 512) -> DataFrame:
    """(ord, word, tf, bin) of each distinct word of each row of (ord, text); the bin as of hash_bin()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[str, int] = {}
        for part, lists, _ in _word_batches(batches, ()):
            if len(bins) > 1_000_000:
                bins.clear()
            counts = [Counter(w) for w in lists]
            for c in counts:
                for word in c:
                    if word not in bins:
                        bins[word] = python_bin(word, dimensions)
            ids = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            words_, tf = [w for c in counts for w in c], [n for c in counts for n in c.values()]
            yield pa.RecordBatch.from_arrays(
                [part.column("ord").combine_chunks().take(pa.array(ids)), pa.array(words_, pa.string()), pa.array(tf, pa.int64()), pa.array([bins[w] for w in words_], pa.int32())],
                names=["ord", "word", "tf", "bin"],
            )

    return rows.select(F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text")).mapInArrow(run, "ord long, word string, tf long, bin int")


def python_bin(word: str, dimensions: int) -> int:
    return int.from_bytes(hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()[:8], "big") % dimensions


def bin_counts(rows: DataFrame, dimensions: int = 512) -> DataFrame:
    """(bin, n) partial sums over some texts each: in how many a word of the bin stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[str, int] = {}
        total = np.zeros(dimensions, np.int64)
        for _, lists, _ in _word_batches(batches, ()):
            if len(bins) > 1_000_000:
                bins.clear()
            for w in lists:
                own = set(w)
                for word in own:
                    if word not in bins:
                        bins[word] = python_bin(word, dimensions)
                total[list({bins[word] for word in own})] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    return rows.select(F.lit(0).cast("long").alias("ord"), F.col("text").cast("string").alias("text")).mapInArrow(run, "bin int, n long")


def message_text(messages: Column) -> Column:
    """Contents of all messages, joined by line ends."""
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def hash_bin(word: Column, dimensions: int = 512) -> Column:
    """First eight bytes of SHA-256 as an unsigned number, modulo dimensions."""
    number = F.conv(F.substring(F.sha2(word.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(dimensions)).cast("int")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine in [-1, 1]; 0 for a zero vector; an error for empty, unequal or non-finite vectors."""
    size = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    finite = F.forall(F.concat(left, right), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = (F.size(left) == 0) | (F.size(left) != F.size(right)) | ~finite
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(left, right), size)))
    return F.when(bad, F.raise_error(F.lit("embeddings must have equal nonzero dimensions and finite values")).cast("double")).when(size == 0, F.lit(0.0)).otherwise(value)


def excerpt(text: Column, size: int = 160) -> Column:
    return F.substring(text, 1, size)
