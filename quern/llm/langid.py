"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a bounded sample of labelled text.
A text is parsed into phrases, each the longest match that the automaton knows; the
language whose automaton needs the fewest phrases for a letter explains the text best.

The automata become dense tables (state x byte class -> state). A batch of texts steps through them
in runs, all runs together in numpy, each from the empty state; then each run is parsed again from the
state in which the run before it ends, until both parses begin a phrase at the same byte. From there on they
are one, so the counts are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import numtext as T

#: Bytes of normalised text that a language's automaton is built from, and documents looked at for them.
SAMPLE_BYTES, SAMPLE_DOCS = 40_000, 400
#: Bytes of all tables in a Python worker; with many languages or bytes each has a smaller sample.
TABLE_BYTES = 256 << 20
#: Bytes of table for each byte of sample, about: two states of 64 classes.
TABLE_ROW = 512
#: Bytes of a text that step together with those of others.
RUN = 192
_MISS = np.int32(1 << 30)


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case texts as bytes, all but letters as one space; and the offsets.

    ASCII is done on bytes; bytes of other characters stay as they are, except
    that the two-byte capitals of Latin-1 become small.
    """
    data, off = T.buffers(column)
    if not len(data):
        return data, off
    out = _CLASS_TEXT[data]
    after = np.empty(len(data), bool)
    after[0] = False
    after[1:] = data[:-1] == 0xC3
    out = np.where(after & (data >= 0x80) & (data <= 0x9E), data + np.uint8(32), out)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[off[:-1][off[:-1] < len(out)]] = True
    return out[keep], T.running(keep)[off].astype(np.int64)


_CLASS_TEXT = np.full(256, 32, np.uint8)
_CLASS_TEXT[65:91] = np.arange(97, 123)
_CLASS_TEXT[97:123] = np.arange(97, 123)
_CLASS_TEXT[128:] = np.arange(128, 256)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of a text; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        cur = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


def table(text: bytes, classes: np.ndarray, n: int) -> np.ndarray:
    """(states x classes): the next state; where no phrase goes on, the state after a new phrase's first byte, with _MISS."""
    moves = suffix_automaton(text)
    out = np.full((len(moves), n), -1, np.int32)
    rows = np.fromiter((s for s, m in enumerate(moves) for _ in m), np.int64)
    cols = np.fromiter((classes[c] for m in moves for c in m), np.int64)
    out[rows, cols] = np.fromiter((t for m in moves for t in m.values()), np.int32)
    start = np.where(out[0] < 0, 0, out[0])
    return np.where(out < 0, start[None, :] | _MISS, out).reshape(-1)


class Parser:
    """Automata of all languages, each over its own byte classes; class 0 is every byte that its sample lacks."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        self.tables = []
        for k in self.langs:
            seen = sorted(set(samples[k]) | {32})
            classes = np.zeros(256, np.int32)
            classes[seen] = np.arange(1, len(seen) + 1)
            self.tables.append((classes, len(seen) + 1, table(samples[k], classes, len(seen) + 1)))

    def phrases(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrases, and the number of letters of each text (bytes that are not space, for other scripts a part of it)."""
        data, off = normalise(column)
        docs = len(off) - 1
        out = np.zeros((docs, len(self.langs)), np.int64)
        letters = T.per_text((data != 32) & ((data < 0x80) | (data >= 0xC0)), off)
        size = np.diff(off)
        runs = -(-size // RUN)
        if not runs.sum():
            return out, letters
        doc = np.repeat(np.arange(docs), runs)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = off[doc] + k * RUN
        length = np.minimum(size[doc] - k * RUN, RUN)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # The run before each run of the same text, and the one after it; -1 for none.
        before = np.where(k > 0, np.append(0, place[:-1]), -1)[order]
        after = np.full(len(doc), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        doc, begin, length = doc[order], begin[order], length[order]
        live = np.searchsorted(-length, -np.arange(1, RUN + 1), side="right")
        for j, (classes, n, t) in enumerate(self.tables):
            count = _whole_parse(t, n, classes[data], begin, length, live, before, after)
            out[:, j] = np.bincount(doc, weights=count, minlength=docs).astype(np.int64) + (size > 0)
        return out, letters


def _whole_parse(t: np.ndarray, n: int, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, live: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Phrases that end in each run (a run's bytes: symbols[begin:begin+length], longest runs first; live: how many have a byte at each step)."""
    steps, wide = int(length[0]), np.int32(n)
    state = np.zeros(len(begin), np.int32)
    missed = np.zeros((steps, len(begin)), bool)
    for step in range(steps):
        m = int(live[step])
        got = t[state[:m] * wide + symbols[begin[:m] + step]]
        np.greater_equal(got, _MISS, out=missed[step, :m])
        state[:m] = got & (_MISS - 1)
    # One more phrase begins at each missed byte, and the parse from there on depends on nothing before.
    count = missed.sum(axis=0, dtype=np.int64)
    todo = np.flatnonzero(before >= 0)
    now, own, other = state[before[todo]], np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
    unlike = []
    for step in range(steps):
        ended = np.searchsorted(-length[todo], -step, side="left")
        if ended < len(todo):
            unlike.append((todo[ended:], now[ended:]))
            count[todo[ended:]] = own[ended:]
            todo, now, own, other = todo[:ended], now[:ended], own[:ended], other[:ended]
        if not len(todo):
            break
        got = t[now * wide + symbols[begin[todo] + step]]
        now, miss, seen = got & (_MISS - 1), got >= _MISS, missed[step, todo]
        own += miss
        other += seen
        met = miss & seen
        if met.any():
            count[todo[met]] += own[met] - other[met]
            todo, now, own, other = (x[~met] for x in (todo, now, own, other))
    unlike.append((todo, now))
    count[todo] = own
    # Runs that never met the first parse: the runs after them were parsed from a state that wasn't so. One by one, until a parse meets.
    ends = dict(zip(np.concatenate([x for x, _ in unlike]).tolist(), np.concatenate([x for _, x in unlike]).tolist(), strict=True))
    if ends:
        table = memoryview(t)
        for run in sorted(ends, key=lambda r: int(begin[r])):
            if run not in ends:
                continue
            now, at = ends[run], run
            while now != state[at] and after[at] >= 0:
                state[at] = now
                at = int(after[at])
                own = other = 0
                for step in range(int(length[at])):
                    got = table[now * n + int(symbols[begin[at] + step])]
                    seen = bool(missed[step, at])
                    own, other, now = own + (got >= _MISS), other + seen, got & (_MISS - 1)
                    if got >= _MISS and seen:
                        count[at] = int(missed[:, at].sum()) + own - other
                        ends.pop(at, None)
                        break
                else:
                    count[at] = own
                    ends[at] = now
                    continue
                break
    return count


def sample_texts(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """For each language, normalised texts of few documents, up to so many bytes: of each document a slice of a quarter of that at most.

    The slice is the first sample_bytes // 4 characters, and of those whole characters in sample_bytes // 4 bytes; what fits into the bound of the last one
    is taken too. So a language whose documents are all long has its sample as well.

    The documents with the smallest hashes of (doc_id, text) are looked at; hashes above a bound that leaves about twice as
    many as needed are passed over before the sort, so no task gets all rows of a frequent language. With very many languages the samples are
    smaller, so that their tables stay within TABLE_BYTES.
    """
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    sample_bytes = max(4, min(sample_bytes, TABLE_BYTES // (len(counts) * TABLE_ROW)))
    rank = F.xxhash64("doc_id", "text")
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * sample_docs / n)))])
    near = rows.withColumn("rank", rank).filter(F.col("rank").cast("double") / F.lit(2.0**63) < 2 * F.element_at(share, F.col("lang")) - 1)
    few = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", "text"))).filter(F.col("k") <= sample_docs)
    cut = F.substring("text", 1, sample_bytes // 4)
    sized = few.select("lang", "k", cut.alias("text")).withColumn("size", F.least(F.octet_length("text"), F.lit(sample_bytes // 4)))
    w = Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = sized.withColumn("upto", F.sum("size").over(w)).filter(F.col("upto") <= 2 * sample_bytes)
    out: dict[str, bytes] = {}
    for r in taken.orderBy("lang", "k").select("lang", "text").collect():
        data, _ = normalise(pa.array([_whole(r["text"], sample_bytes // 4)]))
        have = out.get(r["lang"], b"")
        room = sample_bytes - len(have)
        if len(data) > room:
            data, _ = normalise(pa.array([_whole(data.tobytes().decode("utf-8", "ignore"), max(0, room))]))
        if len(data):
            out[r["lang"]] = have + b" " + data.tobytes()
    return {k: v for k, v in out.items() if v.strip()}


def _whole(text: str, size: int) -> str:
    """The whole characters in the first bytes of a text."""
    return text.encode("utf-8", "replace")[:size].decode("utf-8", "ignore")


_parsers: dict[int, Parser] = {}


def _parser(samples: dict[str, bytes]) -> Parser:
    """One parser for each Python worker and set of samples."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(samples)
    return _parsers[key]


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, phrases_per_letter) for every row of (doc_id, text).

    lang_pred is the language with the fewest phrases, the first by name on a tie; `und` with
    score 0 if the text is null or has no letter, or nothing was learned. score is 1 minus the
    ratio of the fewest phrases to the second fewest, mapped to 0.5..1, and 1 with one language. Repeated ids are
    rows of their own; an empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        names = np.array([*parser.langs, "und"], dtype=object)
        for batch in batches:
            for part in T.slices(batch, "text"):
                text = part.column("text").combine_chunks()
                got, letters = parser.phrases(text)
                best = np.full(len(got), len(parser.langs))
                score, rate = np.zeros(len(got)), np.zeros(len(got))
                ok = np.flatnonzero(_has_letter(text, letters))
                if parser.langs and len(ok):
                    best[ok] = got[ok].argmin(axis=1)
                    two = np.sort(got[ok], axis=1)[:, :2].astype(float)
                    score[ok] = 0.5 + 0.5 * (1 - two[:, 0] / two[:, 1]) if two.shape[1] > 1 else 1.0
                    rate[ok] = two[:, 0] / np.maximum(1, letters[ok])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").combine_chunks(), pa.array(names[best], pa.string()), pa.array(score), pa.array(rate)],
                    names=["doc_id", "lang_pred", "score", "phrases_per_letter"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, phrases_per_letter double")


def _has_letter(text: pa.Array, letters: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; texts that are not ASCII and have few are looked at one by one."""
    out = letters > 0
    data, off = T.buffers(text)
    if not len(data):
        return out
    ascii_letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    has = T.per_text(ascii_letters, off) > 0
    for i in np.flatnonzero(out & ~has):
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents, by what the documents outside the fold held out say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    samples = sample_texts(docs.filter(~fold).select("doc_id", "text", "lang"))
    found = identify(docs, samples)
    return found.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
