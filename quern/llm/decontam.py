"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

The alphabet is words (runs of letters and digits, A-Z lower-cased). A walk of 3n steps copies the
word at its position and moves on or stays by a random bit of (step, word); texts at a small edit
distance get embeddings at a small Hamming distance. Each hash table samples a few
places of one walk; a window that shares a table's key with an item is verified by the exact edit distance.

Windows come from anchors: with at most k edits, one of k+1 pieces of the item stands unchanged in the text, so
windows without any piece of the item are not looked at. The number of tables follows from the target recall, for items
of each length: copies of the items with as many random edits as are allowed stand in other words, and are searched for as any
text is. Where the most tables don't reach the target, every window of such items is verified, without tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import numtext as T
from quern.llm.blocks import stash
from quern.llm.quality import _runs

#: Edits allowed, as a share of an item's words; recall aimed at; places sampled for a table; tables of one walk; walks at most.
EDITS, RECALL, PLACES, TABLES, WALKS = 0.2, 0.99, 3, 8, 16
#: Copies with edits by which recall is measured for items of one length (lengths within a quarter count as one).
TRIALS = 600
#: Words of an anchor at most.
ANCHOR = 3
#: Bytes of item texts that go to the executors at once; more items are searched for block by block.
ITEM_BYTES = 4 << 20
_U = np.uint64
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_TOKEN[128:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row and where each text begins."""
    data, off = T.buffers(column)
    low = T._LOWER[data]
    starts, ends = _runs(low, _TOKEN[low], off)
    return T.hash_spans(low, starts, ends), np.searchsorted(starts, off)


def embed(words: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, walk: int, places: np.ndarray) -> np.ndarray:
    """The symbols that one walk puts at the given places (shares of 3n) of the windows begin..begin+n-1; outside low..high-1 a text has only padding."""
    steps = 3 * n
    want = np.minimum((places[None, :] * steps[:, None]).astype(np.int64), steps[:, None] - 1)
    out = np.zeros(want.shape, _U)
    at = np.zeros(len(begin), np.int64)
    for j in range(int(steps.max()) if len(steps) else 0):
        place = begin + at
        inside = (at < n) & (place >= low) & (place < high)
        x = np.where(inside, words[np.clip(place, 0, max(0, len(words) - 1))], _U(0)) if len(words) else np.zeros(len(begin), _U)
        hit = want == j
        if hit.any():
            rows, cols = np.nonzero(hit)
            out[rows, cols] = x[rows]
        salt = _U((walk * 1_000_003 + j) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        at += (T.mix(x ^ salt) >> _U(63)).astype(np.int64)
    return out


def _places(walk: int, tables: int, places: int) -> np.ndarray:
    return np.random.default_rng(walk).random(tables * places)


def keys(words, begin, low, high, n, walks: int) -> np.ndarray:
    """(windows x tables) keys of all tables; a key also holds the window's size and the table."""
    parts = []
    for walk in range(walks):
        sampled = embed(words, begin, low, high, n, walk, _places(walk, TABLES, PLACES)).reshape(len(begin), TABLES, PLACES)
        key = T.mix(n.astype(_U)[:, None] + _U(walk * TABLES << 20) + (np.arange(TABLES, dtype=_U) << _U(20))[None, :])
        for p in range(PLACES):
            key = T.mix(key ^ sampled[:, :, p])
        parts.append(key)
    return np.concatenate(parts, axis=1)


def distance(item: np.ndarray, segment: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of an item to any part of a segment, and where the first such part ends; anchored: to a part that begins at the segment's start."""
    m = len(segment)
    j = np.arange(m + 1)
    row = j.copy() if anchored else np.zeros(m + 1, np.int64)
    for i, x in enumerate(item.tolist(), 1):
        new = np.empty(m + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (segment != x), row[1:] + 1)
        row = np.minimum.accumulate(new - j) + j
    end = int(np.argmin(row))
    return int(row[end]), end


@dataclass
class Index:
    """Items ready for search. walks: how many walks windows of an item's size take, 0 if each is verified; recall: what was measured with them (1 where all are verified)."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    walks: dict[int, int]
    recall: dict[int, float]
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    key: np.ndarray
    key_item: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)


def allowed(n: np.ndarray) -> np.ndarray:
    return np.floor(EDITS * n + 1e-9).astype(np.int64)


def _length_class(n: int) -> int:
    """Items that are measured together: each length up to 8, then steps of a quarter."""
    return n if n <= 8 else 8 + int(math.log(n / 8) / math.log(1.25))


def _edited(item: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    x = list(item)
    for _ in range(edits):
        p, kind, new = int(rng.integers(len(x))), int(rng.integers(3)), int(rng.integers(2**63))
        if kind == 0:
            x[p] = new
        elif kind == 1:
            x.insert(p, new)
        elif len(x) > 1:
            del x[p]
    return x


def measured_recall(words: np.ndarray, first: np.ndarray, anchors: dict, use: np.ndarray, walks: int, seed: int = 0, trials: int = TRIALS) -> np.ndarray:
    """For each number of walks from 1 on, the share of copies of the items `use` that are found, with as many random edits as are allowed and other words around."""
    rng = np.random.default_rng(seed)
    n = np.diff(first)
    chosen = rng.choice(use, size=trials)
    texts, size = [], []
    for i in chosen.tolist():
        k = int(allowed(n[i : i + 1])[0])
        text = [*rng.integers(2**63, size=k + 2).tolist(), *_edited(words[first[i] : first[i + 1]].tolist(), k, rng), *rng.integers(2**63, size=k + 2).tolist()]
        texts += text
        size.append(len(text))
    text, at = np.array(texts, _U), np.concatenate([[0], np.cumsum(size)])
    begin, row, item = _windows(text, at, anchors, n)
    own = item == chosen[row]
    begin, row = begin[own], row[own]
    if not len(begin):
        return np.zeros(walks)
    same = keys(text, begin, at[row], at[row + 1], n[chosen[row]], walks) == keys(words, first[chosen[row]], first[chosen[row]], first[chosen[row] + 1], n[chosen[row]], walks)
    found = np.zeros((trials, walks), bool)
    np.logical_or.at(found, row, np.logical_or.accumulate(same.reshape(len(begin), walks, TABLES).any(axis=2), axis=1))
    return found.mean(axis=0)


def _anchors(words: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: anchor hashes in order, with item and offset. Of each of an item's k+1 pieces the anchor is the run of words that the fewest places of all items have."""
    n = np.diff(first)
    grams = {g: T.grams(words, first, g) for g in range(1, ANCHOR + 1)}
    often, value_at = {}, {}
    for g, (value, at) in grams.items():
        keys, back, count = np.unique(value, return_inverse=True, return_counts=True)
        often[g], value_at[g] = np.zeros(len(words), np.int64), np.zeros(len(words), _U)
        often[g][at], value_at[g][at] = count[back], value
    out: dict[int, list] = {}
    for i in np.flatnonzero(n > 0).tolist():
        k = int(allowed(n[i : i + 1])[0])
        piece = int(n[i]) // (k + 1)
        g = min(ANCHOR, piece)
        for p in range(k + 1):
            lo = int(first[i]) + p * piece
            at = lo + int(np.argmin(often[g][lo : lo + piece - g + 1]))
            out.setdefault(g, []).append((int(value_at[g][at]), i, at - int(first[i])))
    ready = {}
    for g, rows in out.items():
        rows.sort()
        ready[g] = (np.array([r[0] for r in rows], _U), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return ready


def build_index(items: list[tuple], recall: float = RECALL, most_walks: int = WALKS) -> Index:
    words, first = tokens(pa.array([t for _, t in items], pa.string()))
    n = np.diff(first)
    anchors = _anchors(words, first)
    classes: dict[int, list[int]] = {}
    for i in np.flatnonzero(n > 0).tolist():
        classes.setdefault(_length_class(int(n[i])), []).append(i)
    walks: dict[int, int] = {}
    told: dict[int, float] = {}
    for use in classes.values():
        for most in sorted({min(4, most_walks), most_walks}):
            got = np.mean([measured_recall(words, first, anchors, np.array(use), most, seed, TRIALS // 3) for seed in range(3)], axis=0)
            enough = np.flatnonzero(got >= recall)
            if len(enough):
                break
        for size in set(n[use].tolist()):
            walks[size], told[size] = (int(enough[0]) + 1, float(got[enough[0]])) if len(enough) else (0, 1.0)
    flat, item = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for w in sorted(set(walks.values()) - {0}):
        use = np.flatnonzero([walks.get(x) == w for x in n.tolist()])
        k = keys(words, first[use], first[use], first[use + 1], n[use], w)
        flat.append(k.reshape(-1))
        item.append(np.repeat(use, k.shape[1]))
    flat, item = np.concatenate(flat), np.concatenate(item)
    order = np.argsort(flat, kind="stable")
    return Index([i for i, _ in items], words, first, walks, told, anchors, flat[order], item[order])


def _matches(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (place in asked, place in sorted_keys) with equal values."""
    lo = np.searchsorted(sorted_keys, asked, side="left")
    count = np.searchsorted(sorted_keys, asked, side="right") - lo
    at = np.flatnonzero(count)
    who = np.repeat(at, count[at])
    step = np.arange(len(who)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
    return who, lo[who] + step


def _windows(words: np.ndarray, first: np.ndarray, anchors: dict, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, text, item) wherever an anchor of an item stands; the text is that of the anchor, as the window may begin before its text does."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, row, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g, (anchor, item, offset) in anchors.items():
        value, at = T.grams(words, first, g)
        sieve = np.zeros(1 << 16, bool)
        sieve[(anchor & _U(0xFFFF)).astype(np.int64)] = True
        near = np.flatnonzero(sieve[(value & _U(0xFFFF)).astype(np.int64)])
        who, which = _matches(anchor, value[near])
        begin.append(at[near[who]] - offset[which])
        row.append(doc[at[near[who]]])
        of.append(item[which])
    return np.concatenate(begin), np.concatenate(row), np.concatenate(of)


def search(column: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, words, distance) of every verified passage, the best one where passages of an item overlap."""
    words, first = tokens(column)
    n = index.n
    begin, row, item = _windows(words, first, index.anchors, n)
    if not len(begin):
        return []
    walks = np.array([index.walks[x] for x in n[item].tolist()])
    whole = np.flatnonzero(walks == 0)
    hits = set(zip(begin[whole].tolist(), row[whole].tolist(), item[whole].tolist(), strict=True))
    for w in sorted(set(walks.tolist()) - {0}):
        # Windows of one place and size are embedded once, for whichever items of that size.
        use = walks == w
        both = np.unique(np.stack([begin[use], row[use], n[item[use]]], axis=1), axis=0)
        for lo in range(0, len(both), 1 << 18):
            b, r, size = both[lo : lo + (1 << 18)].T
            k = keys(words, b, first[r], first[r + 1], size, w)
            who, which = _matches(index.key, k.reshape(-1))
            who //= k.shape[1]
            hits.update(zip(b[who].tolist(), r[who].tolist(), index.key_item[which].tolist(), strict=True))
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for w, d, i in sorted(hits):
        k = int(allowed(n[i : i + 1])[0])
        low = max(int(first[d]), w - k)
        segment = words[low : min(int(first[d + 1]), w + int(n[i]) + k)]
        item = index.words[index.first[i] : index.first[i + 1]]
        far, end = distance(item, segment)
        if far <= k:
            _, back = distance(item[::-1], segment[:end][::-1], anchored=True)
            best.setdefault((d, i), []).append((far, low + end - back - int(first[d]), back))
    out = []
    for (d, i), found in sorted(best.items()):
        taken: list[tuple[int, int]] = []
        for far, start, length in sorted(set(found)):
            if all(start >= b or start + length <= a for a, b in taken):
                taken.append((start, start + length))
                out.append((d, i, start, length, far))
    return out


def find_passages(docs: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(columns..., item_id, start_word, n_words, distance, item_words) of every benchmark passage in (doc_id, text).

    A passage is within floor(0.2 n) word edits of an item of n words; of overlapping passages of an item the nearest
    stands. At least RECALL of such passages are found for items of any length (all of them without edits, and all where no number of tables is
    enough); what is found is exact. Null and empty texts and items have none; repeated items are found each, repeated
    rows too; empty tables give no rows. Items travel with the tasks in blocks of about ITEM_BYTES; with several, what each finds is written before
    the next is built, so that the driver holds one.
    """
    source = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"{fields}, item_id {kind}, start_word long, n_words long, distance long, item_words long"
    out, parts = None, _item_blocks(items)
    for index in _indexes(items, parts):
        found = source.mapInArrow(T.lean(_searcher(index, columns)), schema)
        found = stash(found, "passages") if parts > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text has no passage of an item as find_passages() finds them. With several blocks of items what each leaves is written for the next."""
    cell = "__text"
    while cell in docs.columns:
        cell += "_"
    source = docs.withColumn(cell, F.col("text").cast("string"))

    def drop(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.slices(batch, cell):
                    hit = {f[0] for f in search(part.column(cell).combine_chunks(), index)} if len(index.ids) else set()
                    yield from part.filter(pa.array([i not in hit for i in range(part.num_rows)])).to_batches()

        return run

    before, parts = (), _item_blocks(items)
    for index in _indexes(items, parts):
        source = source.mapInArrow(T.lean(drop(index)), source.schema)
        if parts > 1:
            source = stash(source, "clean", drop=before)
            before = (source,)
    return source.drop(cell)


def _item_blocks(items: DataFrame) -> int:
    size = int(items.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()["b"] or 0)
    return max(1, -(-size // ITEM_BYTES))


def _indexes(items: DataFrame, parts: int) -> Iterator[Index]:
    """One index for each block of items, one at least."""
    cells = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    for p in range(parts):
        block = cells.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        yield build_index([tuple(r) for r in block])


def _searcher(index: Index, columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "__text"):
                found = search(part.column("__text").combine_chunks(), index) if len(index.ids) else []
                if not found:
                    continue
                rows, item, start, length, far = (list(c) for c in zip(*found, strict=True))
                take = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(take.column(c).combine_chunks() for c in columns), pa.array([index.ids[i] for i in item]), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(far, pa.int64()), pa.array([int(index.n[i]) for i in item], pa.int64()),
                    ],
                    names=[*columns, "item_id", "start_word", "n_words", "distance", "item_words"],
                )

    return run


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document and benchmark item with a passage of it: the smallest distance, the first such place, and how many passages."""
    found = find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.min(F.struct("distance", "start_word", "n_words")).alias("best")
    return found.groupBy("doc_id", "item_id", "item_words").agg(best, F.count(F.lit(1)).alias("n_passages")).select(
        "doc_id", "item_id", "item_words", F.col("best.distance").alias("distance"), F.col("best.start_word").alias("start_word"), F.col("best.n_words").alias("n_words"), "n_passages"
    )
