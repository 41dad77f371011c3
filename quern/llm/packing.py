"""Sum-of-squares online packing of tokenised documents into windows of a fixed size.

Each task packs the documents of its partition as they come. The state is an array that counts
the open windows at each fill level; a document goes to the level where the sum of the squared
counts grows least. Long documents fill whole windows first; when a task ends, or too many
windows are open, the least filled ones are cut up to fill the fullest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import numtext as T

WINDOW = 4096
#: Open windows of a task, a bound on its memory (64 MB of ids); beyond it the half with the least in them is cut up to fill others. 10,000 documents leave about 300 open.
MAX_OPEN = 4096
#: Words that a Python worker keeps the ids of; beyond this it begins anew.
CACHE_WORDS = 2_000_000
#: Texts on which a tokenizer must give the ids of its words, one after another, to be used here.
PROBES = ("ab  Cd,\nef.", "a, b. (c) d's e-f 12,5", "\tx\r\n\x0by\x0cz ", "\u0130, \u0130\u0130. \u00e9t\u00e9, e\u0301, \u03a3\u03a3.", "\u4e2d\u6587, \u0301. \u00a0,")


class WordTokenizer:
    """Ids of whole texts, from a tokenizer that never joins what white space parts; one that fails on PROBES is an error.

    Ids of each distinct word are found once and kept by the word's hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = {s: self.tokenizer.encode(s, add_special_tokens=False).ids for s in (",", ".")}
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()
        for probe in PROBES:
            ids, _ = self.encode(pa.array([probe]), 0)
            if ids[:-1].tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"{path}: ids of a text are not those of its words")

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.pool, self.used, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 16, self.kind), 0, 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        if not len(keys):
            return
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), self.kind, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], flat, np.zeros(max(self.used, len(flat)), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin = np.concatenate([self.begin, self.used + np.concatenate([[0], np.cumsum(size)[:-1]])])
        self.size = np.concatenate([self.size, size])
        keys, rows = np.concatenate([self.keys, keys]), np.concatenate([self.rows, np.arange(self.n, self.n + len(ids))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        self.used, self.n = self.used + len(flat), self.n + len(ids)

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: many words as one text, and cut where the words end."""
        out: list[list[int]] = []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            ids = e.ids
            word = np.searchsorted(starts, np.fromiter((o[0] for o in e.offsets), np.int64, len(ids)), side="right") - 1
            cuts = np.searchsorted(word, np.arange(len(part) + 1))
            out += [ids[cuts[i] : cuts[i + 1]] for i in range(len(part))]
        return out

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Ids of new words; an ASCII letter before a last `,` or `.` parts the two in the tokenizer, so they are looked up alone.

        Other letters may turn into a letter and a mark (NFC, lower case), and a mark joins what follows it; such words are looked up whole.
        """
        bases, tails = [], []
        for w in words:
            tail = b""
            if w[-1:] in b",." and w[-2:-1].isalpha():
                w, tail = w[:-1], w[-1:]
            bases.append(w.lower() if w.isascii() and b"<" not in w else w)
            tails.append(tail)
        joined = np.frombuffer(b"".join(bases), np.uint8)
        ends = np.cumsum([len(b) for b in bases])
        base_keys = T.hash_spans(joined, np.concatenate([[0], ends[:-1]]), ends)
        missing = np.flatnonzero(self._find(base_keys) < 0)
        if len(missing):
            new, first = np.unique(base_keys[missing], return_index=True)
            self._add(new, self._encode([bases[i].decode("utf-8", "replace") for i in missing[first]]))
        derived = np.flatnonzero(self._find(keys) < 0)
        if len(derived):
            rows = self._find(base_keys[derived])
            self._add(keys[derived], [self.pool[self.begin[r] : self.begin[r] + self.size[r]].tolist() + self.suffix.get(tails[i].decode(), []) for r, i in zip(rows, derived, strict=True)])

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, end_id after each, and where each text begins."""
        w = T.words(column)
        if self.n > CACHE_WORDS:
            self.clear()
        keys, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        new = np.flatnonzero(self._find(keys) < 0)
        if len(new):
            self._learn(keys[new], [w.word(first[i]) for i in new])
        row = self._find(keys)[back]
        size = self.size[row].astype(np.int64) if len(row) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        n = len(w.first) - 1
        begin = upto[w.first] + np.arange(n + 1)
        out = np.full(int(begin[-1]), end_id, np.uint32)
        if len(row):
            shift = np.repeat(self.begin[row] - upto[:-1], size)
            to = np.arange(upto[-1]) + np.repeat(w.doc(), size)
            out[to] = self.pool[shift + np.arange(upto[-1])]
        return out, begin


class Packer:
    """Windows of one task. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.done: list[tuple] = []
        self.count = 0

    def _close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, ids, total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self._close([(doc_id, at, ids[at : at + self.window], total)])
            at += self.window
        if at < total:
            self._place([(doc_id, at, ids[at:].copy(), total)], total - at)

    def _place(self, pieces: list, size: int) -> None:
        """Choose the fill level h: moving one window from h to h+size changes the sum of squares by 2(N[h+size]-N[h])+2."""
        level = self.level
        at = np.flatnonzero(level[1 : self.window - size + 1]) + 1
        best, cost = 0, 2 * level[size] + 1
        if len(at):
            change = 2 * (level[at + size] - level[at]) + 2
            if at[-1] + size == self.window:
                change[-1] = 1 - 2 * level[at[-1]]
            k = int(np.argmin(change))
            if change[k] < cost or (change[k] == cost and at[k] + size == self.window):
                best = int(at[k])
        held: list = []
        if best:
            held = self.open[best].pop()
            level[best] -= 1
            self.count -= 1
        held = held + pieces
        if best + size == self.window:
            self._close(held)
            return
        self.open[best + size].append(held)
        level[best + size] += 1
        self.count += 1
        if self.count > MAX_OPEN:
            self.drain(MAX_OPEN // 2)

    def drain(self, keep: int) -> None:
        """Cut up the least filled windows to fill the fullest, until so many are left open (at least one)."""
        windows = [(h, x) for h in range(1, self.window) for x in self.open[h]]
        for h in range(1, self.window):
            self.open[h] = []
        self.level[:] = 0
        lo, hi = 0, len(windows) - 1
        while lo < hi and hi - lo + 1 > keep:
            fill, pieces = windows[hi]
            while fill < self.window and lo < hi:
                have, supply = windows[lo]
                doc_id, start, ids, total = supply.pop()
                take = min(self.window - fill, len(ids))
                cut = len(ids) - take
                pieces.append((doc_id, start + cut, ids[cut:], total))
                if cut:
                    supply.append((doc_id, start, ids[:cut], total))
                fill += take
                windows[lo] = (have - take, supply)
                if not supply:
                    lo += 1
            if fill < self.window:
                windows[hi] = (fill, pieces)
                break
            self._close(pieces)
            hi -= 1
        for fill, pieces in windows[lo : hi + 1]:
            if pieces:
                self.open[fill].append(pieces)
                self.level[fill] += 1
        self.count = int(self.level.sum())

    def finish(self) -> None:
        """Fill what is left; the last window goes out as sequences whose sizes are powers of two, without padding."""
        self.drain(1)
        for h in range(1, self.window):
            for pieces in self.open[h]:
                left = h
                while left:
                    size, part = 1 << (left.bit_length() - 1), []
                    left -= size
                    while size:
                        doc_id, start, ids, total = pieces.pop(0)
                        take = min(size, len(ids))
                        part.append((doc_id, start, ids[:take], total))
                        if take < len(ids):
                            pieces.insert(0, (doc_id, start + take, ids[take:], total))
                        size -= take
                    self._close(part)
            self.open[h] = []
        self.level[:] = 0
        self.count = 0


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of sequences of at most `window` ids from (doc_id, text).

    ids: little-endian unsigned 32-bit. A null or empty text is only end_id. doc_id may be null
    or repeat; such rows are documents of their own. An empty table gives no rows; further
    columns are ignored. sequence_id holds the partition above bit 33. All sequences
    have `window` ids, or fewer but then a power of two, so none needs padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = _tokenizer(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 33)

        def out() -> pa.RecordBatch:
            d, packer.done = packer.done, []
            col = list(zip(*d, strict=True)) if d else [()] * 6
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(col[0], pa.int64()), pa.array(col[1], pa.int64()), pa.array([len(x) for x in col[2]], pa.int64()),
                    pa.array([x.tobytes() for x in col[2]], pa.binary()), pa.array(col[3], pa.int64()), pa.array(col[4], pa.int64()), pa.array(col[5], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for part in T.slices(batch, "text"):
                ids, begin = tok.encode(part.column("text"), end_id)
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(doc_id, ids[begin[i] : begin[i + 1]])
                yield out()
        packer.finish()
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(T.lean(run), PIECES)


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker; its words stay known from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
