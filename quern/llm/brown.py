"""Language-model scoring with a Brown class bigram model.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)). All words seen MIN_COUNT times and more take part in exchange
clustering. The TOP most frequent come first, on the driver: starting from one class for each
frequency band, every word in turn moves to the class with the greatest likelihood of the class bigrams.
Then, in ROUNDS rounds, the executors count for each word how often each class stands before and after it, and each word
moves to its best class, the TOP words too. Rarer words, whose neighbours say too little, have
one class for each power of two of their count; the end of a text and the unseen words have classes of
their own. All counts cover every training text.

No vocabulary is held in one place. The words of the corpus are dealt out to buckets of hashes; a block of documents knows its own
words by their place among them. In each round a block tells each bucket which classes stand beside which of the bucket's
words, the bucket moves its words, and tells each block the new classes of those it asked for, one byte for each. The driver sees the
class bigrams (at most 90 x 90, added up by the square root of the number of blocks), the TOP words, and how often these and the classes of
counts follow one another (a million pairs at most).

Within a round the words of a bucket move STEP at a time, those of different buckets at the same time; a
round after which the class bigrams are less likely than before is taken back and is the last.

Smoothing is by leaving one out: in class bigrams a training token counts as a word seen once less, so
words seen once show where unseen words stand. Within a class a word has its share of the class's
tokens; an unseen word has one share in as many words as were seen. A class bigram is backed off to
the class unigram.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import numtext as T
from quern.llm.blocks import blocked, bucket_slices, new_dir, ordered, partitions, remove_dir, runs, stash, unstash

#: Words whose exchange begins on the driver, classes of all words by exchange, passes over the first, and classes of rarer words.
TOP, CLASSES, PASSES, RARE = 1000, 48, 6, 40
#: Words seen so often take part in exchange; so many rounds go over all of them; words of a bucket that move at once.
MIN_COUNT, ROUNDS, STEP = 5, 3, 64
#: Tokens whose class neighbours are counted at once.
COUNT_TOKENS = 1 << 20
#: Added to word counts in the base score; weight of the class unigrams in class bigrams.
WORD_DELTA, BIGRAM_WEIGHT = 0.1, 8.0
_U = np.uint64
END_HASH = 0x5E7D_0F7E_A7B1_0C05


class Tokens:
    """Word hashes of a block of documents, A-Z lower-cased, with an end after each text."""

    def __init__(self, table: pa.Table):
        self.table = ordered(table)
        w = T.words(self.table.column("text"), lower=True)
        counts = w.counts
        self.size = counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.hash = np.full(int(self.first[-1]), END_HASH, _U)
        inner = np.arange(len(w.starts)) + np.repeat(np.arange(len(counts)), counts)
        self.hash[inner] = w.hashes()
        self.held_out = self.table.column("held_out").to_numpy(zero_copy_only=False).astype(bool) if self.table.num_rows else np.zeros(0, bool)
        self.training = np.repeat(~self.held_out, self.size)


def _table(spec: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(spec)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, spec, strict=True)], names=[n for n, _ in spec])


def _sql(spec: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{n} {names[t]}" for n, t in spec)


_ASK = [("h", pa.int32()), ("m", pa.int32()), ("n", pa.int32()), ("hash", pa.binary()), ("count", pa.binary())]
_ANSWER = [("kind", pa.int32()), ("m", pa.int32()), ("h", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("count", pa.binary()), ("word", pa.binary())]


def _ask(m: int, tokens: Tokens, buckets: int) -> pa.Table:
    keys, back = np.unique(tokens.hash, return_inverse=True)
    count = np.bincount(back[tokens.training], minlength=len(keys))
    return _table(_ASK, [(h, m, s.stop - s.start, T.pack_sorted(keys[s]), T.pack(count[s])) for h, s in bucket_slices(keys, buckets, 64)])


def _clustered(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether words take part in exchange."""
    return (count >= MIN_COUNT) & (keys != _U(END_HASH))


def _answer(table: pa.Table) -> pa.Table:
    """kind 0: training counts of the words a block asked for, and the places in the bucket of those that take part in exchange. kind 1: distinct words and tokens of this bucket, and its TOP most frequent words."""
    h, m, n, hashes, counts = (table.column(c).to_pylist() for c in ("h", "m", "n", "hash", "count"))
    value = np.concatenate([T.unpack_sorted(x, k) for x, k in zip(hashes, n, strict=True)])
    count = np.concatenate([T.unpack(x, k) for x, k in zip(counts, n, strict=True)]).astype(np.int64)
    order = np.argsort(value, kind="stable")
    first, run = runs(value[order])
    total = np.add.reduceat(count[order], first)
    word = value[order][first]
    moving = _clustered(word, total)
    place = np.cumsum(moving) - 1
    back = np.empty(len(value), np.int64)
    back[order] = run
    at = np.concatenate([[0], np.cumsum(n)])
    out = []
    for i in range(len(n)):
        own = back[at[i] : at[i + 1]]
        out.append((0, m[i], h[i], n[i], 0, T.pack(total[own]), T.pack(place[own[moving[own]]])))
    use = np.flatnonzero(moving)
    best = use[np.lexsort((word[use], -total[use]))[:TOP]]
    out.append((1, -1, h[0], int((total > 0).sum()), int(total.sum()), total[best].astype("<i8").tobytes(), word[best].astype("<u8").tobytes()))
    return _table(_ANSWER, out)


def _band(count: np.ndarray) -> np.ndarray:
    """Symbols of rare words by their counts; 0 for the unseen word."""
    return np.where(count > 0, 2 + np.minimum(RARE - 1, np.log2(np.maximum(count, 1)).astype(np.int64)), 0)


class Symbols:
    """Small numbers for words while only the TOP words have classes by exchange: 0 the unseen word, 1 the end, then words by power of two of their count, then the TOP words by frequency."""

    def __init__(self, top: np.ndarray):
        self.order = np.argsort(top)
        self.sorted = top[self.order]
        self.size = 2 + RARE + len(top)

    def of(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = _band(count)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == keys, 2 + RARE + self.order[at], out)
        return np.where(keys == _U(END_HASH), 1, out)


def _before(first: np.ndarray, values: np.ndarray, begin) -> np.ndarray:
    """What stands before each token: the value of the token before, or begin where a text begins."""
    out = np.empty(len(values), np.int64)
    out[1:] = values[:-1]
    out[first[:-1]] = begin
    return out


def _pairs(first: np.ndarray, training: np.ndarray, symbol: np.ndarray, less: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts in training texts. Of bigrams with one left out, as numbers previous*size+next (a text begins after an end); of symbols, as size*size+symbol."""
    two = (_before(first, less, 1) * size + less)[training]
    return np.unique(np.concatenate([two, size * size + symbol[training]]), return_counts=True)


def exchange(bigrams: np.ndarray, start: np.ndarray, movable: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Classes of symbols after exchange clustering. bigrams: (symbols x symbols) counts; only movable symbols move, among classes 0..classes-1.

    The likelihood of a class bigram model is sum f(N(c,d)) - sum f(N(c)) - sum f(N(d)) with f(x) = x log x; a
    word's best class is found from the rows and columns that its move would change.
    """
    cls = start.copy()
    total = int(cls.max()) + 1
    hot = np.zeros((len(cls), total))
    hot[np.arange(len(cls)), cls] = 1
    table = hot.T @ bigrams @ hot
    for _ in range(passes):
        moved = 0
        for w in np.flatnonzero(movable):
            right = np.bincount(cls, weights=bigrams[w], minlength=total)
            left = np.bincount(cls, weights=bigrams[:, w], minlength=total)
            own = bigrams[w, w : w + 1]
            right[cls[w]] -= own[0]
            left[cls[w]] -= own[0]
            b = best_classes(table, classes, cls[w : w + 1], right[None], left[None], own)
            if b[0] != cls[w]:
                move_words(table, cls[w : w + 1], b, right[None], left[None], own)
                cls[w] = b[0]
                moved += 1
        if not moved:
            break
    return cls


def _f(x):
    return np.maximum(x, 0) * np.log(np.maximum(x, 1e-300))


def best_classes(table: np.ndarray, classes: int, a: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best class for each of some words of classes a, among 0..classes-1 and a, by the table of class bigrams, as if each moved alone.

    right and left (words x classes): how often each class stands after and before the word, but for the word itself; own: how often it follows itself.
    """
    n, k = right.shape
    word = np.arange(n)

    def gains(target: np.ndarray, stay: bool) -> np.ndarray:
        """(words x targets) log-likelihood of a word in a class over that of the table without it. target: classes, or for stay each word's own."""
        t = a[:, None] if stay else np.broadcast_to(target, (n, len(target)))
        out = np.zeros(t.shape)
        for near, far, flip in ((right, left, False), (left, right, True)):
            # Only classes beside the word change a sum.
            w, c = np.nonzero(near)
            x = near[w, c][:, None]
            b = t[w]
            cell = table[c[:, None], b] if flip else table[b, c[:, None]]
            home = (c == a[w])[:, None]
            # The table without the word: its row a has lost what follows it, its column a what goes before it.
            cell = cell - np.where(home, far[w[:, None], b], 0.0)
            if stay:
                cell = cell - x - np.where(home, own[w][:, None], 0.0)
            change = _f(cell + x) - _f(cell)
            at = np.searchsorted(w, word)
            live = np.flatnonzero(np.append(at[1:], len(w)) > at)
            if len(live):
                out[live] += np.add.reduceat(change, at[live], axis=0)
        r, s = right[word[:, None], t], left[word[:, None], t]
        o, all_r, all_s = own[:, None], right.sum(axis=1)[:, None] + own[:, None], left.sum(axis=1)[:, None] + own[:, None]
        d = table[t, t] - (r + s + o if stay else 0)
        out += _f(d + r + s + o) - _f(d) - (_f(d + r) - _f(d)) - (_f(d + s) - _f(d))
        row, col = table.sum(axis=1)[t], table.sum(axis=0)[t]
        # Sums of rows and columns without the word in the class; in another class it still stands before and after the words of this one.
        row, col = (row - all_r, col - all_s) if stay else (row, col)
        return out - (_f(row + all_r) - _f(row) + _f(col + all_s) - _f(col))

    every = gains(np.arange(classes), False)
    keep = gains(a, True)[:, 0]
    inside = np.flatnonzero(a < classes)
    every[inside, a[inside]] = keep[inside]
    best = every.argmax(axis=1)
    return np.where(every[word, best] > keep + 1e-9, best, a)


def move_words(table: np.ndarray, a: np.ndarray, b: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> None:
    """Change the table of class bigrams by words that move from classes a to b."""
    np.subtract.at(table, a, right)
    np.subtract.at(table.T, a, left)
    np.subtract.at(table, (a, a), own)
    np.add.at(table, b, right)
    np.add.at(table.T, b, left)
    np.add.at(table, (b, b), own)


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for what no class changes."""
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


#: kind 0: a text (a: its words' places among the block's). kind 1: the block's words (n of them; known: the end's place; a: counts; of each word that takes part in exchange b: its place in its bucket, c: the bucket, d: 0 or 1 and its rank among the TOP). kind 2: (p, q) counts of pairs of symbols.
_CODED = [
    ("m", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
    ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("p", pa.binary()), ("q", pa.binary()),
]


def _encode(m: int, t: Tokens, answers: pa.Table, symbols: Symbols, n: int, v: int) -> pa.Table:
    """A block's texts as places among its words, its words, and its counts of symbols. n, v: training tokens and distinct words of the corpus."""
    if not len(t.hash):
        return _table(_CODED, [])
    answers = answers.sort_by("h")
    keys, back = np.unique(t.hash, return_inverse=True)
    parts = answers.select(["h", "n", "count", "word"]).to_pylist()
    count = np.concatenate([T.unpack(r["count"], r["n"]) for r in parts]).astype(np.int64)
    assert len(count) == len(keys), "answers don't fit the questions"
    moving = _clustered(keys, count)
    upto = np.concatenate([[0], np.cumsum([r["n"] for r in parts])])
    many = [int(moving[x:y].sum()) for x, y in zip(upto[:-1], upto[1:], strict=True)]
    place = np.concatenate([T.unpack(r["word"], k) for r, k in zip(parts, many, strict=True)])
    bucket = np.repeat([r["h"] for r in parts], many).astype(_U)
    base = np.log10((count + WORD_DELTA) / (n + WORD_DELTA * (v + 1)))[back]
    seen = (count > 0)[back]
    ids, out = t.table.column("doc_id").to_pylist(), []
    for d in range(len(ids)):
        s = slice(t.first[d], t.first[d + 1])
        out.append((m, 0, ids[d], bool(t.held_out[d]), int(t.size[d]), int(seen[s].sum()), float(base[s].sum()), T.pack(back[s]), None, None, None, None, None))
    end = int(np.searchsorted(keys, _U(END_HASH)))
    symbol, less = symbols.of(keys, count), symbols.of(keys, np.maximum(count - 1, 0))
    rank = np.maximum(symbol[moving] - (1 + RARE), 0)
    out.append((m, 1, None, None, len(keys), end, None, T.pack(count), T.pack(place), T.pack_sorted(bucket), T.pack(rank), None, None))
    pairs, times = _pairs(t.first, t.training, symbol[back], less[back], symbols.size)
    out.append((m, 2, None, None, len(pairs), None, None, None, None, None, None, pairs.astype("<i8").tobytes(), times.astype("<i8").tobytes()))
    return _table(_CODED, out)


class Coded:
    """A block read again: words with counts and classes, and texts.

    Classes are 0..classes-1 by exchange, then those of the unseen word, the end, and words by power of two of their count. told: the classes
    of the block's words that take part in exchange; None for the first ones: by exchange for the TOP words, by their count for others.
    """

    def __init__(self, rows: pa.Table, told: pa.Table | None, top_classes: np.ndarray, classes: int):
        kinds = rows.column("kind").to_numpy()
        own = rows.slice(int(np.flatnonzero(kinds == 1)[0]), 1).to_pylist()[0]
        self.docs = rows.filter(pa.array(kinds == 0))
        self.count = T.unpack(own["a"], own["n"]).astype(np.int64)
        self.end = own["known"]
        moving = self.count >= MIN_COUNT
        moving[self.end] = False
        self.moving = np.flatnonzero(moving)
        n = len(self.moving)
        self.place, self.bucket, rank = T.unpack(own["b"], n).astype(np.int64), T.unpack_sorted(own["c"], n).astype(np.int64), T.unpack(own["d"], n).astype(np.int64)
        self.full, self.less = classes + _band(self.count), classes + _band(np.maximum(self.count - 1, 0))
        self.full[self.end] = self.less[self.end] = classes + 1
        if told is None:
            got = np.where(rank > 0, np.append(0, top_classes)[rank], self.full[self.moving])
        else:
            got = np.frombuffer(b"".join(told.sort_by("h").column("cls").to_pylist()), np.uint8).astype(np.int64)
            assert len(got) == n, "answers don't fit the questions"
        self.full[self.moving] = self.less[self.moving] = got
        self.size = np.array(self.docs.column("n").to_pylist(), np.int64)
        self.held = np.array(self.docs.column("held_out").to_pylist(), bool)

    def texts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of some texts in a row and where each begins."""
        a = self.docs.column("a")
        parts = [T.unpack(a[int(i)].as_py(), int(self.size[i])) for i in which]
        return np.concatenate(parts).astype(np.int64), np.concatenate([[0], np.cumsum(self.size[which])])

    def parts(self, which: np.ndarray):
        """(texts, *texts()) of some texts, about COUNT_TOKENS at a time."""
        upto = np.cumsum(self.size[which])
        for part in np.split(which, np.flatnonzero(np.diff(upto // COUNT_TOKENS)) + 1):
            if len(part):
                yield part, *self.texts(part)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    first, _ = runs(keys[order])
    return keys[order][first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


#: From a block to a bucket (below `buckets`): places of the block's words there, their classes, and counts of class neighbours with keys (place*k + class)*3 + side (0 after, 1 before, 2 the word after itself). To others: class bigrams and class tokens in keys.
_NEAR = [("h", pa.int32()), ("m", pa.int32()), ("n", pa.int32()), ("places", pa.binary()), ("cls", pa.binary()), ("pairs", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())]
#: A bucket: n words' classes, sums of class neighbours, and who asked for which words (blocks, number of words of each, places).
_MET = [("h", pa.int32()), ("n", pa.int32()), ("cls", pa.binary()), ("pairs", pa.int64()), ("keys", pa.binary()), ("times", pa.binary()), ("blocks", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())]
_TOLD = [("m", pa.int32()), ("h", pa.int32()), ("cls", pa.binary())]


def _neighbours(m: int, block: Coded, k: int, buckets: int, tables: int, only_table: bool) -> pa.Table:
    """What a block tells buckets about its words, and its table of class bigrams."""
    table, mass = np.zeros(k * k, np.int64), np.zeros(k, np.int64)
    slot = np.full(len(block.count), -1)
    slot[block.moving] = np.arange(len(block.moving))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for _, word, first in block.parts(np.flatnonzero(~block.held)):
        less = block.less[word]
        before, previous = _before(first, less, block.less[block.end]), _before(first, word, block.end)
        table += np.bincount(before * k + less, minlength=k * k)
        mass += np.bincount(block.full[word], minlength=k)
        if only_table:
            continue
        w, p, same = slot[word], slot[previous], word == previous
        keys = np.concatenate([(p * k + less)[(p >= 0) & ~same] * 3, (w * k + before)[(w >= 0) & ~same] * 3 + 1, (w * k)[(w >= 0) & same] * 3 + 2])
        parts.append(np.unique(keys, return_counts=True))
    out = [(buckets + m % tables, m, 0, b"", b"", 0, np.concatenate([table, mass]).astype("<i8").tobytes(), b"")]
    if not only_table and len(block.moving):
        keys, times = _sum_by(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])) if parts else (np.zeros(0, np.int64),) * 2
        cut = np.concatenate([[0], np.flatnonzero(np.diff(block.bucket)) + 1, [len(block.bucket)]])
        at = np.searchsorted(keys, cut * (3 * k))
        for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            own = keys[at[i] : at[i + 1]]
            key = own + (block.place[own // (3 * k)] - own // (3 * k)) * (3 * k)
            out.append((
                int(block.bucket[x]), m, int(y - x), T.pack(block.place[x:y]), block.full[block.moving[x:y]].astype(np.uint8).tobytes(),
                len(key), T.pack_sorted(key.astype(_U)), T.pack(times[at[i] : at[i + 1]]),
            ))
    return _table(_NEAR, out)


def _gather(part: pa.Table, buckets: int) -> pa.Table:
    """What all blocks tell a bucket, as one row; or the sum of tables."""
    h, rows = part.column("h")[0].as_py(), part.sort_by("m").to_pylist()
    if h >= buckets:
        total = sum(np.frombuffer(r["keys"], "<i8") for r in rows)
        return _table(_MET, [(h, 0, b"", 0, total.tobytes(), b"", b"", b"", b"")])
    places = [T.unpack(r["places"], r["n"]).astype(np.int64) for r in rows]
    n = int(max(p[-1] for p in places)) + 1
    cls = np.zeros(n, np.uint8)
    for p, r in zip(places, rows, strict=True):
        cls[p] = np.frombuffer(r["cls"], np.uint8)
    keys, times = _sum_by(np.concatenate([T.unpack_sorted(r["keys"], r["pairs"]) for r in rows]), np.concatenate([T.unpack(r["times"], r["pairs"]) for r in rows]))
    told = (np.array([r["m"] for r in rows]), np.array([r["n"] for r in rows]), np.concatenate(places))
    return _table(_MET, [(h, n, cls.tobytes(), len(keys), T.pack_sorted(keys), T.pack(times), *(x.astype("<i4").tobytes() for x in told))])


def _moved(r: dict, table: np.ndarray, classes: int, step: int) -> np.ndarray:
    """The new classes of a bucket's words, so many of which move at once."""
    k, table = len(table), table.astype(float)
    keys, times = T.unpack_sorted(r["keys"], r["pairs"]).astype(np.int64), T.unpack(r["times"], r["pairs"]).astype(float)
    place, c, side = keys // (3 * k), keys // 3 % k, keys % 3
    cls = np.frombuffer(r["cls"], np.uint8).astype(np.int64)
    for x in range(0, len(cls), step):
        y = min(len(cls), x + step)
        s = slice(np.searchsorted(place, x), np.searchsorted(place, y))
        near = np.zeros((3, y - x, k))
        near[side[s], place[s] - x, c[s]] = times[s]
        right, left, own = near[0], near[1], near[2, :, 0]
        new = best_classes(table, classes, cls[x:y], right, left, own)
        go = np.flatnonzero(new != cls[x:y])
        move_words(table, cls[x:y][go], new[go], right[go], left[go], own[go])
        cls[x:y] = new
    return cls


class Model:
    """log10 probabilities of class bigrams, and what emissions need, from counts of class bigrams with one left out and of class tokens. unseen: the class of the unseen word."""

    def __init__(self, table: np.ndarray, mass: np.ndarray, unseen: int, v: int):
        # Classes that no word has now get nothing.
        alive = mass > 0
        alive[unseen] = True
        table = table * alive[None, :]
        # With one left out a class may be empty though its words were seen, so the unigrams are the mean of both counts.
        prior = (table.sum(axis=0) + mass) / 2
        prior[unseen] += WORD_DELTA
        prior /= prior.sum()
        self.log = np.log10((table + BIGRAM_WEIGHT * prior[None, :]) / (table.sum(axis=1, keepdims=True) + BIGRAM_WEIGHT) + 1e-30)
        self.mass_log, self.unseen_class = np.log10(np.maximum(mass, 1)), unseen
        self.unseen = -math.log10(max(1, v))

    def emission(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.where(cls == self.unseen_class, self.unseen, np.log10(np.maximum(count, 1)) - self.mass_log[cls])

    def score(self, first: np.ndarray, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        before = _before(first, cls, self.unseen_class + 1)
        return np.add.reduceat(self.log[before, cls] + self.emission(cls, count), first[:-1])


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of (doc_id, text).

    held_out: a Column; rows where it is true teach nothing (null: false). A null or empty text is one end token. base_score is the add-0.1
    unigram score, score that of the class model, both log10; perplexity is that of the class model for a token. With no training text
    all tokens are unseen. Repeated rows count as often as they stand; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    b, blocks = blocked(rows, ("held_out",))
    asked = b.groupBy("m").applyInArrow(lambda key, t: _ask(key[0].as_py(), Tokens(t), blocks), _sql(_ASK))
    answers = stash(asked.groupBy("h").applyInArrow(_answer, _sql(_ANSWER)), "counts")
    sums = answers.filter("kind = 1")
    stats = sums.agg(F.sum("n").alias("v"), F.sum("total").alias("n")).first()
    v, n = int(stats["v"] or 0), int(stats["n"] or 0)

    def unfold(batches):
        for batch in batches:
            for c, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, "<i8")), pa.array(np.frombuffer(w, "<u8").view(np.int64))], names=["count", "word"])

    best = sums.select("count", "word").mapInArrow(unfold, "count long, word long").orderBy(F.desc("count"), "word").limit(TOP).toArrow()
    top = best.column("word").to_numpy().astype(np.int64).view(_U)
    symbols, size, classes = Symbols(top), 2 + RARE + len(top), min(CLASSES, max(1, len(top)))
    k = classes + 2 + RARE

    told = answers.filter("kind = 0").select("m", "h", "n", "count", "word")
    encoded = b.groupBy("m").cogroup(told.groupBy("m")).applyInArrow(lambda key, left, right: _encode(key[0].as_py(), Tokens(left), right, symbols, n, v), _sql(_CODED))
    # A table in as many parts as the blocks are dealt out to, so that a round needn't shuffle the texts.
    name, path = f"quern_coded_{uuid.uuid4().hex}", new_dir(spark, "coded")
    encoded.write.bucketBy(partitions(blocks), "m").option("path", path).option("compression", "zstd").saveAsTable(name)
    unstash(answers)
    coded = spark.table(name)

    def sum_pairs(batches):
        """Counts of symbols, summed over a batch of blocks."""
        for batch in batches:
            a = [np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist()]
            c = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
            if a:
                keys, times = _sum_by(np.concatenate(a), np.concatenate(c))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["pair", "count"])

    # At most (TOP + RARE + 3) squared rows.
    pairs = coded.filter("kind = 2").select("p", "q").mapInArrow(sum_pairs, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count")).toArrow()
    pair, count = pairs.column("pair").to_numpy(), pairs.column("count").to_numpy()
    big, two = np.zeros((size, size)), pair < size * size
    big[pair[two] // size, pair[two] % size] = count[two]
    start = np.concatenate([np.arange(2 + RARE) + classes, np.arange(len(top)) * classes // max(1, len(top))]).astype(np.int64)
    top_classes = exchange(big, start, np.arange(size) >= 2 + RARE, classes)[2 + RARE :].astype(np.uint8)
    tables = max(1, math.isqrt(blocks))
    texts = coded.filter("kind < 2").select("m", "kind", "doc_id", "held_out", "n", "known", "base", "a", "b", "c", "d").groupBy("m")

    def by_block(cls: DataFrame | None, work, spec) -> DataFrame:
        """work(m, block) of all blocks with these classes."""
        if cls is None:
            return texts.applyInArrow(lambda key, left: work(key[0].as_py(), Coded(left, None, top_classes, classes)), _sql(spec))
        return texts.cogroup(cls.groupBy("m")).applyInArrow(lambda key, left, right: work(key[0].as_py(), Coded(left, right, top_classes, classes)), _sql(spec))

    def look(cls: DataFrame | None, only_table: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Buckets with the class neighbours of their words; class bigrams; class tokens."""
        near = by_block(cls, lambda m, block: _neighbours(m, block, k, blocks, tables, only_table), _NEAR)
        met = stash(near.repartition(partitions(blocks), "h").groupBy("h").applyInArrow(lambda t: _gather(t, blocks), _sql(_MET)), "near")
        total = sum((np.frombuffer(r["keys"], "<i8") for r in met.filter(F.col("h") >= blocks).select("keys").collect()), np.zeros(k * k + k, np.int64))
        return met, total[: k * k].reshape(k, k), total[k * k :]

    def move(met: DataFrame, table: np.ndarray) -> DataFrame:
        """The new classes, as each block asked for them."""
        step = STEP

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    new = _moved(r, table, classes, step).astype(np.uint8)
                    ms, sizes, places = (np.frombuffer(r[c], "<i4") for c in ("blocks", "sizes", "places"))
                    at = np.concatenate([[0], np.cumsum(sizes)])
                    yield from _table(_TOLD, [(int(m), r["h"], new[places[x:y]].tobytes()) for m, x, y in zip(ms, at[:-1], at[1:], strict=True)]).to_batches()

        return stash(met.filter(F.col("h") < blocks).mapInArrow(run, _sql(_TOLD)), "classes")

    cls, kept = None, None
    for i in range(ROUNDS + 1):
        met, table, mass = look(cls, only_table=i == ROUNDS)
        if kept is not None and likelihood(table) <= likelihood(kept[1]):
            unstash(met)
            break
        kept = cls, table, mass
        if i < ROUNDS:
            cls = move(met, table)
        unstash(met)
    cls, table, mass = kept
    model = Model(table.astype(float), mass.astype(float), classes, v)

    def score(m: int, block: Coded) -> pa.Table:
        out = np.zeros(len(block.size))
        for which, word, first in block.parts(np.arange(len(block.size))):
            out[which] = model.score(first, block.full[word], block.count[word])
        d = block.docs
        return pa.table([d.column("doc_id"), d.column("held_out"), d.column("n"), d.column("known"), d.column("base"), pa.array(out)], names=[c for c, _ in _SCORED])

    # A table of its own, as the one in parts goes now.
    scored = stash(by_block(cls, score, _SCORED), "scores")
    spark.sql(f"DROP TABLE {name}")
    remove_dir(spark, path)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).withColumn("perplexity", perplexity)


_SCORED = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those outside the fold held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    return score_documents(docs, fold).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
