"""N-gram Jaccard join with signature trees.

Sets of word shingles meet in families, and each family is joined by a signature tree: leaves
hold token bitmaps, inner nodes the OR of what is below and its range of sizes. A dual traversal goes
down pairs of nodes and leaves out a pair if even its greatest possible overlap is too
small, or if all below it is already connected.

How families are found, without loss: a set of n shingles that links with any other shares at least
ceil(t*n) of them. So (1) the document frequency of every shingle is counted; a set with
more than n-ceil(t*n) shingles of its own links with nothing. (2) With shingles in one order, rarest first,
linked sets share one of their first n-ceil(t*n)+1. Sets of compatible size that share such a shingle
are joined to families. A family of more than MEMBERS distinct sets is dealt out in chunks, and what is then still
apart meets by each of those shingles, so its sets are never all compared with one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import numtext as T
from quern.llm.blocks import blocked, bucket_slices, ordered, runs, stash
from quern.llm.components import UnionFind, components, forest, join_grouped

#: Distinct sets, and shingles in them, that one tree holds; larger families are dealt out in chunks.
MEMBERS, TOKENS = 1000, 1_500_000
#: Shingles of small families that are joined in one call.
GROUP_TOKENS = 50_000
#: Sets in a leaf, and children of a node.
LEAF, FANOUT = 32, 8
#: Rounds in which a large family is dealt out at random before what is left apart is compared chunk by chunk.
ROUNDS = 2
_U = np.uint64


class Sets:
    """The shingle sets of a block of documents, in a fixed order of rows."""

    def __init__(self, table: pa.Table, k: int, lower: bool = True):
        self.table = ordered(table)
        w = T.words(self.table.column("text"), lower=lower)
        hashes, doc = w.hashes(), w.doc()
        value, at = T.grams(hashes, w.first, k)
        values, docs = [value], [doc[at]]
        counts = w.counts
        for short in range(1, k):
            few = np.flatnonzero(counts == short)
            if len(few):
                v, at = T.grams(hashes, w.first, short)
                whole = np.isin(at, w.first[few])
                whole &= counts[doc[at]] == short
                values.append(v[whole])
                docs.append(doc[at[whole]])
        rows = len(w.first) - 1
        self.value, self.doc = T.distinct_per_doc(np.concatenate(values), np.concatenate(docs), rows)
        self.size = np.bincount(self.doc, minlength=rows).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.value >> _U(16), return_counts=True)


def _table(spec: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(spec)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, spec, strict=True)], names=[n for n, _ in spec])


_ASK = [("h", pa.int32()), ("m", pa.int32()), ("n", pa.int32()), ("hash", pa.binary()), ("count", pa.binary())]
_ANSWER = [("m", pa.int32()), ("h", pa.int32()), ("n", pa.int32()), ("df", pa.binary())]


def _ask(m: int, sets: Sets, buckets: int) -> pa.Table:
    keys, count = sets.short()
    return _table(_ASK, [(h, m, s.stop - s.start, T.pack_sorted(keys[s]), T.pack(count[s])) for h, s in bucket_slices(keys, buckets, 48)])


def _answer(table: pa.Table) -> pa.Table:
    """Document frequency in all blocks of each shingle asked for."""
    h, m, n, hashes, counts = (table.column(c).to_pylist() for c in ("h", "m", "n", "hash", "count"))
    value = np.concatenate([T.unpack_sorted(x, k) for x, k in zip(hashes, n, strict=True)])
    count = np.concatenate([T.unpack(x, k) for x, k in zip(counts, n, strict=True)])
    order = np.argsort(value, kind="stable")
    first, run = runs(value[order])
    df = np.empty(len(value), _U)
    df[order] = np.add.reduceat(count[order], first)[run]
    at = np.concatenate([[0], np.cumsum(n)])
    return _table(_ANSWER, [(m[i], h[i], n[i], T.pack(df[at[i] : at[i + 1]])) for i in range(len(n))])


_FOUND = "kind int, rid long, doc_id long, n long, live boolean, fp1 long, fp2 long, tokens binary, h int, lo binary, hi binary"
_FOUND_ARROW = [
    ("kind", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("live", pa.bool_()), ("fp1", pa.int64()), ("fp2", pa.int64()),
    ("tokens", pa.binary()), ("h", pa.int32()), ("lo", pa.binary()), ("hi", pa.binary()),
]


def _linkable(small: np.ndarray, large: np.ndarray, num: int, den: int) -> np.ndarray:
    return small * den >= large * num


def _find(m: int, sets: Sets, answers: pa.Table, buckets: int, num: int, den: int) -> pa.Table:
    """kind 0: every document, with its set if any may link with it, and by which shingles (lo; of equal sets in a block only the first). kind 1: shingles by which linked sets must meet, with the range of sizes that have them here. kind 2: sets of this block that meet."""
    rows = len(sets.size)
    keys, back = np.unique(sets.value >> _U(16), return_inverse=True)
    df = np.zeros(0, _U)
    if len(keys):
        answers = answers.sort_by("h")
        df = np.concatenate([T.unpack(x, n) for x, n in zip(answers.column("df").to_pylist(), answers.column("n").to_pylist(), strict=True)])
        assert len(df) == len(keys), "answers don't fit the questions"
        df = df[back]
    slack = sets.size - (num * sets.size + den - 1) // den
    own = np.bincount(sets.doc[df == 1], minlength=rows)
    live = (sets.size > 0) & (own <= slack)
    with np.errstate(over="ignore"):
        upto1 = np.concatenate([[_U(0)], np.cumsum(T.mix(sets.value ^ _U(0xA5A5A5A5)), dtype=_U)])
        upto2 = np.concatenate([[_U(0)], np.cumsum(T.mix(sets.value + _U(0x1234567)), dtype=_U)])
        fp1 = (upto1[sets.first[1:]] - upto1[sets.first[:-1]]).view(np.int64)
        fp2 = (upto2[sets.first[1:]] - upto2[sets.first[:-1]]).view(np.int64)
    rid = (np.int64(m) << np.int64(32)) + np.arange(rows, dtype=np.int64)
    ids = sets.table.column("doc_id").to_pylist()

    def documents(lead: list) -> list[tuple]:
        return [
            (0, int(rid[d]), ids[d], int(sets.size[d]), bool(live[d]), int(fp1[d]), int(fp2[d]), sets.value[sets.first[d] : sets.first[d + 1]].tobytes() if live[d] else None, None, lead[d], None)
            for d in range(rows)
        ]

    # Of equal sets in this block the first stands for all.
    lv = np.flatnonzero(live)
    if not len(lv):
        return _table(_FOUND_ARROW, documents([None] * rows))
    order = lv[np.lexsort((lv, sets.size[lv], fp2[lv], fp1[lv]))]
    head = np.ones(len(order), bool)
    head[1:] = (fp1[order][1:] != fp1[order][:-1]) | (fp2[order][1:] != fp2[order][:-1]) | (sets.size[order][1:] != sets.size[order][:-1])
    chosen = np.zeros(rows, bool)
    chosen[order[head]] = True
    stands = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(order))))
    edges_a, edges_b = [rid[order[~head]]], [rid[stands[~head]]]
    at = np.flatnonzero(chosen[sets.doc])
    at = at[np.lexsort((sets.value[at], df[at], sets.doc[at]))]
    doc = sets.doc[at]
    rank = np.arange(len(at)) - np.repeat(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), np.bincount(doc)[np.unique(doc)])
    at = at[(rank <= slack[doc]) & (df[at] > 1)]
    upto = np.concatenate([[0], np.cumsum(np.bincount(sets.doc[at], minlength=rows))])
    out = documents([sets.value[at[x:y]].tobytes() if y > x else None for x, y in zip(upto[:-1], upto[1:], strict=True)])
    order = np.lexsort((sets.size[sets.doc[at]], sets.value[at]))
    value, who = sets.value[at[order]], sets.doc[at[order]]
    n = sets.size[who]
    joined = np.zeros(len(value), bool)
    joined[1:] = (value[1:] == value[:-1]) & _linkable(n[:-1], n[1:], num, den)
    edges_a.append(rid[who[1:][joined[1:]]])
    edges_b.append(rid[who[:-1][joined[1:]]])
    heads = np.flatnonzero(~joined)
    tails = np.append(heads[1:], len(value)) - 1
    v, lo, hi, of = value[heads], n[heads], n[tails], rid[who[heads]] & 0xFFFFFFFF
    for h, s in bucket_slices(v, buckets, 64):
        out.append((1, m, None, s.stop - s.start, None, None, None, T.pack_sorted(v[s]), h, T.pack(of[s]), T.pack(lo[s]) + T.pack(hi[s])))
    a, b_ = forest(np.concatenate(edges_a), np.concatenate(edges_b))
    if len(a):
        out.append((2, m, None, len(a), None, None, None, a.tobytes(), None, b_.tobytes(), None))
    return _table(_FOUND_ARROW, out)


def _meet(table: pa.Table, num: int, den: int) -> pa.Table:
    """Sets of different blocks that meet: of one shingle, ranges of sizes that reach each other."""
    ms, ns, tokens, ofs, ranges = (table.column(c).to_pylist() for c in ("rid", "n", "tokens", "lo", "hi"))
    value = np.concatenate([T.unpack_sorted(x, n) for x, n in zip(tokens, ns, strict=True)])
    rid = np.concatenate([T.unpack(x, n) for x, n in zip(ofs, ns, strict=True)]).astype(np.int64) + (np.repeat(np.array(ms, np.int64), ns) << np.int64(32))
    cut = [1 + x[0] * n for x, n in zip(ranges, ns, strict=True)]
    lo = np.concatenate([T.unpack(x[:c], n) for x, n, c in zip(ranges, ns, cut, strict=True)]).astype(np.int64)
    hi = np.concatenate([T.unpack(x[c:], n) for x, n, c in zip(ranges, ns, cut, strict=True)]).astype(np.int64)
    order = np.lexsort((lo, value))
    value, rid, lo, hi = value[order], rid[order], lo[order], hi[order]
    _, run = runs(value)
    top = np.maximum.accumulate((run << 34) + hi) & ((1 << 34) - 1) if len(run) else hi
    joined = np.flatnonzero((value[1:] == value[:-1]) & _linkable(top[:-1], lo[1:], num, den)) + 1
    a, b = forest(rid[joined], rid[joined - 1])
    return pa.table({"a": a, "b": b})


class Tree:
    """A signature tree over sets of one family: exact bitmaps over its shared shingles, ORed upwards, and ranges of sizes."""

    def __init__(self, size: np.ndarray, bits: np.ndarray):
        self.size, self.bits = size, bits
        self.level: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        at = np.arange(0, len(size), LEAF)
        low, high, ored = np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.bitwise_or.reduceat(bits, at, axis=0)
        self.level.append((low, high, ored, LEAF))
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            low, high, ored = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(ored, at, axis=0)
            self.level.append((low, high, ored, self.level[-1][3] * FANOUT))


def dual_traversal(x: Tree, y: Tree, num: int, den: int, u: UnionFind, base_x: int, base_y: int) -> None:
    """Union the sets of x and y (members base_x.. and base_y.. of u) that link; x may be y."""
    same = x is y
    stack = [(len(x.level) - 1, 0, len(y.level) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        if same and lx == ly and j < i:
            continue
        lowx, highx, orx, spanx = (c[i] if k < 3 else c for k, c in enumerate(x.level[lx]))
        lowy, highy, ory, spany = (c[j] if k < 3 else c for k, c in enumerate(y.level[ly]))
        most = int(min(np.bitwise_count(orx & ory).sum(), highx, highy))
        if most * den < num * (max(int(lowx), most) + max(int(lowy), most) - most):
            continue
        ax, bx = i * spanx, min((i + 1) * spanx, len(x.size))
        ay, by = j * spany, min((j + 1) * spany, len(y.size))
        if bx - ax + by - ay > 2 and not (same and ax == ay and bx == by):
            root = u.find(base_x + ax)
            if all(u.find(base_x + k) == root for k in range(ax, bx)) and all(u.find(base_y + k) == root for k in range(ay, by)):
                continue
        if lx == 0 and ly == 0:
            sx, sy = x.size[ax:bx], y.size[ay:by]
            both = np.empty((bx - ax, by - ay), np.int64)
            for k in range(bx - ax):
                both[k] = np.bitwise_count(x.bits[ax + k] & y.bits[ay:by]).sum(axis=1)
            link = both * den >= num * (sx[:, None] + sy[None, :] - both)
            for p, q in zip(*np.nonzero(link), strict=True):
                u.union(base_x + ax + int(p), base_y + ay + int(q))
            continue
        # The children nearest to each other are taken first, so that later pairs find them connected.
        pairs = []
        for ci in range(i * FANOUT, min((i + 1) * FANOUT, len(x.level[lx - 1][0]))) if lx and (lx >= ly) else [i]:
            for cj in range(j * FANOUT, min((j + 1) * FANOUT, len(y.level[ly - 1][0]))) if ly and (ly >= lx) else [j]:
                pairs.append((lx - 1 if lx and lx >= ly else lx, ci, ly - 1 if ly and ly >= lx else ly, cj))
        stack += sorted(pairs, key=lambda t: -abs(t[1] - t[3]))


def join_family(rid: np.ndarray, size: np.ndarray, tokens: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set, smallest set connected with it) of the sets of a family. side: only pairs of different sides count. known: components that are known."""
    token = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    keys, back, count = np.unique(token, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    width = max(1, -(-int(shared.sum()) // 64))
    least = np.array([int(t.min()) if len(t) else 0 for t in tokens], dtype=_U)
    order = np.lexsort((size, least, np.floor(np.log(np.maximum(size, 1)) * 8)))
    if side is not None:
        order = order[np.argsort(side[order], kind="stable")]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bits = np.zeros((len(tokens), width), _U)
    use = shared[back]
    col, row = column[back[use]], place[owner[use]]
    np.bitwise_or.at(bits, (row, col >> 6), _U(1) << (col & 63).astype(_U))
    size, rid = size[order], rid[order]
    u = UnionFind(len(rid))
    if known is not None:
        head: dict[int, int] = {}
        for i, c in enumerate(known[order].tolist()):
            u.union(head.setdefault(c, i), i)
    if side is None:
        tree = Tree(size, bits)
        dual_traversal(tree, tree, num, den, u, 0, 0)
    else:
        cut = int((side == side.min()).sum())
        if 0 < cut < len(rid):
            dual_traversal(Tree(size[:cut], bits[:cut]), Tree(size[cut:], bits[cut:]), num, den, u, 0, cut)
    roots = u.roots()
    low = np.full(len(rid), np.iinfo(np.int64).max)
    np.minimum.at(low, roots, rid)
    return rid, low[roots]


def _join_group(table: pa.Table, num: int, den: int) -> pa.Table:
    """Join each family (column fam) of a group of families."""
    table = table.sort_by([("fam", "ascending"), ("rid", "ascending")])
    fam = table.column("fam").to_numpy()
    rid, size = table.column("rid").to_numpy(), table.column("n").to_numpy()
    tokens = [np.frombuffer(x, _U) for x in table.column("tokens").to_pylist()]
    side = table.column("side").to_numpy() if "side" in table.column_names else None
    known = table.column("known").to_numpy() if "known" in table.column_names else None
    first, _ = runs(fam)
    a, b = [], []
    for lo, hi in zip(first, np.append(first[1:], len(fam)), strict=True):
        if hi - lo > 1:
            x, y = join_family(rid[lo:hi], size[lo:hi], tokens[lo:hi], num, den, None if side is None else side[lo:hi], None if known is None else known[lo:hi])
            a.append(x)
            b.append(y)
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    keep = a != b
    return pa.table({"a": a[keep], "b": b[keep]})


def _large(members: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect the sets of large families: (fam, rid, n, tokens, lead, chunks).

    First the sets are dealt out at random into chunks, ROUNDS times anew; a dense family is connected then.
    Sets that link but are still apart share one of the shingles by which they meet (lead). So for each of those that have sets of several
    components, these sets are put into chunks of one component each (small components share chunks), and every pair of chunks that may
    link (by range of sizes, and not of one component) is traversed. No link between components is lost.
    """
    edges = None
    for r in range(ROUNDS):
        dealt = members.select(F.xxhash64("fam", F.pmod(F.xxhash64("rid", F.lit(r)), F.col("chunks"))).alias("fam"), "rid", "n", "tokens")
        got = dealt.groupBy("fam").applyInArrow(lambda t: _join_group(t, num, den), "a long, b long")
        edges = got if edges is None else edges.unionByName(got)
    edges = stash(edges, "dealt")
    label = components(edges).withColumnRenamed("node", "rid")

    def unfold(batches):
        for batch in batches:
            lead = [np.frombuffer(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in batch.column(2).to_pylist()]
            size = [len(x) for x in lead]
            rid, n = (np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(n), pa.array(np.concatenate([np.zeros(0, np.int64), *lead]))], names=["rid", "n", "fam"])

    by_lead = members.select("rid", "n", "lead").mapInArrow(unfold, "rid long, n long, fam long")
    light = stash(by_lead.join(label, "rid", "left").withColumn("known", F.coalesce("label", "rid")).drop("label"), "known")
    # Only shingles whose sets are not all of one component.
    apart = light.groupBy("fam").agg(F.min("known").alias("low"), F.max("known").alias("high")).filter("low <> high").select("fam")
    light = stash(join_grouped(light, apart, "fam"), "apart", drop=(light,))
    sizes = light.groupBy("fam", "known").agg(F.count(F.lit(1)).alias("c"))
    pools = sizes.groupBy("fam").agg(F.sum(F.when(F.col("c") < MEMBERS // 4, F.col("c"))).alias("few"))
    half = MEMBERS // 2
    placed = (
        join_grouped(light, pools, "fam").join(sizes, ["fam", "known"])
        .withColumn("pool", F.col("c") < MEMBERS // 4)
        .withColumn(
            "chunk",
            F.when(F.col("pool"), F.xxhash64(F.lit(1), "fam", F.pmod(F.xxhash64("known"), F.ceil(F.coalesce("few", F.lit(0)) / half))))
            .otherwise(F.xxhash64(F.lit(2), "fam", "known", F.pmod(F.xxhash64("rid", F.lit(99)), F.ceil(F.col("c") / half)))),
        )
    )
    placed = stash(placed.select("fam", "rid", "n", "known", "pool", "chunk"), "placed")
    chunk = placed.groupBy("fam", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("known").alias("known"), F.first("pool").alias("pool"))
    x, y = chunk.alias("x"), chunk.alias("y")
    pairs = x.join(y, F.col("x.fam") == F.col("y.fam")).filter(
        ((F.col("x.chunk") < F.col("y.chunk")) | ((F.col("x.chunk") == F.col("y.chunk")) & F.col("x.pool")))
        & (F.col("x.pool") | F.col("y.pool") | (F.col("x.known") != F.col("y.known")))
        & (F.least("x.hi", "y.hi") * den >= F.greatest("x.lo", "y.lo") * num)
    )
    pairs = pairs.select(F.col("x.chunk").alias("p"), F.col("y.chunk").alias("q"))
    sent = pairs.select(F.xxhash64("p", "q").alias("pair"), F.explode(F.array_distinct(F.array("p", "q"))).alias("chunk"), (F.col("p") == F.col("q")).alias("alone"))
    rows = placed.select("rid", "known", "chunk").join(sent, "chunk").join(members.select("rid", "n", "tokens"), "rid")

    def cross(table: pa.Table) -> pa.Table:
        one = table.column("alone")[0].as_py()
        side = pa.array(np.unique(table.column("chunk").to_numpy(), return_inverse=True)[1])
        cols = {"fam": table.column("pair"), "rid": table.column("rid"), "n": table.column("n"), "tokens": table.column("tokens"), "known": table.column("known")}
        return _join_group(pa.table(cols if one else cols | {"side": side}), num, den)

    crossed = rows.groupBy("pair").applyInArrow(cross, "a long, b long")
    return edges.unionByName(crossed)


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, rid, n_shingles, component_id, rank) of every row: components of the links den * |A & B| >= num * |A | B|.

    The set of a row is that of its distinct k-word shingles (A-Z lower-cased), or its one whole sequence if it has fewer words. A
    null or empty text has the empty set and links with nothing. component_id is the smallest doc_id of the
    component (null if all are null); rank 1 is the row of it with the smallest (doc_id, rid), nulls last. rid is unique to the row. An
    empty table gives no rows; further columns are ignored.
    """
    b, blocks = blocked(docs)
    asked = b.groupBy("m").applyInArrow(T.lean(lambda key, t: _ask(key[0].as_py(), Sets(t, k), blocks)), "h int, m int, n int, hash binary, count binary")
    answers = asked.groupBy("h").applyInArrow(T.lean(_answer), "m int, h int, n int, df binary")
    found = b.groupBy("m").cogroup(answers.groupBy("m")).applyInArrow(T.lean(lambda key, left, right: _find(key[0].as_py(), Sets(left, k), right, blocks, num, den)), _FOUND)
    found = stash(found, "sets")
    met = found.filter("kind = 1").select("h", "rid", "n", "tokens", "lo", "hi").groupBy("h").applyInArrow(T.lean(lambda t: _meet(t, num, den)), "a long, b long")

    def unpack_edges(batches):
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], names=["a", "b"])

    local = found.filter("kind = 2").select("tokens", "lo").mapInArrow(unpack_edges, "a long, b long")
    family = components(met.unionByName(local)).toDF("rid", "fam")
    all_docs = found.filter("kind = 0").select("doc_id", "rid", "n", "live", "fp1", "fp2")
    light = all_docs.filter("live").join(family, "rid")
    sets = light.groupBy("fam", "fp1", "fp2", "n").agg(F.min("rid").alias("rep"))
    sets = stash(sets, "distinct")
    sizes = sets.groupBy("fam").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")).filter("c > 1")
    sizes = sizes.withColumn("chunks", F.greatest(F.ceil(F.col("c") / MEMBERS), F.ceil(F.col("t") / TOKENS)).cast("long"))
    sizes = stash(sizes, "families")
    reps = sets.select("fam", F.col("rep").alias("rid")).join(sizes, "fam").select("fam", "rid", "chunks")
    members = found.filter("kind = 0 AND live").select("rid", "n", "tokens", F.col("lo").alias("lead")).join(reps, "rid")
    told = sizes.agg(F.max("chunks").alias("most"), F.sum(F.when(F.col("chunks") == 1, F.col("t"))).alias("t")).first()
    groups = max(1, -(-int(told["t"] or 0) // GROUP_TOKENS))
    small = members.filter("chunks = 1").withColumn("g", F.pmod(F.xxhash64("fam"), F.lit(groups)))
    edges = small.select("g", "fam", "rid", "n", "tokens").groupBy("g").applyInArrow(lambda t: _join_group(t, num, den), "a long, b long")
    if (told["most"] or 0) > 1:
        large = stash(members.filter("chunks > 1"), "large")
        edges = edges.unionByName(_large(large, num, den))
    roots = components(edges).toDF("rep", "root")
    placed = light.join(sets, ["fam", "fp1", "fp2", "n"]).join(roots, "rep", "left").select("rid", F.coalesce("root", "rep").alias("root"))
    out = all_docs.select("doc_id", "rid", F.col("n").alias("n_shingles")).join(placed, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = out.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least"))
    return join_grouped(out, least, "root").select(
        "doc_id", "rid", "n_shingles", F.col("least.doc_id").alias("component_id"), F.when(F.col("least.rid") == F.col("rid"), 1).otherwise(2).alias("rank")
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, extra...) without near duplicates: of each component the row with the smallest doc_id.

    Rows are told apart by their place in their block, so a repeated doc_id is handled row by row.
    """
    chosen = jaccard_components(docs, k, num, den).filter("rank = 1").select((F.col("rid") / F.lit(1 << 32)).cast("int").alias("m"), F.col("rid").bitwiseAND((1 << 32) - 1).alias("row"))
    b, _ = blocked(docs, extra)
    types = {f.name: f.dataType.simpleString() for f in b.schema.fields}

    def take(left, right):
        rows = ordered(left).take(pa.array(np.sort(right.column("row").to_numpy()))) if right.num_rows else left.slice(0, 0)
        return rows.select(["doc_id", "text", *extra])

    return b.groupBy("m").cogroup(chosen.groupBy("m")).applyInArrow(T.lean(take), ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", "text", *extra)))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents with the component of links of Jaccard 0.9 over three-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c.b, d.doc_id), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
