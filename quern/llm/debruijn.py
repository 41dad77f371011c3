"""Substring dedup by De Bruijn compaction.

Every window of k words is an edge between the (k-1)-word sequences at its ends. Edges that occur
more than once are kept; each gets as source coordinate its first occurrence. Where the
sources of neighbouring edges run on word by word and their multiplicities agree, they compact into one path: all that
enters by the one edge and was first read there leaves by the other, as far as counts can tell (equally many
other ways in and out may cross the node between them; then the path is longer than a strictly nonbranching one, and just as
well verified). A path found elsewhere than at its source is a repeated span; the words at the source coordinates verify it.
A span that fails, as two windows have one hash, gets the words at its source and keeps what they don't share.

Exchanges, each between blocks of documents and buckets of hashes (see blocks.py):
  1. which edges does another block have?  48-bit hashes, once per block and edge; one bit comes back
  2. where does each repeated edge occur first, and how often?  64-bit hashes with coordinates
  3. do the words at the source of a span have the span's digest?  once per block and source span
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import numtext as T
from quern.llm.blocks import blocked, bucket_slices, ordered, runs

WINDOW = 20
_U = np.uint64
_ASK = "h int, m int, n int, blob binary"
_ANSWER = "m int, h int, n int, blob binary"


def _rows(names_types: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names_types)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, names_types, strict=True)], names=[n for n, _ in names_types])


ASK = [("h", pa.int32()), ("m", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())]
ANSWER = [("m", pa.int32()), ("h", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())]


def ask_seen(m: int, short: np.ndarray, buckets: int, bits: int) -> pa.Table:
    """Sorted distinct hashes of a block as questions, one row for each bucket that any falls in."""
    return _rows(ASK, [(h, m, s.stop - s.start, T.pack_sorted(short[s])) for h, s in bucket_slices(short, buckets, bits)])


def answer_seen(table: pa.Table) -> pa.Table:
    """For each question whether another block asks for the same hash."""
    table = table.sort_by("m")
    h, ms, ns, blobs = (table.column(c).to_pylist() for c in ("h", "m", "n", "blob"))
    values = np.concatenate([T.unpack_sorted(x, n) for x, n in zip(blobs, ns, strict=True)])
    order = np.argsort(values, kind="stable")
    first, run = runs(values[order])
    size = np.diff(np.append(first, len(values)))
    shared = np.empty(len(values), bool)
    shared[order] = (size > 1)[run]
    out, at = [], 0
    for k, n in enumerate(ns):
        out.append((ms[k], h[k], n, np.packbits(shared[at : at + n]).tobytes()))
        at += n
    return _rows(ANSWER, out)


def seen(table: pa.Table, total: int) -> np.ndarray:
    """The answers of a block, in the order of its questions."""
    if not total:
        return np.zeros(0, bool)
    table = table.sort_by("h")
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist(), strict=True)]
    out = np.concatenate(parts)
    assert len(out) == total, "answers don't fit the questions"
    return out


class Block:
    """The edges of a block of documents, in a fixed order of rows."""

    def __init__(self, table: pa.Table, k: int):
        self.table = ordered(table)
        self.k = k
        self.words = T.words(self.table.column("text"))

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return T.grams(self.words.hashes(), self.words.first, self.k)

    @property
    def value(self) -> np.ndarray:
        return self.edges[0]

    @property
    def at(self) -> np.ndarray:
        return self.edges[1]

    def short(self) -> np.ndarray:
        return np.unique(self.value >> _U(16))

    def repeated(self, answers: pa.Table) -> np.ndarray:
        """Whether each edge occurrence is of an edge that occurs twice or more, in this block or another (by 48 bits)."""
        keys, back, count = np.unique(self.value >> _U(16), return_inverse=True, return_counts=True)
        return (seen(answers, len(keys)) | (count > 1))[back]

    def order_key(self) -> np.ndarray:
        """doc_id of each row as unsigned integers in the same order; null is 0."""
        ids = self.table.column("doc_id")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        key = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U) ^ _U(1 << 63)
        return np.where(valid, key, _U(0))


def ask_first(m: int, block: Block, rep: np.ndarray, buckets: int) -> list[tuple]:
    """Each distinct repeated edge of the block with its first coordinate here and its count."""
    at = block.at[rep]
    keys, first, count = np.unique(block.value[rep], return_index=True, return_counts=True)
    doc = block.words.doc()
    row = doc[at[first]] if len(first) else np.zeros(0, np.int64)
    start = at[first] - block.words.first[row]
    key = block.order_key()
    base = int(key.min()) if len(key) else 0
    delta = key[row] - _U(base)
    return [
        (h, m, s.stop - s.start, base - (1 << 63), T.pack_sorted(keys[s]), T.pack(delta[s]), T.pack(row[s]), T.pack(start[s]), T.pack(count[s]))
        for h, s in bucket_slices(keys, buckets, 64)
    ]


ASK_FIRST = [("h", pa.int32()), ("m", pa.int32()), ("n", pa.int32()), ("base", pa.int64()), *((c, pa.binary()) for c in ("hash", "id", "row", "start", "count"))]
FIRST = [("m", pa.int32()), ("h", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("src_m", "src_row", "src_start", "total"))]


def answer_first(table: pa.Table) -> pa.Table:
    """For each question the first coordinate of its edge in all blocks and the edge's multiplicity."""
    table = table.sort_by("m")
    col = {c: table.column(c).to_pylist() for c in table.column_names}
    ns = col["n"]
    get = lambda c: np.concatenate([T.unpack(x, n) for x, n in zip(col[c], ns, strict=True)])
    value = np.concatenate([T.unpack_sorted(x, n) for x, n in zip(col["hash"], ns, strict=True)])
    key = get("id") + np.repeat(np.array([b + (1 << 63) for b in col["base"]], dtype=_U), ns)
    m, row, start, count = np.repeat(np.array(col["m"], dtype=_U), ns), get("row"), get("start"), get("count")
    order = np.lexsort((m, key, value))
    first, run = runs(value[order])
    total = np.add.reduceat(count[order], first)
    src = order[first]
    back = np.empty(len(order), np.int64)
    back[order] = run
    out, at = [], 0
    for i, n in enumerate(ns):
        r = back[at : at + n]
        out.append((col["m"][i], col["h"][i], n, T.pack(m[src][r]), T.pack(row[src][r]), T.pack(start[src][r]), T.pack(total[r])))
        at += n
    return _rows(FIRST, out)


def compact(m: int, block: Block, rep: np.ndarray, answers: pa.Table) -> dict[str, np.ndarray]:
    """Maximal paths of repeated edges that occur elsewhere first: row, start, edges, src_m, src_row, src_start."""
    none = {c: np.zeros(0, np.int64) for c in ("row", "start", "edges", "src_m", "src_row", "src_start")}
    if not rep.any():
        return none
    answers = answers.sort_by("h")
    ns = answers.column("n").to_pylist()
    at = block.at[rep]
    keys, back = np.unique(block.value[rep], return_inverse=True)
    got = {c: np.concatenate([T.unpack(x, n) for x, n in zip(answers.column(c).to_pylist(), ns, strict=True)]).astype(np.int64) for c in ("src_m", "src_row", "src_start", "total")}
    assert len(got["total"]) == len(keys), "answers don't fit the questions"
    src = {c: v[back] for c, v in got.items()}
    row = block.words.doc()[at]
    start = at - block.words.first[row]
    dup = (src["total"] > 1) & ~((src["src_m"] == m) & (src["src_row"] == row) & (src["src_start"] == start))
    if not dup.any():
        return none
    row, start, src = row[dup], start[dup], {c: v[dup] for c, v in src.items()}
    head = np.ones(len(row), bool)
    head[1:] = ~(
        (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1) & (src["src_m"][1:] == src["src_m"][:-1]) & (src["src_row"][1:] == src["src_row"][:-1])
        & (src["src_start"][1:] == src["src_start"][:-1] + 1) & (src["total"][1:] == src["total"][:-1])
    )
    p = np.flatnonzero(head)
    return {"row": row[p], "start": start[p], "edges": np.diff(np.append(p, len(row))), **{c: src[c][p] for c in ("src_m", "src_row", "src_start")}}


def _digest(block: Block, row: int, start: int, edges: int) -> bytes:
    lo = int(block.words.first[row]) + start
    return hashlib.blake2b(block.words.joined(lo, lo + edges + block.k - 1), digest_size=16).digest()


SPANS = [("kind", pa.int32()), ("m", pa.int32()), ("src_m", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("row", "start", "edges", "ask", "digest"))]


def ask_verify(m: int, block: Block, spans: dict[str, np.ndarray]) -> pa.Table:
    """kind 1: the spans of this block. kind 0: for each block with sources, the distinct (source span, digest) to be verified there."""
    n = len(spans["row"])
    if not n:
        return _rows(SPANS, [])
    out, ask = [], np.zeros(n, np.int64)
    by: dict[int, dict[tuple, int]] = {}
    for i in range(n):
        d = _digest(block, int(spans["row"][i]), int(spans["start"][i]), int(spans["edges"][i]))
        own = by.setdefault(int(spans["src_m"][i]), {})
        ask[i] = own.setdefault((int(spans["src_row"][i]), int(spans["src_start"][i]), int(spans["edges"][i]), d), len(own))
    out.append((1, m, m, n, T.pack(spans["row"]), T.pack(spans["start"]), T.pack(spans["edges"]), T.pack(spans["src_m"]) + T.pack(ask), b""))
    for src_m, own in by.items():
        a = np.array([k[:3] for k in own], dtype=np.int64)
        out.append((0, m, src_m, len(own), T.pack(a[:, 0]), T.pack(a[:, 1]), T.pack(a[:, 2]), b"", b"".join(k[3] for k in own)))
    return _rows(SPANS, out)


def answer_verify(block: Block, asked: pa.Table) -> pa.Table:
    """kind 2: whether the words at each source have the digest that the span has, and the words where not (start: bytes of each, digest: all of them). Rows of kind 1, the block's own spans, pass through."""
    known: dict[tuple, bytes] = {}
    out = []
    for r in asked.to_pylist():
        n = r["n"]
        if r["kind"] == 1:
            out.append(tuple(r[c] for c, _ in SPANS))
            continue
        ok, words = np.zeros(n, bool), []
        for i, key in enumerate(zip(*(T.unpack(r[c], n).tolist() for c in ("row", "start", "edges")), strict=True)):
            if key not in known:
                known[key] = _digest(block, *key)
            ok[i] = known[key] == r["digest"][16 * i : 16 * i + 16]
            if not ok[i]:
                lo = int(block.words.first[key[0]]) + key[1]
                words.append(block.words.joined(lo, lo + key[2] + block.k - 1))
        size = np.array([len(x) for x in words], np.int64)
        out.append((2, r["m"], r["src_m"], n, np.packbits(ok).tobytes(), T.pack(size), b"", b"", b"".join(words)))
    return _rows(SPANS, out)


def _source_words(r: dict) -> tuple[np.ndarray, dict[int, list[bytes]]]:
    """Which questions of an answer hold, and the words at the source of each that doesn't."""
    ok = np.unpackbits(np.frombuffer(r["row"], np.uint8), count=r["n"]).astype(bool)
    failed = np.flatnonzero(~ok)
    at = np.concatenate([[0], np.cumsum(T.unpack(r["start"], len(failed)).astype(np.int64))])
    return ok, {int(i): bytes(r["digest"][x:y]).split(b" ") for i, x, y in zip(failed, at[:-1], at[1:], strict=True)}


def covered(block: Block, told: pa.Table) -> np.ndarray:
    """Whether each word of the block lies in a verified span, or in a window of k words of a failed one that its source has too."""
    mark = np.zeros(len(block.words.starts) + 1, np.int64)
    rows = told.to_pylist()
    verdict = {r["src_m"]: _source_words(r) for r in rows if r["kind"] == 2}
    for r in rows:
        if r["kind"] != 1:
            continue
        n = r["n"]
        row, start, edges = (T.unpack(r[c], n).astype(np.int64) for c in ("row", "start", "edges"))
        cut = 1 + r["ask"][0] * n
        src_m, ask = T.unpack(r["ask"][:cut], n), T.unpack(r["ask"][cut:], n)
        ok = np.array([verdict[int(s)][0][int(a)] for s, a in zip(src_m, ask, strict=True)], bool)
        lo = block.words.first[row] + start
        np.add.at(mark, lo[ok], 1)
        np.add.at(mark, lo[ok] + edges[ok] + block.k - 1, -1)
        for i in np.flatnonzero(~ok):
            source = verdict[int(src_m[i])][1][int(ask[i])]
            same = np.array([block.words.word(int(lo[i]) + j) == x for j, x in enumerate(source)])
            for j in np.flatnonzero(np.convolve(same, np.ones(block.k, np.int64), "valid") == block.k) if len(same) >= block.k else []:
                mark[lo[i] + j] += 1
                mark[lo[i] + j + block.k] -= 1
    return np.cumsum(mark)[:-1] > 0


def _cut_text(block: Block, gone: np.ndarray, keep_space: bool) -> list:
    """The text of each row without the removed words: kept words joined by one space, or the text with each removed word and the white space after it cut out."""
    w = block.words
    out = []
    texts = block.table.column("text")
    for d in range(len(w.first) - 1):
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        drop = gone[lo:hi]
        if keep_space and not drop.any():
            out.append(texts[d].as_py())
            continue
        if not keep_space:
            if not drop.any():
                out.append(w.joined(lo, hi).decode("utf-8", "replace"))
                continue
            out.append(b" ".join(w.word(lo + int(i)) for i in np.flatnonzero(~drop)).decode("utf-8", "replace"))
            continue
        mask = np.ones(int(w.offsets[d + 1] - w.offsets[d]), np.int32)
        base = int(w.offsets[d])
        begin = w.starts[lo:hi] - base
        until = np.append(begin[1:], len(mask))
        change = np.zeros(len(mask) + 1, np.int32)
        np.add.at(change, begin[drop], 1)
        np.add.at(change, until[drop], -1)
        out.append(w.data[base : base + len(mask)][np.cumsum(change)[:-1] == 0].tobytes().decode("utf-8", "replace"))
    return out


def dedup_substrings(docs: DataFrame, k: int = WINDOW, keep_space: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_words, n_removed, extra...) of every row, without words of repeated spans.

    A word goes if a window of k words around it also starts earlier: in a row with a smaller doc_id (null
    before all), or earlier in the same row; rows that share a doc_id are ordered by block and text. Windows are
    judged on the input. text: the kept words joined by one space or, with keep_space, the
    original text with the removed words cut out (texts that lose nothing stay as they are, null included). Null and empty texts
    have no words. An empty table gives no rows.
    """
    b, blocks = blocked(docs, extra)

    def ask1(key, t):
        return ask_seen(key[0].as_py(), Block(t, k).short(), blocks, 48)

    seen_by_block = b.groupBy("m").applyInArrow(T.lean(ask1), _ASK).groupBy("h").applyInArrow(T.lean(answer_seen), _ANSWER)

    def ask2(key, left, right):
        block = Block(left, k)
        return _rows(ASK_FIRST, ask_first(key[0].as_py(), block, block.repeated(right), blocks) if len(block.value) else [])

    # What round 2 knows of repetition travels on to round 3 with the answers: a block's repeated edges are those asked for.
    first = (
        b.groupBy("m").cogroup(seen_by_block.groupBy("m")).applyInArrow(T.lean(ask2), "h int, m int, n int, base long, hash binary, id binary, row binary, start binary, count binary")
        .groupBy("h").applyInArrow(T.lean(answer_first), "m int, h int, n int, src_m binary, src_row binary, src_start binary, total binary")
    )
    both = first.select("m", "h", "n", "src_m", "src_row", "src_start", "total", F.lit(None).cast("binary").alias("blob")).unionByName(
        seen_by_block.select("m", "h", "n", *(F.lit(None).cast("binary").alias(c) for c in ("src_m", "src_row", "src_start", "total")), "blob")
    )

    def ask3(key, left, right):
        import pyarrow.compute as pc

        block, m = Block(left, k), key[0].as_py()
        if not len(block.value):
            return _rows(SPANS, [])
        round1 = pc.is_valid(right.column("blob"))
        rep = block.repeated(right.filter(round1).select(["h", "n", "blob"]))
        return ask_verify(m, block, compact(m, block, rep, right.filter(pc.invert(round1))))

    fields = "kind int, m int, src_m int, n int, row binary, start binary, edges binary, ask binary, digest binary"
    spans = b.groupBy("m").cogroup(both.groupBy("m")).applyInArrow(T.lean(ask3), fields)

    def verify(left, right):
        return answer_verify(Block(left, k), right) if right.num_rows else _rows(SPANS, [])

    # A block's own spans have itself as src_m, so spans and questions go out by one exchange and are computed once.
    told = b.groupBy("m").cogroup(spans.groupBy("src_m")).applyInArrow(T.lean(verify), fields)

    def finish(left, right):
        block = Block(left, k)
        gone = covered(block, right)
        upto = np.concatenate([[0], np.cumsum(gone)])
        n_removed = upto[block.words.first[1:]] - upto[block.words.first[:-1]]
        cols = [block.table.column("doc_id"), pa.array(_cut_text(block, gone, keep_space), pa.string()), pa.array(block.words.counts), pa.array(n_removed), *(block.table.column(c) for c in extra)]
        return pa.table(cols, names=["doc_id", "text", "n_words", "n_removed", *extra])

    types = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    out = "doc_id long, text string, n_words long, n_removed long" + "".join(f", `{c}` {types[c]}" for c in extra)
    return b.groupBy("m").cogroup(told.groupBy("m")).applyInArrow(T.lean(finish), out)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 20-word windows."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)
), d AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d
), k AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN c USING (doc_id, i)
), t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM k GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)
"""
