import pytest

from cases import documents, frame, words
from quern.llm import blocks, debruijn


def brute(rows, k):
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for i, t in order:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            if g in seen:
                gone[p : p + k] = [True] * k
            seen.add(g)
        out.append((str(i), " ".join(x for x, y in zip(w, gone, strict=True) if not y), len(w), sum(gone)))
    return sorted(out)


@pytest.mark.parametrize("k,size", [(20, 1 << 20), (20, 4_000), (5, 10_000), (1, 10_000)])
def test_removed_words_by_brute_force(spark, monkeypatch, k, size):
    monkeypatch.setattr(blocks.blocked, "__defaults__", ((), size))
    rows = [*documents(k), (None, "al1 " * 30)]
    got = debruijn.dedup_substrings(frame(spark, rows), k).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"]) for r in got) == brute(rows, k)


def test_repeated_rows_and_layout(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text), (1, text), (2, f"new\n\n{text}  end\n"), (3, None)]
    got = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in debruijn.dedup_substrings(frame(spark, rows), 20, keep_space=True).collect() if r["text"] is not None)
    assert got == [(1, 0, text), (1, 25, ""), (2, 25, "new\n\nend\n")]
    assert debruijn.dedup_substrings(frame(spark, [])).count() == 0


def test_unverified_span_loses_what_its_source_has():
    """Of a span whose source has other words (as after a collision of hashes) only windows that are there go."""
    import pyarrow as pa

    block = debruijn.Block(pa.table({"doc_id": [1, 2], "text": ["a b c d", "a b x d"]}), 2)
    asked = debruijn.ask_verify(0, block, {c: pa.array([v]).to_numpy() for c, v in (("row", 1), ("start", 0), ("edges", 2), ("src_m", 0), ("src_row", 0), ("src_start", 0))})
    import pyarrow.compute as pc

    told = debruijn.answer_verify(block, asked.filter(pc.equal(asked.column("kind"), 0)))
    both = pa.concat_tables([asked.filter(pc.equal(asked.column("kind"), 1)), told])
    assert debruijn.covered(block, both).tolist() == [False] * 4 + [True, True, False, False]
    other = debruijn.Block(pa.table({"doc_id": [1, 2], "text": ["q b c d", "a b x d"]}), 2)
    told = debruijn.answer_verify(other, asked.filter(pc.equal(asked.column("kind"), 0)))
    assert not debruijn.covered(other, pa.concat_tables([asked.filter(pc.equal(asked.column("kind"), 1)), told])).any()
