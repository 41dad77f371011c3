import random

import numpy as np
import pyarrow as pa

from cases import documents, frame
from quern.llm import decontam


def items(n=12, seed=2):
    rnd = random.Random(seed)
    return [(i, " ".join(f"i{rnd.randrange(400)}" for _ in range(rnd.choice([6, 15, 30, 50])))) for i in range(n)]


def edit(rnd, w, k):
    for _ in range(k):
        p, kind = rnd.randrange(len(w)), rnd.randrange(3)
        if kind == 0:
            w[p] = f"z{rnd.randrange(10**6)}"
        elif kind == 1:
            w.insert(p, f"z{rnd.randrange(10**6)}")
        else:
            del w[p]
    return w


def test_edited_passages_are_found_and_clean_texts_left_alone(spark):
    rnd, own = random.Random(4), items()
    clean = [t for _, t in documents() if t]
    rows, want = [], set()
    for d in range(150):
        i, t = rnd.choice(own)
        w = edit(rnd, t.split(), rnd.randrange(int(0.2 * len(t.split())) + 1))
        host = rnd.choice(clean).split()
        p = rnd.randrange(len(host) + 1)
        rows.append((d, " ".join([*host[:p], *w, *host[p:]])))
        want.add((d, i))
    rows += [(1000 + d, t) for d, t in enumerate([None, "", *clean])]
    bench = spark.createDataFrame([*own, (50, None), (51, ""), own[0]], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_passages(frame(spark, rows), bench).collect()}
    assert len(want - got) <= 2 and all(d < 1000 for d, _ in got)
    kept = {r["doc_id"] for r in decontam.without_passages(frame(spark, rows), bench).select("doc_id", "__text").collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_spans_case_and_empty_tables(spark):
    own = items()
    text = "before it: " + own[2][1].upper().replace(" ", ", ") + " and after"
    bench = spark.createDataFrame(own, "item_id long, text string")
    got = decontam.find_passages(frame(spark, [(1, text), (1, text)]), bench).collect()
    n = len(own[2][1].split())
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["n_words"], r["distance"], r["item_words"]) for r in got] == [(1, 2, 2, n, 0, n)] * 2
    assert decontam.find_passages(frame(spark, []), bench).count() == 0
    assert decontam.find_passages(frame(spark, [(1, text)]), bench.limit(0)).count() == 0


def test_distance_by_brute_force():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(1)
    for _ in range(60):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(1, 7))] for _ in range(2))
        want = min(full(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontam.distance(np.array(a), np.array(b))[0] == want


def copies(rnd, own, each):
    """Copies of items with as many edits as are allowed, in other words."""
    texts, want = [], []
    for i, (_, t) in enumerate(own):
        for _ in range(each):
            w = edit(rnd, t.split(), int(0.2 * len(t.split())))
            around = [f"o{rnd.randrange(10**6)}" for _ in range(30)]
            p = rnd.randrange(31)
            texts.append(" ".join([*around[:p], *w, *around[p:]]))
            want.append(i)
    return texts, want


def test_recall_for_every_length():
    """Over texts that the index has not seen, for items of 1 to 60 words."""
    rnd = random.Random(11)
    sizes = [1, 2, 3, 4, 5, 6, 8, 9, 10, 14, 15, 20, 25, 30, 45, 60]
    own = [(i, " ".join(f"q{rnd.randrange(3000)}" for _ in range(n))) for i, n in enumerate(sizes)]
    index = decontam.build_index(own)
    assert all(r >= decontam.RECALL for r in index.recall.values())
    texts, want = copies(rnd, own, 150)
    found = {(d, i) for d, i, *_ in decontam.search(pa.array(texts), index)}
    by = {}
    for d, i in enumerate(want):
        by.setdefault(i, []).append((d, i) in found)
    assert min(sum(x) / len(x) for x in by.values()) > 0.96
    assert sum(map(sum, by.values())) / len(want) >= decontam.RECALL - 0.005


def test_against_all_windows_by_brute_force():
    """Every window of every text, over few words, so that passages come about by chance: nothing else is found, and little of it missed."""
    rnd = random.Random(6)
    own = [(i, " ".join(f"v{rnd.randrange(5)}" for _ in range(rnd.choice([4, 5, 7, 10, 12])))) for i in range(25)]
    texts = [" ".join(f"v{rnd.randrange(5)}" for _ in range(rnd.randrange(0, 120))) for _ in range(250)]
    index = decontam.build_index(own)
    words, first = decontam.tokens(pa.array(texts))
    want = {}
    for d in range(len(texts)):
        for i in range(len(own)):
            item = index.words[index.first[i] : index.first[i + 1]]
            far = decontam.distance(item, words[first[d] : first[d + 1]])[0]
            if far <= int(decontam.allowed(np.array([len(item)]))[0]):
                want[(d, i)] = far
    got = {}
    for d, i, _, _, far in decontam.search(pa.array(texts), index):
        got[(d, i)] = min(far, got.get((d, i), 99))
    assert len(want) > 200 and set(got) <= set(want)
    assert len(got) >= decontam.RECALL * len(want) - 2
    # Without tables every anchored window is verified, and nothing is missed.
    every = decontam.build_index(own, most_walks=1, recall=1.01)
    assert set(every.walks.values()) == {0}
    found = {}
    for d, i, _, _, far in decontam.search(pa.array(texts), every):
        found[(d, i)] = min(far, found.get((d, i), 99))
    assert found == want


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BYTES", 400)
    own = items()
    rows = [(i, f"a b c {t} d e") for i, t in own] + [(100, "nothing here"), (101, None)]
    bench = spark.createDataFrame(own, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_passages(frame(spark, rows), bench).collect()} == {(i, i) for i, _ in own}
    assert {r["doc_id"] for r in decontam.without_passages(frame(spark, rows), bench).collect()} == {100, 101}


def test_nothing_to_search():
    index = decontam.build_index(items(40))
    assert decontam.search(pa.array([""]), index) == []
    assert decontam.search(pa.array(["a b"]), decontam.build_index([])) == []
