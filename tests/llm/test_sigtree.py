import itertools

import pytest

from cases import documents, frame, words
from quern.llm import blocks, sigtree


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = words(t, True)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 10**9), 10**9 if d is None else d)
    return sorted((str(d), len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,num,members,size", [(3, 90, 1000, 1 << 20), (5, 80, 3, 5_000), (1, 60, 4, 5_000)])
def test_components_by_brute_force(spark, monkeypatch, k, num, members, size):
    monkeypatch.setattr(blocks.blocked, "__defaults__", ((), size))
    monkeypatch.setattr(sigtree, "MEMBERS", members)
    rows = [*documents(k), (None, "al1 be2 ce3 do4"), (900, "al1 be2 ce3 do4"), (900, "al1 be2 ce3 do4")]
    got = sigtree.jaccard_components(frame(spark, rows), k, num, 100).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], 10**9 if r["component_id"] is None else r["component_id"]) for r in got) == brute(rows, k, num, 100)
    assert sum(r["rank"] == 1 for r in got) == len({(r["component_id"], r["rid"] if r["component_id"] is None else 0) for r in got})


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g h"), (4, "A b c d e f g h"), (4, "A b c d e f g h"), (6, ""), (7, None), (8, "x")]
    kept = sigtree.keep_one(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] != 7) == [(4, "A b c d e f g h"), (6, ""), (8, "x")] and len(kept) == 4
    assert sigtree.keep_one(frame(spark, [])).count() == 0 and sigtree.jaccard_components(frame(spark, [])).count() == 0
