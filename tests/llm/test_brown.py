import collections
import math

import numpy as np
from pyspark.sql import functions as F

from cases import documents, frame, words
from quern.llm import blocks, brown


def test_counts_and_base_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks.blocked, "__defaults__", ((), 20_000))
    rows = [*documents(), (None, "al1 be2"), (2, "al1 al1"), (2, "al1 al1")]
    got = brown.score_documents(frame(spark, rows), F.col("doc_id") % 4 == 0).collect()
    held = lambda i: i is not None and math.fmod(i, 4) == 0
    tokens = [(i, [*words(t, True), "\0"]) for i, t in rows]
    c = collections.Counter(w for i, x in tokens if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for i, x in tokens)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_no_training_text_and_empty_table(spark):
    got = brown.score_documents(frame(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 0, 0), (3, 0, 0)]
    assert brown.score_documents(frame(spark, []), F.lit(False)).count() == 0


def test_probabilities_add_up():
    """Over all words after each class: known words by their share of their class, and as many unseen words as were seen."""
    rng = np.random.default_rng(0)
    count = np.array([40, 30, 20, 9, 7, 3, 2, 1, 1])
    cls = np.array([0, 0, 1, 1, 2, 6, 6, 5, 5])
    mass = np.bincount(cls, weights=count, minlength=8)
    mass[4] = 25
    table = rng.integers(1, 9, (8, 8)).astype(float)
    model = brown.Model(table, mass, 3, len(count) + 1)
    for before in range(8):
        known = 10 ** (model.log[before, cls] + model.emission(cls, count))
        end = 10 ** (model.log[before, 4] + model.emission(np.array([4]), np.array([25])))
        unseen = 10 ** (model.log[before, 3] + model.emission(np.array([3]), np.array([0])))
        assert abs(known.sum() + end[0] + (len(count) + 1) * unseen[0] - 1) < 1e-9


def entropy(table):
    f = lambda x: float(np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum())
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def naive_best(table, classes, a, right, left, own):
    """The class with the greatest likelihood of the whole table, computed anew for each."""
    def moved(b):
        t = table.astype(float).copy()
        for c, sign in ((a, -1), (b, 1)):
            t[c] += sign * right
            t[:, c] += sign * left
            t[c, c] += sign * own
        return entropy(t)

    at = {b: moved(b) for b in {*range(classes), a}}
    best = max(range(classes), key=lambda b: (at[b], -b))
    return best if at[best] > at[a] + 1e-9 else a


def test_best_classes_by_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(30):
        k, classes, words = 7, 5, 20
        bigrams = rng.poisson(rng.random((words, words)) * 2)
        cls = rng.integers(0, k, words)
        hot = np.eye(k)[cls]
        table = hot.T @ bigrams @ hot
        own = np.diag(bigrams).astype(float)
        right, left = bigrams @ hot - own[:, None] * hot, bigrams.T @ hot - own[:, None] * hot
        got = brown.best_classes(table, classes, cls, right, left, own)
        for w in range(words):
            assert got[w] == naive_best(table, classes, cls[w], right[w], left[w], own[w]), (trial, w)
        moved = table.copy()
        brown.move_words(moved, cls[:1], got[:1], right[:1], left[:1], own[:1])
        cls[0] = got[0]
        hot[0] = np.eye(k)[cls[0]]
        rest = (hot.T @ bigrams @ hot) if right[0, got[0]] == left[0, got[0]] == 0 else None
        assert rest is None or np.allclose(moved.sum(), rest.sum())


def test_score_by_brute_force(spark, monkeypatch):
    """Counts, exchange on the driver and in one round, smoothing and scores in plain Python; one bucket, words move one by one."""
    monkeypatch.setattr(brown, "TOP", 8)
    monkeypatch.setattr(brown, "CLASSES", 4)
    monkeypatch.setattr(brown, "ROUNDS", 1)
    monkeypatch.setattr(brown, "STEP", 1)
    rnd = __import__("random").Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    weight = [1 / (i + 1) for i in range(40)]
    rows = [(i, " ".join(rnd.choices(vocabulary, weight, k=rnd.randrange(0, 60)) + ([f"r{rnd.randrange(60)}"] if i % 3 else []))) for i in range(60)]
    got = {r["doc_id"]: r for r in brown.score_documents(frame(spark, rows), F.col("doc_id") % 5 == 0).collect()}
    train = [[*words(t, True), ""] for i, t in rows if i % 5]
    n = collections.Counter(w for x in train for w in x)
    keys = {w: brown.Tokens(__import__("pyarrow").table({"doc_id": [1], "text": [w], "held_out": [False]})).hash[0] for w in n if w}
    key = lambda w: int(keys[w])
    clustered = sorted((w for w in n if w and n[w] >= brown.MIN_COUNT), key=key)
    top = sorted(clustered, key=lambda w: (-n[w], key(w) - (1 << 64) if key(w) >> 63 else key(w)))[:8]
    band = lambda c: 2 + int(math.log2(c)) if c else 0
    classes, unseen, k = 4, 4, 4 + 2 + brown.RARE

    def bigrams(number):
        out = collections.Counter()
        for x in train:
            out.update(zip(["", *x[:-1]], x, strict=True)) if number is None else out.update((number(a), number(b)) for a, b in zip(["", *x[:-1]], x, strict=True))
        return out

    # Exchange of the top words, one after another, until nothing moves.
    place = {w: i * classes // 8 for i, w in enumerate(top)}
    less = lambda w: place[w] if w in place else unseen + 1 if w == "" else unseen + band(n[w] if n[w] >= brown.MIN_COUNT and rounds else n[w] - 1)
    rounds = 0
    count = bigrams(None)

    def around(w, of):
        right, left, own = np.zeros(k), np.zeros(k), count[(w, w)]
        for (a, b), c in count.items():
            if a == w and b != w:
                right[of(b)] += c
            if b == w and a != w:
                left[of(a)] += c
        return right, left, own

    def table_of(of):
        t = np.zeros((k, k))
        for (a, b), c in count.items():
            t[of(a), of(b)] += c
        return t

    for _ in range(brown.PASSES):
        before = dict(place)
        for w in top:
            place[w] = naive_best(table_of(less), classes, place[w], *around(w, less))
        if before == place:
            break
    # One round of all clustered words, by the classes at its start.
    rounds = 1
    old = {w: place.get(w, unseen + band(n[w])) for w in clustered}
    place = dict(old)
    start = lambda w: old[w] if w in old else unseen + 1 if w == "" else unseen + band(n[w] - 1)
    t = table_of(start)
    like = entropy(t)
    for w in clustered:
        right, left, own = around(w, start)
        b = naive_best(t, classes, place[w], right, left, own)
        for c, sign in ((place[w], -1), (b, 1)):
            t[c] += sign * right
            t[:, c] += sign * left
            t[c, c] += sign * own
        place[w] = b
    lessened = lambda w: place[w] if w in place else unseen + 1 if w == "" else unseen + band(n[w] - 1)
    if entropy(table_of(lessened)) <= like:
        place = old
    full = lambda w: place[w] if w in place else unseen + 1 if w == "" else unseen + band(n[w])
    t, mass = table_of(lessened), np.zeros(k)
    for w, c in n.items():
        mass[full(w)] += c
    t[:, [c for c in range(k) if not mass[c] and c != unseen]] = 0
    prior = (t.sum(axis=0) + mass) / 2
    prior[unseen] += brown.WORD_DELTA
    prior /= prior.sum()
    for i, text in rows:
        total, c0 = 0.0, unseen + 1
        for w in [*words(text, True), ""]:
            c = full(w)
            step = (t[c0, c] + brown.BIGRAM_WEIGHT * prior[c]) / (t[c0].sum() + brown.BIGRAM_WEIGHT)
            total += math.log10(step * (n[w] / mass[c] if n[w] else 1 / len(n)))
            c0 = c
        assert abs(total - got[i]["score"]) < 1e-6 * max(1, abs(total)), i
        assert abs(got[i]["perplexity"] - 10 ** (-total / got[i]["n_tokens"])) < 1e-6 * got[i]["perplexity"]


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(1)
    truth = np.arange(40) % 4
    follow = np.full((4, 4), 1.0) + 30 * np.roll(np.eye(4), 1, axis=1)
    bigrams = rng.poisson(follow[truth][:, truth]).astype(float)
    start = np.arange(40) * 4 // 40
    found = brown.exchange(bigrams, start, np.ones(40, bool), 4)
    assert len({(a, b) for a, b in zip(truth, found, strict=True)}) == 4


def test_better_than_unigrams_on_held_out_text(spark, data):
    got = brown.op2_lm_scoring(spark, data).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]
