import hashlib
import random

import numpy as np
import pytest

from quern.operators import judge
from quern.plans import catalog


def test_registered_query_draws_all_resamples(spark, data):
    got = catalog.bootstrap_95(spark, data).first()
    assert tuple(got) == judge.bootstrap_interval(catalog.judgments(spark, data), samples=10_000)
    assert tuple(got) != judge.bootstrap_interval(catalog.judgments(spark, data), samples=1000)


def test_samples_are_those_of_pythons_generator():
    """Drawn on arrays, bit by bit what choices() and sum() give, for few and for many different means."""
    rnd = random.Random(3)
    for means in ([rnd.choice([0.0, 0.5, 1.0, 1 / 6, 2 / 3]) for _ in range(1501)], [rnd.random() for _ in range(4999)], [0.25]):
        rng = random.Random(42)
        plain = [sum(rng.choices(means, k=len(means))) / len(means) for _ in range(120)]
        assert judge._resampled(np.array(means), 120, 42).tolist() == plain


def test_draws_of_a_sample_are_hashed_together():
    for n in (1, 10, 11, 12_345, 110_000):
        got = judge.NumberedDraws(n)
        for parts in ((42, 0), (42, 9999), (7, 123), (123456789, "a")):
            want = [int(hashlib.md5(":".join(map(str, (*parts, j))).encode()).hexdigest()[:7], 16) for j in range(n)]
            assert got.draws(*parts).tolist() == want
    with pytest.raises(ValueError, match="too long"):
        judge.NumberedDraws(10).draws("x" * 60)


def test_no_draw_is_a_row(spark, data, monkeypatch):
    want = catalog.bootstrap_by_hash(spark, data).first()
    monkeypatch.setattr(judge, "hashed_draw", None)
    assert catalog.bootstrap_by_hash(spark, data).first() == want
