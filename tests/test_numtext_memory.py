import os
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.functions import numtext as T


def _held() -> int:
    """MB of this process's own memory."""
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) >> 10


def _scattered(_=None) -> pa.Table:
    """Leaves about 200 MB of small free pieces below one that is still used."""
    parts = [np.ones(8000) for _ in range(3200)]
    _scattered.last = parts[-1]
    return pa.table({"n": [len(parts)]})


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup") or T._trim() is None, reason="needs Linux and glibc")
def test_memory_goes_back_when_a_call_ends():
    before = _held()
    assert _scattered().num_rows == 1
    assert _held() - before > 150  # what a call leaves without lean()
    assert T.lean(_scattered)(None).num_rows == 1
    assert _held() - before < 50


def test_lean_keeps_parameters_and_results():
    from inspect import signature

    for work, args in ((lambda t: t, (1,)), (lambda key, t: (key, t), (1, 2)), (lambda key, left, right: (key, left, right), (1, 2, 3))):
        assert T.lean(work)(*args) == work(*args) and len(signature(T.lean(work)).parameters) == len(args)

    def run(batches):
        yield from batches

    assert list(T.lean(run)(iter([1, 2]))) == [1, 2]


def test_runs_are_bounded():
    assert list(T.runs(np.array([3, 1, 9, 0, 2]), 4)) == [(0, 2), (2, 3), (3, 5)]
    assert list(T.runs(np.zeros(0, np.int64), 4)) == [] and list(T.runs(np.array([0, 0]), 4)) == [(0, 2)]
