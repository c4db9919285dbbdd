"""Sketches never rule out a similar pair, whatever the sizes, folds and saturated cells."""

import numpy as np
import pytest

from prosegauge.llm.jaccard import may_be_similar, similar, sketch
from prosegauge.llm.textscan import mix


def _set(numbers):
    return np.unique(mix(np.asarray(list(numbers), np.uint64)))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 60, 63, 64, 65, 1000, 4095, 4097, 30_000])
def test_no_similar_pair_is_ruled_out(n):
    rng = np.random.default_rng(n)
    one = _set(range(n))
    for share in (0.0, 0.05, 0.1, 0.14, 0.2, 0.25):
        off = int(n * share)
        others = [_set(range(off, n)), _set(range(0, n + int(n * share * 4 / 3)))]
        others.append(_set(np.concatenate([rng.permutation(n)[: n - off // 2], np.arange(n, n + off // 2)])))
        for other in others:
            if similar(one, other):
                for a, b in ((one, other), (other, one)):
                    assert may_be_similar(sketch(a), len(a), sketch(b)[None, :], np.array([len(b)]))[0]


def test_unlike_sets_are_ruled_out():
    one, other = _set(range(2000)), _set(range(1500, 3500))
    assert not may_be_similar(sketch(one), len(one), sketch(other)[None, :], np.array([len(other)]))[0]


def test_a_full_cell_still_bounds_from_below():
    same_cell = np.arange(1, 1001, dtype=np.uint64) << np.uint64(32)
    drawn = sketch(same_cell)
    assert drawn.max() == 255
    assert may_be_similar(drawn, 1000, sketch(same_cell[:800])[None, :], np.array([800]))[0]


def test_a_block_of_sketches_is_judged_row_by_row():
    sets = [_set(range(k, k + 100)) for k in range(0, 120, 5)]
    rows, sizes = np.stack([sketch(s) for s in sets]), np.array([len(s) for s in sets])
    together = may_be_similar(sketch(sets[0]), 100, rows, sizes)
    alone = [may_be_similar(sketch(sets[0]), 100, r[None, :], np.array([n]))[0] for r, n in zip(rows, sizes, strict=True)]
    assert together.tolist() == alone and together[0] and not together[-1]


def test_sums_over_tasks_stop_at_the_largest_number(spark):
    from prosegauge.llm.shared import summed_arrays

    rows = spark.range(0, 5, 1, 5)
    found = summed_arrays(rows, lambda batches: np.array([sum(b.num_rows for b in batches), 2**31 + 5, 2**32 - 1], np.uint32), 3, "u4")
    assert found.tolist() == [5, 2**32 - 1, 2**32 - 1]
    assert summed_arrays(rows.limit(0), lambda batches: np.zeros(2, np.int64), 2, "i8").tolist() == [0, 0]
