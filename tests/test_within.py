"""Pairs within a distance: as by differences, and with one matrix of numbers."""

import tracemalloc

import numpy as np

from callgrid.operators import metric_join as M


def test_as_by_differences():
    r = np.random.default_rng(0)
    for x in (r.standard_normal((300, 5)), r.integers(0, 3, (300, 3)).astype(float), r.standard_normal((300, 4)) * 1e4, np.ones((50, 2))):
        for eps in (0.0, 1.0, 2.0, 3e3):
            assert (M.within(x[:70], x, eps) == (M._far(x, x[:70]).T <= eps)).all()
    assert M.within(np.zeros((0, 2)), np.ones((3, 2)), 1.0).shape == (0, 3)


def test_one_matrix():
    """Before, about five of them were held at once, and passing over them took most of the time."""
    x = np.random.default_rng(1).standard_normal((2048, 8))
    tracemalloc.start()
    M.within(x[:512], x, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 512 * 2048 * 8
