"""Bounded nearest neighbours against full matrices of distances, over vectors of several kinds."""

import numpy as np
import pytest

from callgrid.operators import knn

R = np.random.default_rng(1)
KINDS = {
    "unit": (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(R.standard_normal((2500, 64))), "whole": R.integers(0, 3, (2500, 4)).astype(float),
    "copies": np.repeat(R.standard_normal((250, 16)), 10, 0) + 1e-3 * (R.random((2500, 16)) < 0.1), "far": R.standard_normal((2500, 8)) * 1e6 + 1e9,
    "heavy": R.standard_cauchy((2500, 12)), "same": np.ones((2500, 5)), "wide": R.standard_normal((2300, 300)), "huge": R.standard_normal((2300, 6)) * 1e150,
    "holes": np.where(R.random((2500, 6)) < 0.03, np.nan, R.standard_normal((2500, 6))),
}


@pytest.mark.parametrize("metric,p", [("euclidean", 2.0), ("manhattan", 2.0), ("cosine", 2.0), ("chebyshev", 2.0), ("minkowski", 3.0), ("minkowski", 1.5)])
@pytest.mark.parametrize("kind", KINDS)
def test_as_full_matrix(kind, metric, p):
    x = KINDS[kind]
    ids, at, k = R.permutation(len(x)) * 3 + 1, R.choice(len(x), 40, False), 5
    with np.errstate(all="ignore"):
        got = set(zip(*[c.tolist() for c in knn.nearest(x[at], ids[at], x, ids, k, metric, p, True)], strict=True))
        whole = np.round(knn.distances(x[at], x, metric, p), knn.DIGITS)
    want = set()
    for own, d in zip(ids[at].tolist(), whole, strict=True):
        d = np.where(ids == own, np.inf, d)
        want |= {(own, int(ids[j]), float(d[j])) for j in [j for j in np.lexsort((ids, d)) if d[j] < np.inf][:k]}
    assert got == want


def test_few_pairs_are_measured(monkeypatch):
    """Before, each of the 800,000 pairs was measured in full."""
    x, measured = R.standard_normal((20000, 32)), []
    full = knn.paired
    monkeypatch.setattr(knn, "paired", lambda q, t, *a: measured.append(len(q)) or full(q, t, *a))
    for metric in ("euclidean", "manhattan", "cosine", "chebyshev"):
        measured.clear()
        knn.nearest(x[:40], np.arange(40), x, np.arange(len(x)), 5, metric, 2.0, True)
        assert sum(measured) < 40_000
