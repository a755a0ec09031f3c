"""The weakest-link path against a plain recursion, and the choice among a tree's subtrees."""

import numpy as np
import pytest

from callgrid.operators import models, pruning

CLASSES = ("a", "b", "c")


def grown(r, depth):
    """A random tree whose costs fall towards the leaves."""
    left, right, cost, label = [], [], [], []

    def add(c, d):
        at = len(left)
        left.append(-1), right.append(-1), cost.append(c), label.append(float(at))
        if d and r.random() < 0.85:
            share = r.dirichlet([1, 1, 1])[:2] * c
            left[at] = add(share[0], d - 1)
            right[at] = add(share[1], d - 1)
        return at

    add(1.0, depth)
    return pruning.Nodes(*(np.array(x) for x in (left, right, cost, label)))


def plain_path(t):
    """Cuts found from scratch at every step."""
    kept, out, alpha = t.left >= 0, [], 0.0

    def below(n):
        return (t.cost[n], 1) if not kept[n] else tuple(map(sum, zip(below(t.left[n]), below(t.right[n]), strict=True)))

    def drop(n):
        if kept[n]:
            kept[n] = False
            drop(t.left[n]), drop(t.right[n])

    out.append((0.0, kept.copy()))
    while kept[0]:
        g = {n: (t.cost[n] - below(n)[0]) / (below(n)[1] - 1) for n in np.flatnonzero(kept)}
        n = min(g, key=lambda x: (g[x], x))
        alpha = max(alpha, g[n])
        drop(n)
        out.append((alpha, kept.copy()))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_path_equals_a_plain_recursion(seed):
    t = grown(np.random.default_rng(seed), 6)
    got, want = pruning.path(t), plain_path(t)
    assert got[0][0] == 0 and not got[-1][1].any() and [a for a, _ in got] == sorted({a for a, _ in got})
    for alpha, kept in got:
        same = [k for a, k in want if a <= alpha + 1e-12][-1]
        assert (kept == same).all()
    assert np.allclose([a for a, _ in got], np.unique(np.round([a for a, _ in want], 15)), atol=1e-12)


def test_trials_and_leaves():
    assert pruning.trial_alphas([0.0, 0.1, 0.1]) == [0.0, 0.1] and len(pruning.trial_alphas(np.arange(50.0).tolist())) == 12
    t = pruning.Nodes(np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.ones(5), np.arange(5.0))
    assert pruning.by_leaf(t, np.array([1, 0, 1, 0, 0], bool)) == [1, 3, 4] and pruning.by_leaf(t, np.array([1, 0, 0, 0, 0], bool)) == [1, 2, 2]
    assert t.leaves(np.array([1, 0, 1, 0, 0], bool)) == (2, 3) and t.leaves(np.zeros(5, bool)) == (0, 1)


def rows(spark, n, seed, noise):
    r = np.random.default_rng(seed)
    y = r.integers(0, 3, n)
    x = r.normal(size=(n, 4))
    x[:, 0] += y * 4
    y = np.where(r.random(n) < noise, r.integers(0, 3, n), y)
    return spark.createDataFrame([(i, CLASSES[c], [float(v) for v in row]) for i, (c, row) in enumerate(zip(y, x, strict=True))],
        "id long, label string, features array<double>")


def test_pruning_chooses_a_small_tree_that_predicts_well(spark):
    """The full tree learns the noise; a subtree is better on other rows, and its predictions are those of its trial."""
    train, other = rows(spark, 400, 1, 0.3), rows(spark, 300, 2, 0.0)
    model, trials = pruning.cost_complexity_tree(train, other, CLASSES)
    full, best = trials[0], max(t[1] for t in trials)
    assert full[0] == 0 and 2 <= len(trials) <= 12 and [t[3] for t in trials] == sorted((t[3] for t in trials), reverse=True) and trials[-1][3] == 1
    chosen = next(t for t in trials if t[0] == model.alpha)
    assert chosen[1] == best > full[1] and chosen[3] < full[3]
    assert chosen == min((t for t in trials if t[1] == best), key=lambda t: (t[2], t[3], t[0]))
    out = models.predictions(train, other, "decision_tree_pruned", CLASSES, selection=other).collect()
    hits = np.mean([r["y_true_label"] == r["y_pred_label"] for r in out])
    assert len(out) == 300 and hits > 0.85


def test_unpruned_predictions_are_the_trees_own(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    train = models.balanced(models._ready(rows(spark, 200, 3, 0.2), CLASSES))
    model = DecisionTreeClassifier(maxDepth=8, featuresCol="vector", labelCol="label_idx", weightCol="weight").fit(train)
    tree = pruning.nodes_of(model)
    whole = pruning.Pruned(model, pruning.by_leaf(tree, tree.left >= 0), 0.0)
    want = {r["id"]: r["prediction"] for r in model.transform(train).collect()}
    assert {r["id"]: r["prediction"] for r in whole.transform(train).collect()} == want
    assert tree.leaves(tree.left >= 0) == (model.depth, (model.numNodes + 1) // 2)


def test_leaves_are_no_literals_of_a_plan(spark):
    """Leaves grow with the rows; before, every leaf's prediction was a literal of the plan, and every trial's too."""
    from pyspark.ml.classification import DecisionTreeClassifier

    train = models._ready(rows(spark, 400, 1, 0.3), CLASSES)
    model = DecisionTreeClassifier(maxDepth=30, featuresCol="vector", labelCol="label_idx").fit(train)
    assert model.numNodes > 100
    plans = []
    for leaves in (100, (model.numNodes + 1) // 2):
        out = pruning.Pruned(model, [1.0] * leaves, 0.0).transform(train)
        plans.append(str(out._jdf.queryExecution().analyzed().expressions()) + out._jdf.queryExecution().analyzed().treeString())
    assert out.count() == 400 and {r["prediction"] for r in out.collect()} == {1.0} and "1.0, 1.0" not in plans[1]


def test_a_large_tree_takes_memory_as_its_nodes():
    """Before, every step looked through all nodes and kept a copy of them: more than 100 MB here."""
    import tracemalloc

    n, r = 1 << 14, np.random.default_rng(0)
    left = np.array([2 * i + 1 if i < n - 1 else -1 for i in range(2 * n - 1)])
    cost = r.random(2 * n - 1)
    for i in reversed(range(n - 1)):
        cost[i] += cost[2 * i + 1] + cost[2 * i + 2]
    tracemalloc.start()
    alphas, gone = pruning.cuts(pruning.Nodes(left, np.where(left >= 0, left + 1, -1), cost, np.zeros(2 * n - 1)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(alphas) > 4000 and (gone[left >= 0] >= 1).all() and not gone[left < 0].any() and most < 60 << 20
